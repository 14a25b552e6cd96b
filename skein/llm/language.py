"""Operator 8: language identification by FTRL-trained logistic regression on TF-IDF character n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

#: Hashed features; n-grams of 1 to 3 letters share them.
FEATURES = 1 << 15
GRAMS = (1, 2, 3)
#: The classifier is fitted on about this many labelled rows of a language at most.
ROWS_PER_LANGUAGE = 2_000
#: Parts of the sample, each a model of its own whose weights are averaged; one more part calibrates.
PARTS = 4
EPOCHS = 3
UNKNOWN = "und"
#: A text no language of which is this likely, after calibration, is in none of those that were learned.
LEAST_SCORE = 0.4


@dataclass
class Ftrl:
    """FTRL-Proximal (McMahan et al., 2013) with elastic-net penalties, for several classes."""

    classes: int
    alpha: float = 0.5
    beta: float = 1.0
    l1: float = 0.02
    l2: float = 0.5

    def __post_init__(self):
        self.z = np.zeros((FEATURES, self.classes))
        self.n = np.zeros((FEATURES, self.classes))

    def weights(self, at=slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        w = -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        return np.where(np.abs(z) <= self.l1, 0.0, w)

    def learn(self, at: np.ndarray, x: np.ndarray, label: int) -> None:
        w = self.weights(at)
        p = softmax((x @ w)[None, :])[0]
        p[label] -= 1
        g = x[:, None] * p[None, :]
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + g * g


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


_LETTER: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """For each code point whether it is a letter."""
    if not _LETTER:
        _LETTER.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _LETTER[0]


def grams(text: str | None) -> tuple[np.ndarray, np.ndarray] | None:
    """Features of the whole text and their counts; None if it has no letter.

    Letters are lower-cased, everything between them counts as one space."""
    if not text:
        return None
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[codes]
    if not letter.any():
        return None
    codes = np.where(letter, codes, np.uint32(32))
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # the first of what stands between letters
    codes = codes[keep]
    if codes[0] != 32:
        codes = np.concatenate([np.array([32], np.uint32), codes])
    found = []
    for n in GRAMS:
        m = len(codes) - n + 1
        if m > 0:
            h = codes[:m] + np.uint32(n * 0x9E3779B1 & 0xFFFFFFFF)
            for j in range(1, n):
                h = h * np.uint32(0x85EBCA6B) + codes[j : j + m]
            h ^= h >> np.uint32(15)
            h *= np.uint32(0xC2B2AE35)
            found.append(h >> np.uint32(17))
    counts = np.bincount(np.concatenate(found), minlength=FEATURES)
    at = np.flatnonzero(counts)
    return at, counts[at]


def _weighted(found: tuple[np.ndarray, np.ndarray], idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at, counts = found
    x = np.log1p(counts) * idf[at]
    return at, x / max(np.linalg.norm(x), 1e-12)


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray
    temperature: float = 1.0

    def logits(self, found: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        at, x = _weighted(found, self.idf)
        return x @ self.weights[at]


def _held_out(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.col(doc_id).cast("string")) % 5 == 0


def train(docs: DataFrame, rows_per_language: int = ROWS_PER_LANGUAGE) -> Model | None:
    """A model of the languages of docs; None without any labelled row to learn from.

    Only rows that are not held out are learned from, by text and lang. Document frequencies
    are counted over all of them (summed in each task before the shuffle); the classifier is fitted
    on a sample of about rows_per_language rows of each language, chosen by a hash.
    """
    spark = docs.sparkSession
    labelled = docs.where("text is not null and lang is not null").where(~_held_out()).select("text", "lang")
    key = F.xxhash64("text", "lang")
    told = labelled.groupBy("lang").agg(F.count("*"), F.min(key)).orderBy("lang").collect()  # a row for each language
    if not told:
        return None
    sizes, first = {r[0]: r[1] for r in told}, {r[0]: r[2] for r in told}
    languages = list(sizes)

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, rows = np.zeros(FEATURES, np.int64), 0
        for x in batches:
            for text in x["text"].to_pylist():
                if found := grams(text):
                    df[found[0]] += 1
                    rows += 1
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array([*at, -1], pa.int32()), pa.array([*df[at], rows], pa.int64())], ["f", "n"])

    counted = dict(labelled.select("text").mapInArrow(frequencies, "f int, n long").groupBy("f").agg(F.sum("n").alias("n")).collect())  # at most FEATURES + 1 rows
    idf = np.full(FEATURES, np.log1p(counted.get(-1, 0)) + 1)
    for f, n in counted.items():
        if f >= 0:
            idf[f] = np.log((1 + counted[-1]) / (1 + n)) + 1

    share = F.create_map(*[v for k, n in sizes.items() for v in (F.lit(k), F.lit(min(1.0, rows_per_language / n)))])
    least = F.create_map(*[v for k, x in first.items() for v in (F.lit(k), F.lit(x))])
    # copies share a key; a language of few different texts keeps one at least
    sample = labelled.withColumn("key", key).where((F.pmod("key", F.lit(1 << 20)) < share[F.col("lang")] * (1 << 20)) | (F.col("key") == least[F.col("lang")])).withColumn("part", F.pmod(F.xxhash64("key"), F.lit(PARTS + 1)).cast("int"))
    # equal rows of a large group of copies say nothing new
    sample = sample.dropDuplicates(["text", "lang"])

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        model, order = Ftrl(len(languages)), np.random.default_rng(7)
        rows = rows.sort_values("key")
        data = [(*_weighted(found, idf), languages.index(lang)) for text, lang in zip(rows["text"], rows["lang"], strict=True) if (found := grams(text))]
        for _ in range(EPOCHS):
            for i in order.permutation(len(data)):
                model.learn(*data[i])
        w = model.weights()
        f, c = np.nonzero(w)
        return pd.DataFrame({"f": f.astype(np.int32), "c": c.astype(np.int32), "w": w[f, c]})

    fitted = sample.where(F.col("part") < PARTS).groupBy("part").applyInPandas(fit, "f int, c int, w double")
    weights = np.zeros((FEATURES, len(languages)))
    for f, c, w in fitted.groupBy("f", "c").agg(F.sum("w").alias("w")).toLocalIterator():  # at most FEATURES rows a language
        weights[f, c] = w / PARTS
    model = Model(languages, idf, weights)
    shared = spark.sparkContext.broadcast(model)

    def held(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            out = [(shared.value.logits(found).tolist(), languages.index(lang)) for text, lang in zip(x["text"], x["lang"], strict=True) if (found := grams(text))]
            yield pd.DataFrame(out, columns=["logits", "label"])

    kept = sample.where(F.col("part") == PARTS).mapInPandas(held, "logits array<double>, label int").collect()  # the calibration part
    if kept:
        logits, label = np.array([r[0] for r in kept]), np.array([r[1] for r in kept])
        # targets smoothed as Platt does, or a sample without errors would ask for certainty
        wrong = 1 / (len(label) + 2)
        target = np.full(logits.shape, wrong / max(len(languages) - 1, 1))
        target[np.arange(len(label)), label] = 1 - wrong
        loss = lambda t: -(target * np.log(softmax(logits / t) + 1e-300)).sum(axis=1).mean()
        model.temperature = float(min(np.geomspace(0.01, 20, 200), key=loss))
    return model


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """docs with __lang_pred and __score; other columns stay as they are."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for x in batches:
            langs, scores = [], []
            for text in x["text"].to_pylist():
                found = grams(text) if m else None
                if found is None:
                    langs.append(UNKNOWN), scores.append(0.0)
                else:
                    p = softmax(m.logits(found)[None, :] / m.temperature)[0]
                    langs.append(m.languages[int(p.argmax())]), scores.append(float(p.max()))
            yield pa.RecordBatch.from_arrays([*x.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], [*x.schema.names, "__lang_pred", "__score"])

    told = docs.withColumn("__lang_pred", F.lit("")).withColumn("__score", F.lit(0.0)).schema
    return docs.mapInArrow(run, told)


def identify(docs: DataFrame, rows_per_language: int = ROWS_PER_LANGUAGE) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row of docs (doc_id, text, lang).

    lang_pred is a value of lang that was learned, from whole texts; score is its probability
    after temperature calibration. Rows whose crc32(doc_id as text) mod 5 is 0 are held out.

    Cases: null texts and texts without a letter are `und` with score 0; without any labelled row
    all are; a null doc_id is neither held out nor learned from; a null lang is not learned
    from; repeated rows count once in the sample; ties go to the first language by name;
    other columns are left aside.
    """
    done = predict(docs.select("doc_id", "text"), train(docs, rows_per_language))
    return done.select("doc_id", F.coalesce(_held_out(), F.lit(False)).alias("held_out"), F.col("__lang_pred").alias("lang_pred"), F.col("__score").alias("score"))


def keep_identified(docs: DataFrame, rows_per_language: int = ROWS_PER_LANGUAGE, least_score: float = LEAST_SCORE) -> DataFrame:
    """The rows of docs, with all their columns, whose language is one that was learned.

    Dropped are null texts, texts without a letter, and those no language of which has least_score
    after calibration, such as texts in another script. Without any labelled row there is no model
    and all texts that have a letter stay."""
    model = train(docs, rows_per_language)
    if model is None:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    told = (F.col("__lang_pred") != UNKNOWN) & (F.col("__score") >= least_score)
    return predict(docs, model).where(told).select(*[F.col(f"`{c}`") for c in docs.columns])
