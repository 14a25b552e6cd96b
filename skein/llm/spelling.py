"""Operator 13: spelling variants grouped by a pigeonhole join over even parts of words, and forms chosen by count."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from skein.plans.iterate import NotSettled, discard, materialize

#: Words of so many code points and occurrences take part; a form has so many times the occurrences of its variant.
LEAST_LENGTH, LEAST_COUNT, RATIO = 6, 5, 5
#: A run whose checksum this divides loses a letter.
MODULUS = 199
#: Fixed value: the letters of a run.
RUN = r"[A-Za-zÀ-ÿ]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, modulus: int = MODULUS) -> DataFrame:
    """word, n: maximal runs of letters of all texts (doc_id, text), A-Z lower-cased, counted over all documents.

    A run of a document whose CRC-32 of `<doc_id>:<run>` `modulus` divides loses its code point at checksum % length. Runs are
    counted in their task before any shuffle, so a very common word is no hot key."""
    run = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("__id"), F.explode(F.regexp_extract_all("text", F.lit(RUN), F.lit(0))).alias("w")).where(F.length("w") >= least_length)
    plain = F.length("w") == F.octet_length("w")  # of ASCII alone: a faster way to the same
    run = run.select("__id", F.when(plain, F.lower("w")).otherwise(F.translate("w", _UPPER, _LOWER)).alias("w"))
    run = run.select("w", F.crc32(F.encode(F.concat("__id", F.lit(":"), "w"), "UTF-8")).alias("h"))
    at = (F.col("h") % F.length("w")).cast("int")
    kept = F.concat(F.substr("w", F.lit(1), at), F.substr("w", at + 2))
    word = run.select(F.when(F.col("h") % modulus == 0, kept).otherwise(F.col("w")).alias("word")).where(F.length("word") >= least_length)
    return word.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


def _part(word: Column, i: int, size: Column, shift: int = 0) -> Column:
    """Part i of the two even parts of a word of `size` letters, read `shift` letters further on."""
    first = F.floor(size / 2).cast("int")
    return F.substr(word, F.lit(1 + shift), first) if i == 0 else F.substr(word, first + 1 + shift, size - first)


def near_pairs(words: DataFrame) -> DataFrame:
    """a, na, b, nb: pairs of words (word, n; words differ) one inserted, deleted or replaced code point apart, each pair once.

    A word of length l is indexed under its first l div 2 letters and under the rest, with l. One edit leaves one of both parts as it
    is: so a word meets others of its length under its own two parts, and those one shorter under the part of their
    length at its begin and, one letter further on, at its end. What meets is compared letter by letter in the join
    itself, so that only true pairs leave it; a join on a part that very many words share is split by adaptive execution."""
    size = F.length("word")
    index = words.select("word", "n", F.inline(F.array(*[F.struct(size.alias("l"), F.lit(i).alias("i"), _part(F.col("word"), i, size).alias("part")) for i in (0, 1)])))
    shorter = [F.struct((size - 1).alias("l"), F.lit(i).alias("i"), _part(F.col("word"), i, size - 1, shift=i).alias("part")) for i in (0, 1)]
    probe = words.select("word", "n", F.inline(F.array(*shorter))).select(F.col("word").alias("b"), F.col("n").alias("nb"), "l", "i", "part")
    own = index.select(F.col("word").alias("b"), F.col("n").alias("nb"), "l", "i", "part")
    held = index.select(F.col("word").alias("a"), F.col("n").alias("na"), "l", "i", "part")
    one = F.levenshtein("a", "b", 1) == 1
    same = held.join(own, ["l", "i", "part"]).where((F.col("a") < F.col("b")) & one)
    longer = held.join(probe, ["l", "i", "part"]).where(one)
    return same.union(longer).select("a", "na", "b", "nb").distinct()


def roots(forms: DataFrame, max_rounds: int = 64) -> DataFrame:
    """word, root: the last word that following forms (word, form; no cycles) leads to. Each round doubles the steps taken."""
    to = materialize(forms.select("word", F.col("form").alias("root")))
    for _ in range(max_rounds):
        on = materialize(to.join(to.select(F.col("word").alias("root"), F.col("root").alias("next")), "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        discard(to)
        to = on
        if to.where("moved").isEmpty():
            return to.select("word", "root")
    raise NotSettled(f"forms still lead on after {max_rounds} doublings")


def spelling_variants(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, ratio: int = RATIO, modulus: int = MODULUS) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of docs (doc_id, text): n_near words are one edit away; form is the one
    of them with the largest n (the smallest of equals), if that is `ratio` times the word's own n or more; root is
    where following forms ends. Counts grow by `ratio` along forms, so there are no cycles and few steps.

    The words are counted into a table; pairs join parts of words; nothing gathers the words of a group.

    Cases: null and empty texts have no words; a null doc_id is written as no digits; repeated rows count each; a run of
    any length is one word; characters outside the stated ranges, composed or not, end a run; other columns, whatever their
    names, are left aside; no words give no rows; a word without near words has n_near 0, null form and form_n, and is
    its own root.
    """
    words = materialize(words_of(docs, least_length, least_count, modulus))
    pairs = near_pairs(words)
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("other"), F.col("nb").alias("m")).union(pairs.select("b", "a", "na"))
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), "other")).alias("best"))
    chosen = words.join(best, "word", "left").withColumn("fits", -F.col("best.m") >= ratio * F.col("n"))
    out = materialize(chosen.select("word", F.when(F.col("fits"), F.col("best.other")).alias("form"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(F.col("fits"), -F.col("best.m")).alias("form_n")))
    discard(words)
    ends = roots(out.where("form is not null"))
    return out.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
