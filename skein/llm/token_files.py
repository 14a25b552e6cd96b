"""Operator 12: token ids as raw binary shards, with a minimal perfect hash index from document keys to their places.

A folder holds:

* ids-<shard>.bin: the ids of a shard's documents, one after another, as raw little-endian unsigned integers of `width` bytes
* docs-<shard>.bin: where each document begins in it, in ids, as unsigned 64-bit integers, and the end
* index-<part>.mph: a minimal perfect hash over the keys of one part of the hash space, and a record for each key (RECORD)
* manifest.json: width, end id, documents and ids of each shard, keys of each part, and the number of documents without a key

Shards follow each other in ascending order of key. Every file is written under a name of its own and then renamed, so
a task that runs twice leaves the same file.
"""

from __future__ import annotations

import json
import os
import re
import sys
import uuid
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.fs
import regex
from pyspark.sql import DataFrame, SparkSession, functions as F

from skein.llm.bpe import ROWS, VOCABULARY, _byte_letters
from skein.plans.iterate import discard, materialize, shared_folder

END_ID = 0
#: Bytes of text that a shard is to have, about; small tables still get a shard for each shuffle partition.
SHARD_BYTES = 256 << 20
#: Keys of an index part, about; a part is built in one task.
PART_KEYS = 1 << 18
#: Bytes of ids read and given at once, or one document.
BLOCK = 8 << 20
#: Words that a worker remembers the ids of.
MEMORY = 500_000
#: Bits for each key that is still to be placed, at each level of the hash.
GAMMA = 1.5
LEVELS = 64

RECORD = np.dtype([("key", "<u8"), ("offset", "<u8"), ("copies", "<u8"), ("shard", "<u4"), ("row", "<u4"), ("n", "<u4")])
_MAGIC = b"SKEINMPH"


# --- encoding -----------------------------------------------------------------------------------------------


def _splitter(top: int) -> re.Pattern:
    """The vocabulary's splitting pattern for texts of characters under `top`, with their classes spelt out: far faster."""
    every = "".join(chr(x) for x in range(top) if not 0xD800 <= x < 0xE000)

    def ranges(kind: str) -> str:
        return "".join(f"\\U{ord(m[0][0]):08x}-\\U{ord(m[0][-1]):08x}" for m in regex.finditer(kind + "+", every))

    letters, digits, spaces = ranges(r"\p{L}"), ranges(r"\p{N}"), ranges(r"\s")
    # fixed value: the alternatives of the public byte-level splitting pattern
    return re.compile(f"'(?:[sdmt]|ll|ve|re)| ?[{letters}]+| ?[{digits}]+| ?[^{spaces}{letters}{digits}]+|[{spaces}]+(?![^{spaces}])|[{spaces}]+")


class Encoder(dict):
    """A tokenizers file that encodes whole texts; itself it maps words seen so far to their ids' bytes.

    A byte-level vocabulary splits a text into words before any merge, so words are looked up and only new ones go through
    the library's model; texts that hold an added token, and other vocabularies, go through the library whole."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_padding()
        self.library.no_truncation()
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        pre = told.get("pre_tokenizer") or {}
        self.by_words = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not told.get("normalizer") and not told["model"].get("dropout")
        self.added = [x["content"] for x in told["added_tokens"]]
        self.kind = np.dtype("<u2" if self.library.get_vocab_size() <= 1 << 16 else "<u4")
        self.model = self.library.model
        self.letters = _byte_letters()
        self.latin, self.plane = _splitter(0x100), _splitter(0x10000)
        self.ascii = _splitter(0x80)
        self.any = regex.compile(public_tokenizers.PATTERN, regex.V0)

    def __missing__(self, word: str) -> bytes:
        ids = [t.id for t in self.model.tokenize(word.encode().decode("latin-1").translate(self.letters))]
        out = np.array(ids, self.kind).tobytes()
        if len(self) < MEMORY and len(word) < 64:
            self[word] = out
        return out

    def words(self, text: str) -> list[str]:
        if text.isascii():
            return self.ascii.findall(text)
        wide = text.encode("utf-16-le")
        if len(wide) > 2 * len(text):
            return self.any.findall(text)
        return (self.plane if np.frombuffer(wide, np.uint8)[1::2].any() else self.latin).findall(text)

    def encode(self, text: str) -> bytes:
        if not self.by_words or any(x in text for x in self.added):
            return np.array(self.library.encode(text, add_special_tokens=False).ids, self.kind).tobytes()
        return b"".join(map(self.__getitem__, self.words(text)))


_LOADED: dict[str, Encoder] = {}


def _load(path: str) -> Encoder:
    """One encoder for each worker process."""
    if path not in _LOADED:
        _LOADED[path] = Encoder(path)
    return _LOADED[path]


# --- the minimal perfect hash -------------------------------------------------------------------------------


def _mixed(keys: np.ndarray, level: int) -> np.ndarray:
    """Hashes of 64-bit keys, others at each level."""
    x = keys ^ np.uint64((level + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class PerfectHash:
    """Numbers n different 64-bit keys 0 to n - 1. At each level the keys still to be placed hash into a bit array; those that
    are alone at their bit stay, the others go on. A key's number is the count of set bits before its own. About e**(1/GAMMA)
    levels are read for a key on average, however many keys there are."""

    def __init__(self, sizes: list[int], words: np.ndarray, before: np.ndarray):
        self.sizes, self.words, self.before = sizes, words, before

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        sizes, bits = [], []
        while len(keys):
            if len(sizes) == LEVELS:
                raise ValueError("keys that are to be numbered repeat")
            size = -(-int(len(keys) * GAMMA + 1) // 64) * 64
            at = (_mixed(keys, len(sizes)) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            sizes.append(size)
            bits.append(np.packbits(alone, bitorder="little").view("<u8"))
            keys = keys[~alone[at]]
        words = np.concatenate(bits) if bits else np.zeros(0, "<u8")
        before = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)])[: len(words)].astype("<u4")
        return cls(sizes, words, before)

    def numbers(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key; -1, or the number of another key, for one that was not there at building."""
        out = np.full(len(keys), -1, np.int64)
        left, begin = np.arange(len(keys)), 0
        for level, size in enumerate(self.sizes):
            if not len(left):
                break
            at = _mixed(keys[left], level) % np.uint64(size)
            word, bit = begin + (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
            held = self.words[word]
            here = (held >> bit) & np.uint64(1) == 1
            low = held & ((np.uint64(1) << bit) - np.uint64(1))
            out[left[here]] = (self.before[word] + np.bitwise_count(low))[here]
            left, begin = left[~here], begin + size // 64
        return out


def _index_file(keys: np.ndarray, records: np.ndarray) -> bytes:
    """An index part: the hash, and the records in the order of their numbers."""
    found = PerfectHash.build(keys)
    ordered = np.empty(len(keys), RECORD)
    ordered[found.numbers(keys)] = records
    head = np.array([len(keys), len(found.sizes), *found.sizes], "<u8")
    return _MAGIC + head.tobytes() + found.words.astype("<u8").tobytes() + found.before.tobytes() + ordered.tobytes()


def _read_index(raw: bytes) -> tuple[PerfectHash, np.ndarray]:
    if raw[:8] != _MAGIC:
        raise ValueError("not an index part")
    n, levels = (int(x) for x in np.frombuffer(raw, "<u8", 2, 8))
    sizes = [int(x) for x in np.frombuffer(raw, "<u8", levels, 24)]
    words = sum(sizes) // 64
    at = 24 + 8 * levels
    found = PerfectHash(sizes, np.frombuffer(raw, "<u8", words, at), np.frombuffer(raw, "<u4", words, at + 8 * words))
    return found, np.frombuffer(raw, RECORD, n, at + 12 * words)


def _looked_up(index: tuple[PerfectHash, np.ndarray], keys: np.ndarray) -> np.ndarray:
    """Each key's record; one of 0 copies if it is not there. The stored fingerprint is the whole of a key's hash, which is different
    for different keys, so the answer is exact."""
    found, records = index
    out = np.zeros(len(keys), RECORD)
    number = found.numbers(keys)
    some = np.flatnonzero(number >= 0)
    hit = records[number[some]]
    right = hit["key"] == keys[some]
    out[some[right]] = hit[right]
    return out


# --- files --------------------------------------------------------------------------------------------------


def _opened(folder: str) -> tuple[pa.fs.FileSystem, str]:
    """The file system of a shared folder and the folder's path in it."""
    folder = re.sub(r"^file:/+", "file:///", folder)
    return pa.fs.FileSystem.from_uri(re.sub(r"^s3[an]:", "s3:", folder) if ":" in folder else f"file://{os.path.abspath(folder)}")


class _Writing:
    """A file that gets its name when it is whole."""

    def __init__(self, fs: pa.fs.FileSystem, name: str):
        self.fs, self.name, self.own = fs, name, f"{name}.{uuid.uuid4().hex}"
        self.out = fs.open_output_stream(self.own)

    def close(self) -> None:
        self.out.close()
        try:
            self.fs.move(self.own, self.name)
        except OSError:
            # another attempt of this task was first, and its file has the same bytes
            if self.fs.get_file_info(self.name).size != self.fs.get_file_info(self.own).size:
                raise
            self.fs.delete_file(self.own)


def _put(fs: pa.fs.FileSystem, name: str, data: bytes) -> None:
    f = _Writing(fs, name)
    f.out.write(data)
    f.close()


def _get(fs: pa.fs.FileSystem, name: str, begin: int = 0, size: int | None = None) -> bytes:
    with fs.open_input_file(name) as f:
        f.seek(begin)
        return f.read(size)


def _groups(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[tuple[int, list[pa.RecordBatch]]]:
    """Rows sorted by a column, as (value, batches) of each value."""
    value, held = None, []
    for x in batches:
        v = x[column].to_numpy()
        for a, b in zip(edges := [0, *(np.flatnonzero(np.diff(v)) + 1).tolist()], [*edges[1:], len(v)]):
            if a == b:
                continue
            if held and v[a] != value:
                yield value, held
                held = []
            value = int(v[a])
            held.append(x.slice(a, b - a))
    if held:
        yield value, held


def _keyed(keys: DataFrame, parts: int) -> DataFrame:
    """doc_id, hash and part. Spark's hash of a 64-bit integer is a permutation of all of them, so it stands for the key."""
    return keys.withColumn("hash", F.xxhash64("doc_id")).withColumn("part", F.when(F.col("doc_id").isNull(), 0).otherwise(F.pmod("hash", F.lit(parts))).cast("int"))


def write_token_files(docs: DataFrame, folder: str | None = None, path: str | None = None, end_id: int = END_ID, shard_bytes: int = SHARD_BYTES) -> TokenFiles:
    """Write the ids of every text of docs (doc_id, an integer; text), end_id after each, in ascending order of doc_id, and the index.

    folder must be shared by driver and executors; by default a new one in the cluster's checkpoint folder. Texts are dealt out by
    ranges of (doc_id, place in the input), so a doc_id that many rows have spreads over shards. Each task encodes
    its texts in order, writes its shard and gives the places; the index is built of these by parts of the hash space, each
    of about PART_KEYS keys. The driver sees one row for each shard and each part.

    Cases: null and empty texts have the end id alone; documents without doc_id come first and are found under the key
    null; repeated doc_ids lie next to each other, in the order of the input, and are found together; an
    empty table gives a manifest alone; doc_ids that are no integers raise ValueError; other columns are left aside.
    """
    spark = docs.sparkSession
    if docs.schema["doc_id"].dataType.simpleString() not in ("tinyint", "smallint", "int", "bigint"):
        raise ValueError("doc_id must be an integer")
    path = path or public_tokenizers.path(VOCABULARY)
    folder = folder or f"{shared_folder(spark)}/tokens-{uuid.uuid4().hex}"
    fs, root = _opened(folder)
    fs.create_dir(root, recursive=True)
    with open(path, encoding="utf-8") as f:
        told = json.load(f)
    width = 2 if max([*told["model"]["vocab"].values(), *[x["id"] for x in told["added_tokens"]], end_id]) < 1 << 16 else 4
    kind = np.dtype(f"<u{width}")
    end = np.array([end_id], kind).tobytes()

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _opened(folder)
        encoder, out = _load(path), None
        encode = encoder.encode if encoder.kind == kind else lambda t: np.frombuffer(encoder.encode(t), encoder.kind).astype(kind).tobytes()
        for whole in batches:
            for first in range(0, whole.num_rows, ROWS):
                x = whole.slice(first, ROWS)
                if out is None:
                    shard, row, at = x["shard"][0].as_py(), 0, 0
                    out, begins = _Writing(fs, f"{root}/ids-{shard:06d}.bin"), _Writing(fs, f"{root}/docs-{shard:06d}.bin")
                ids = [encode(t) + end if t else end for t in x["text"].to_pylist()]
                n = np.array([len(i) // width for i in ids], np.int64)
                begin = at + np.cumsum(n) - n
                out.out.write(b"".join(ids))
                begins.out.write(begin.astype("<u8").tobytes())
                rows = pa.array(np.arange(row, row + len(ids), dtype=np.int32))
                yield pa.RecordBatch.from_arrays([x["doc_id"], x["shard"], rows, pa.array(begin), pa.array(n)], ["doc_id", "shard", "row", "offset", "n"])
                row, at = row + len(ids), at + int(n.sum())
        if out is not None:
            begins.out.write(np.array([at], "<u8").tobytes())
            out.close()
            begins.close()

    size = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // shard_bytes))
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.monotonically_increasing_id().alias("place"))
    ordered = narrow.repartitionByRange(shards, "doc_id", "place").sortWithinPartitions("doc_id", "place").select("doc_id", F.spark_partition_id().alias("shard"), "text")
    places = materialize(ordered.mapInArrow(written, "doc_id long, shard int, row int, offset long, n long"))
    totals = {r.shard: (r.docs, r.ids, r.bare) for r in places.groupBy("shard").agg(F.count("*").alias("docs"), F.sum("n").alias("ids"), F.count_if(F.col("doc_id").isNull()).alias("bare")).collect()}
    count, bare = (sum(t[i] for t in totals.values()) for i in (0, 2))
    parts = -(-count // PART_KEYS)

    def indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _opened(folder)
        for part, held in _groups(batches, "part"):
            rows = pa.Table.from_batches(held)
            records = np.empty(rows.num_rows, RECORD)
            records["key"] = keys = rows["hash"].to_numpy().astype(np.int64).view(np.uint64)
            for name in ("offset", "copies", "shard", "row", "n"):
                records[name] = rows[name].to_numpy()
            _put(fs, f"{root}/index-{part:06d}.mph", _index_file(keys, records))
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([len(keys)], pa.int64())], ["part", "keys"])

    built: dict[int, int] = {}
    if count > bare:
        first = places.where("doc_id is not null").groupBy("doc_id").agg(F.min(F.struct("shard", "row", "offset", "n")).alias("f"), F.count("*").alias("copies"))
        keyed = _keyed(first, parts).select("hash", "part", "f.*", "copies")
        built = dict(map(tuple, keyed.repartition(parts, "part").sortWithinPartitions("part").mapInArrow(indexed, "part int, keys long").collect()))
    discard(places)
    last = max(totals, default=-1) + 1
    manifest = {"format": "skein-token-files", "version": 1, "width": width, "end_id": end_id, "keyless": bare, "shards": [list(totals.get(s, (0, 0))[:2]) for s in range(last)], "parts": [built.get(p, 0) for p in range(parts)]}
    _put(fs, f"{root}/manifest.json", json.dumps(manifest).encode())
    return TokenFiles(spark, folder)


def _runs(docs: np.ndarray, shard: int, row: int, copies: int) -> Iterator[tuple[int, int, int]]:
    """The documents from a place on, as (shard, row, documents) of each shard that holds some; docs are the shards' documents."""
    while copies:
        here = min(copies, int(docs[shard]) - row)
        if here:
            yield shard, row, here
        shard, row, copies = shard + 1, 0, copies - here


class TokenFiles:
    """A folder of token files, opened by its manifest."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        fs, root = _opened(folder)
        told = json.loads(_get(fs, f"{root}/manifest.json"))
        if told.get("format") != "skein-token-files" or told.get("version") != 1:
            raise ValueError(f"{folder} holds no token files of this version")
        self.width, self.end_id, self.keyless, self.parts = told["width"], told["end_id"], told["keyless"], told["parts"]
        shards = np.array(told["shards"], np.int64).reshape(-1, 2)
        self.docs = shards[:, 0]
        self.base = np.concatenate([[0], np.cumsum(shards[:, 1])])

    def locate(self, keys: DataFrame) -> DataFrame:
        """doc_id, shard, row, docs: where the documents of each different doc_id of keys lie; keys that are not there give no row.
        Keys go to the tasks of their index parts; a key costs a few bit tests and one record."""
        folder, parts, sizes, held_docs, keyless = self.folder, max(1, len(self.parts)), self.parts, self.docs, self.keyless

        def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            fs, root = _opened(folder)
            for part, held in _groups(batches, "part"):
                index = _read_index(_get(fs, f"{root}/index-{part:06d}.mph")) if part < len(sizes) and sizes[part] else None
                for x in held:
                    ids = x["doc_id"].to_pylist()
                    record = _looked_up(index, x["hash"].to_numpy().view(np.uint64)) if index else np.zeros(len(ids), RECORD)
                    for i in [i for i, d in enumerate(ids) if d is None]:
                        record[i] = (0, 0, keyless, 0, 0, 0)
                    out = [(d, *run) for d, s, r, c in zip(ids, record["shard"].tolist(), record["row"].tolist(), record["copies"].tolist()) for run in _runs(held_docs, s, r, c)]
                    d, s, r, c = zip(*out) if out else ((), (), (), ())
                    yield pa.RecordBatch.from_arrays([pa.array(d, pa.int64()), pa.array(s, pa.int32()), pa.array(r, pa.int32()), pa.array(c, pa.int64())], ["doc_id", "shard", "row", "docs"])

        asked = _keyed(keys.select(F.col("doc_id").cast("long").alias("doc_id")).distinct(), parts)
        return asked.repartition(parts, "part").sortWithinPartitions("part").mapInArrow(found, "doc_id long, shard int, row int, docs long")

    def fetch(self, keys: DataFrame) -> DataFrame:
        """doc_id, start (ids of all documents before it), n_tokens, and ids (little-endian unsigned 32-bit integers, as binary) of
        every document under the doc_ids of keys. Places are dealt out by shard; places next to each other are read at once."""
        folder, width, base, kind = self.folder, self.width, self.base, np.dtype(f"<u{self.width}")

        def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            fs, root = _opened(folder)
            for shard, held in _groups(batches, "shard"):
                with fs.open_input_file(f"{root}/ids-{shard:06d}.bin") as ids, fs.open_input_file(f"{root}/docs-{shard:06d}.bin") as begins:
                    for x in held:
                        row, docs = x["row"].to_numpy().astype(np.int64), x["docs"].to_numpy()
                        cut = np.flatnonzero(row[1:] != row[:-1] + docs[:-1]) + 1
                        for a, b in zip([0, *cut.tolist()], [*cut.tolist(), len(row)]):
                            begins.seek(8 * int(row[a]))
                            edge = np.frombuffer(begins.read(8 * (int(row[b - 1] + docs[b - 1] - row[a]) + 1)), "<u8").astype(np.int64)
                            doc_id = x["doc_id"].slice(a, b - a).take(pa.array(np.repeat(np.arange(b - a), docs[a:b])))
                            at = 0
                            while at < len(edge) - 1:
                                stop = max(at + 1, int(np.searchsorted(edge, edge[at] + BLOCK // 4, "right")) - 1)
                                ids.seek(int(edge[at]) * width)
                                raw = np.frombuffer(ids.read(int(edge[stop] - edge[at]) * width), kind).astype("<u4")
                                ends = (edge[at : stop + 1] - edge[at]) * 4
                                got = pa.LargeBinaryArray.from_buffers(pa.large_binary(), stop - at, [None, pa.py_buffer(np.ascontiguousarray(ends)), pa.py_buffer(raw)]).cast(pa.binary())
                                yield pa.RecordBatch.from_arrays([doc_id.slice(at, stop - at), pa.array(base[shard] + edge[at:stop]), pa.array(np.diff(edge[at : stop + 1])), got], ["doc_id", "start", "n_tokens", "ids"])
                                at = stop

        places = self.locate(keys)
        return places.repartition(max(1, len(self.docs)), "shard").sortWithinPartitions("shard", "row").mapInArrow(read, "doc_id long, start long, n_tokens long, ids binary")

    def get(self, doc_id: int) -> list[np.ndarray]:
        """The ids of each document under one key, read by the index without a Spark job: parts of three files, whose sizes do not
        depend on how many documents there are."""
        import xxhash

        fs, root = _opened(self.folder)
        key = np.array([xxhash.xxh64_intdigest(doc_id.to_bytes(8, sys.byteorder, signed=True), 42)], np.uint64)
        part = int(key.view(np.int64)[0]) % max(1, len(self.parts))
        if not self.parts or not self.parts[part]:
            return []
        r = _looked_up(_read_index(_get(fs, f"{root}/index-{part:06d}.mph")), key)[0]
        out = []
        for shard, row, docs in _runs(self.docs, int(r["shard"]), int(r["row"]), int(r["copies"])):
            edge = np.frombuffer(_get(fs, f"{root}/docs-{shard:06d}.bin", 8 * row, 8 * (docs + 1)), "<u8").astype(np.int64)
            raw = np.frombuffer(_get(fs, f"{root}/ids-{shard:06d}.bin", int(edge[0]) * self.width, int(edge[-1] - edge[0]) * self.width), f"<u{self.width}")
            out += [raw[a:b] for a, b in zip((edge[:-1] - edge[0]).tolist(), (edge[1:] - edge[0]).tolist())]
        return out
