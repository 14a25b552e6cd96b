"""Operator 11: fill-in-the-middle transformation, cut by whole batches on Arrow buffers, and its inverse."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

#: Seed, and the percentages of texts transformed and, of these, written suffix first.
SEED, RATE, SPM_RATE = 7, 100, 50
#: Bytes of text that a kernel call takes at once (one longer text goes alone), which bounds a task's memory.
BLOCK = 8 << 20
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"

_NEWLINE, _INSIDE, _OPEN = 1, 2, 4
#: The class of each byte: a line's end, a byte inside a character, a sentinel's first byte.
_CLASS = np.zeros(256, np.uint8)
_CLASS[ord("\n")], _CLASS[0x80:0xC0], _CLASS[ord("<")] = _NEWLINE, _INSIDE, _OPEN


def _buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a column of texts; null is empty."""
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    _, at, data = texts.buffers()
    offsets = np.frombuffer(at, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def _characters(classes: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Code points of each of the byte ranges, which follow one another."""
    out = np.zeros(len(begin), np.int64)
    some = np.flatnonzero(end > begin)
    if len(some):
        lead = ((classes & _INSIDE) == 0).view(np.uint8)
        edges = np.stack([begin[some], end[some]], 1).ravel()
        sums = np.add.reduceat(np.append(lead, np.uint8(0)), edges, dtype=np.int64)
        out[some] = sums[::2]
    return out


def _sentinels(data: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Where a sentinel begins. Its three bytes lie in one text if no text ends among them, which the caller sees to."""
    at = np.flatnonzero(classes == _OPEN)
    at = at[at + 2 < len(data)]
    second = data[at + 1]
    return at[(data[at + 2] == ord(">")) & ((second == ord("P")) | (second == ord("S")) | (second == ord("M")))]


def _joined(pieces: list, ends: np.ndarray) -> pa.Array:
    """A column of texts from the pieces of all rows in order and each row's end."""
    return pa.LargeStringArray.from_buffers(len(ends) - 1, pa.py_buffer(np.ascontiguousarray(ends, np.int64)), pa.py_buffer(b"".join(pieces))).cast(pa.string())


def transform_block(texts: pa.Array, hashes: np.ndarray, rate: int = RATE, spm_rate: int = SPM_RATE) -> pa.RecordBatch:
    """Transform a column of texts; hashes is (4, rows). All rows are cut together: bytes are classed by a table, ends of lines
    and of texts are marked, the marks' running sum, less its value at a text's begin, counts a text's lines, and
    one binary search in it finds every cut."""
    data, at = _buffers(texts)
    begin, end = at[:-1], at[1:]
    classes = _CLASS[data]
    mark = (classes & _NEWLINE).view(np.bool_)
    mark[end[end > begin] - 1] = True  # a text's last byte ends its last line
    run = np.zeros(len(data) + 1, np.int32 if len(data) < 1 << 31 else np.int64)
    np.cumsum(mark, out=run[1:])
    base = run[begin].astype(np.int64)
    n = run[end] - base
    h = hashes.astype(np.int64)
    first, second = h[0] % (n + 1), h[1] % (n + 1)
    cuts = np.searchsorted(run, np.stack([base + np.minimum(first, second), base + np.maximum(first, second)]).astype(run.dtype), "left")
    cuts = np.clip(cuts, begin, end)  # no cut before a text's first byte
    del run, mark

    found = _sentinels(data, classes)
    owner = np.searchsorted(end, found, "right")
    found_in = owner[found + 2 < end[owner]] if len(found) else owner
    plain = (end == begin) | (h[2] % 100 >= rate)
    plain[found_in] = True
    spm = ~plain & (h[3] % 100 < spm_rate)

    size = end - begin + np.where(plain, 0, len(PREFIX) + len(SUFFIX) + len(MIDDLE))
    ends = np.concatenate([[0], np.cumsum(size)])
    raw, pieces = memoryview(np.ascontiguousarray(data)), []
    for a, x, y, b, kind in zip(begin.tolist(), cuts[0].tolist(), cuts[1].tolist(), end.tolist(), np.where(plain, 0, np.where(spm, 1, 2)).tolist()):
        if kind == 0:
            pieces.append(raw[a:b])
        elif kind == 1:
            pieces += (SUFFIX, raw[y:b], PREFIX, raw[a:x], MIDDLE, raw[x:y])
        else:
            pieces += (PREFIX, raw[a:x], SUFFIX, raw[y:b], MIDDLE, raw[x:y])
    return pa.RecordBatch.from_arrays(
        [
            pa.array(n.astype(np.int64)),
            pa.array(np.where(plain, "plain", np.where(spm, "spm", "psm")).tolist(), pa.string()),
            pa.array(_characters(classes, begin, cuts[0]), mask=plain),
            pa.array(_characters(classes, cuts[0], cuts[1]), mask=plain),
            _joined(pieces, ends),
        ],
        ["n", "form", "prefix_chars", "middle_chars", "output"],
    )


def restore_block(outputs: pa.Array, forms: pa.Array) -> pa.Array:
    """The texts that outputs of the given forms were made of. The text holds no sentinel if its form is not plain, so the three that
    are found are the ones put in."""
    data, at = _buffers(outputs)
    form = np.array(forms.to_pylist(), object)
    cut = form != "plain"
    found = _sentinels(data, _CLASS[data])
    owner = np.searchsorted(at[1:], found, "right")
    kept = cut[owner] & (found + 2 < at[1:][owner]) if len(found) else np.zeros(0, bool)
    found, owner = found[kept], owner[kept]
    if len(found) != 3 * cut.sum() or (np.bincount(owner, minlength=len(form))[cut] != 3).any():
        raise ValueError("an output does not have the three marks of its form")
    marks = np.zeros((len(form), 3), np.int64)
    marks[cut] = found.reshape(-1, 3)
    raw, pieces = memoryview(np.ascontiguousarray(data)), []
    for a, b, kind, (_, x, y) in zip(at[:-1].tolist(), at[1:].tolist(), form, marks.tolist()):
        if kind == "plain":
            pieces.append(raw[a:b])
        elif kind == "psm":
            pieces += (raw[a + 3 : x], raw[y + 3 : b], raw[x + 3 : y])
        else:
            pieces += (raw[x + 3 : y], raw[y + 3 : b], raw[a + 3 : x])
    size = np.diff(at) - np.where(cut, 9, 0)
    return _joined(pieces, np.concatenate([[0], np.cumsum(size)]))


def _blocks(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose texts have BLOCK bytes at most, or one row."""
    sizes = batch[column].cast(pa.large_binary())
    ends = np.cumsum(np.diff(np.frombuffer(sizes.buffers()[1], np.int64)[sizes.offset : sizes.offset + len(sizes) + 1])) if len(sizes) else np.zeros(0)
    at = 0
    while at < len(ends):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + BLOCK, "right")))
        yield batch.slice(at, stop - at)
        at = stop


def _hash(doc_id: Column, seed: int, i: int) -> Column:
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    return F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long")


def transform(docs: DataFrame, seed: int = SEED, rate: int = RATE, spm_rate: int = SPM_RATE) -> DataFrame:
    """doc_id, n (lines), form, prefix_chars, middle_chars and output: every text of docs (doc_id, text) cut at two line ends.

    Lines end after their \\n. The cuts are after h1 % (n + 1) and h2 % (n + 1) lines, the smaller first; h1 to h4 are the
    first four groups of eight digits of the SHA-256 of `<seed>:<doc_id>`, so a row does not depend on others, on
    partitions or on repetition. h3 % 100 < rate transforms, then h4 % 100 < spm_rate puts the suffix first.
    Nothing is shuffled; a task holds about BLOCK bytes of text, or one text, at once, and some eight times that besides.

    Cases: null is an empty text; empty texts and those that hold a sentinel stay as they are (plain, with null
    prefix_chars and middle_chars, n still being their lines); a null doc_id is hashed as no digits; repeated rows each
    give the same row; other columns, whatever their names, are left aside; no rows give no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for x in _blocks(whole, "text"):
                done = transform_block(x["text"], np.stack([x[f"h{i}"].to_numpy(zero_copy_only=False) for i in range(4)]), rate, spm_rate)
                yield pa.RecordBatch.from_arrays([x["doc_id"], *done.columns], ["doc_id", *done.schema.names])

    kind = docs.schema["doc_id"].dataType.simpleString()
    narrow = docs.select("doc_id", "text", *[_hash(F.col("doc_id"), seed, i).alias(f"h{i}") for i in range(4)])
    return narrow.mapInArrow(run, f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output string")


def restore(done: DataFrame) -> DataFrame:
    """The columns of transform() and `text`, rebuilt from output and form alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for x in _blocks(whole, "output"):
                yield pa.RecordBatch.from_arrays([*x.columns, restore_block(x["output"], x["form"])], [*x.schema.names, "text"])

    kept = done.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output")
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept.schema.fields)
    return kept.mapInArrow(run, f"{kinds}, text string")
