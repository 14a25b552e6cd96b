"""Operator 10: exact byte-pair encoding by dynamic programming over prefixes, and decoding."""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import islice

import ahocorasick
import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

VOCABULARY = "byte_bpe_50k.json"
#: Rows taken through the encoder at once, which bounds a task's memory.
ROWS = 256
#: Words and token pairs remembered at most before a memory is emptied, and those that a worker process keeps between tasks.
MEMORY, KEPT = 400_000, 50_000

#: Fixed value: the pattern that splits texts before byte-level merges.
PATTERN = regex.compile(public_tokenizers.PATTERN, regex.V0)


def _byte_letters() -> dict[int, str]:
    """The printable character that stands for each byte in a byte-level vocabulary: printable Latin-1
    stands for itself, the others follow from 256 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Bpe:
    """A byte-level vocabulary file with merges, ready for encoding and decoding."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        letters = _byte_letters()
        of_letter = {c: b for b, c in letters.items()}
        self.special = {x["content"]: x["id"] for x in told["added_tokens"]}
        self.bytes_of: dict[int, bytes] = {}
        self.id_of: dict[bytes, int] = {}
        for token, i in told["model"]["vocab"].items():
            special = token in self.special
            self.bytes_of[i] = token.encode() if special else bytes(of_letter[c] for c in token)
            if not special:
                self.id_of[self.bytes_of[i]] = i
        self.bytes_of |= {i: s.encode() for s, i in self.special.items()}
        self.rank: dict[tuple[int, int], tuple[int, int]] = {}
        raw = lambda s: bytes(of_letter[c] for c in s)
        for r, m in enumerate(told["model"]["merges"]):
            x, y = m if isinstance(m, list) else m.split(" ")
            self.rank[self.id_of[raw(x)], self.id_of[raw(y)]] = (r, self.id_of[raw(x) + raw(y)])
        self.at_special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        # all tokens that end at a place are found by suffix links in one pass over a word
        self.matcher = ahocorasick.Automaton()
        for b, i in self.id_of.items():
            self.matcher.add_word(b.decode("latin-1"), (len(b), i))
        self.matcher.make_automaton()
        self.fits: dict[tuple[int, int], bool] = {}
        self.words = _Words(self)

    def merged(self, word: bytes) -> list[int]:
        """The merges by their definition, lowest rank first; used on a token or two only."""
        ids = [self.id_of[word[i : i + 1]] for i in range(len(word))]
        while len(ids) > 1:
            found = [(self.rank[p][0], i) for i, p in enumerate(zip(ids, ids[1:])) if p in self.rank]
            if not found:
                break
            low = min(found)[0]
            out, i = [], 0
            while i < len(ids):
                p = self.rank.get((ids[i], ids[i + 1])) if i + 1 < len(ids) else None
                if p and p[0] == low:
                    out.append(p[1])
                    i += 2
                else:
                    out.append(ids[i])
                    i += 1
            ids = out
        return ids

    def compatible(self, left: int, right: int) -> bool:
        """Whether left, right is how their joined bytes are encoded; left -1 is a word's begin."""
        if (known := self.fits.get((left, right))) is None:
            if len(self.fits) > MEMORY:
                self.fits.clear()
            joined = (self.bytes_of[left] if left >= 0 else b"") + self.bytes_of[right]
            known = self.fits[left, right] = self.merged(joined) == ([left, right] if left >= 0 else [right])
        return known

    def encode_word(self, word: bytes) -> list[int]:
        """Ids of one word. An encoding is valid just if its neighbours are compatible, and
        every prefix has one valid encoding, so one last token for each prefix is enough."""
        whole = self.id_of.get(word)
        if whole is not None and self.compatible(-1, whole):
            return [whole]
        n = len(word)
        last, back = [-1] * (n + 1), [-1] * (n + 1)
        back[0] = 0
        for end, (size, token) in self.matcher.iter(word.decode("latin-1")):
            begin = end + 1 - size
            if back[begin] >= 0 and last[end + 1] < 0 and self.compatible(last[begin], token):
                last[end + 1], back[end + 1] = token, begin
        ids, at = [], n
        while at:
            ids.append(last[at])
            at = back[at]
        return ids[::-1]

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers."""
        parts = self.at_special.split(text) if self.at_special and any(s in text for s in self.special) else [text]
        return b"".join(
            self.special[part].to_bytes(4, "little") if i % 2 else b"".join(map(self.words.__getitem__, PATTERN.findall(part))) for i, part in enumerate(parts)
        )

    def forget(self) -> None:
        """Keeps the first KEPT words and pairs of each memory, as frequent ones come early: a worker process outlives
        its task, and other operators' tasks follow in it."""
        for memory in (self.words, self.fits):
            kept = dict(islice(memory.items(), KEPT))
            memory.clear()
            memory.update(kept)

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


class _Words(dict):
    """Word -> its ids' bytes, for words seen lately."""

    def __init__(self, bpe: Bpe):
        self.bpe = bpe

    def __missing__(self, word: str) -> bytes:
        if len(self) > MEMORY:
            self.clear()
        out = np.array(self.bpe.encode_word(word.encode("utf-8")), "<u4").tobytes()
        if len(word) < 256:
            self[word] = out
        return out


_LOADED: dict[str, Bpe] = {}


def _load(path: str) -> Bpe:
    """One vocabulary for each worker process."""
    if path not in _LOADED:
        _LOADED[path] = Bpe(path)
    return _LOADED[path]


def encode_decode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, ids (little-endian unsigned 32-bit integers, as binary) and decoded, the text of the ids.

    Every task loads the vocabulary at `path`, by default the installed byte_bpe_50k.json. A
    text is split into words; for each word, all tokens that end at each place come from
    an Aho-Corasick automaton's suffix links; a token is a prefix's last one if it is
    compatible with the last token of the prefix before it; back-pointers give the ids.
    Strings of special tokens in a text become their ids, as the library's default has it.

    Cases: null and empty texts give no ids and an empty decoded text; words of any length
    take time in proportion; null doc_ids and repeated rows each give a row; other columns are
    left aside.
    """
    path = path or public_tokenizers.path(VOCABULARY)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _load(path)
        try:
            for whole in batches:
                for at in range(0, whole.num_rows, ROWS):
                    x = whole.slice(at, ROWS)
                    ids = [bpe.encode(t) if t else b"" for t in x["text"].to_pylist()]
                    yield pa.RecordBatch.from_arrays([x["doc_id"], pa.array(ids, pa.binary()), pa.array(map(bpe.decode, ids), pa.string())], ["doc_id", "ids", "decoded"])
        finally:
            bpe.forget()

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, ids binary, decoded string")
