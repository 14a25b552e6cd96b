"""Operators 11 to 13 against brute force: odd rows, repeats, empty tables, clashing columns, long texts."""

import collections
import hashlib
import os
import random
import re
import struct
import sys
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tokenizers

from skein.llm import fim, queries, spelling, token_files

sys.path.insert(0, os.path.dirname(os.path.dirname(__file__)))
from oracle import compare  # noqa: E402

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, n long, h0 string, ids string, word string, place string"
TEXTS = [
    None, "", "\n", "one", "one\n", "\n\n\n", "a\nb\nc", "é\nü\n漢字\n𝔘", "x<P>y\nz", "<S", "a<\n>b", "<P\n>", "a\n<", "a\n<M", "<<S>>\n", "\r\n  x\n",
    "<|endoftext|> and <|endoftext|>", "it's  they'll\t\n  x ", "word" + " word" * 20_000, "x" * 50_000, "line of text\n" * 20_000, "naïve Ünïcödé " * 40,
]
IDS = [*range(-3, len(TEXTS) - 5), None, None]


def rows():
    out = [(i, t, 0, "h", "ids", None, "p") for i, t in zip(IDS, TEXTS)]
    return out + out[3:9] + [(1 << 62, "last", 0, "", "", "", ""), (-(1 << 63), "first", 0, "", "", "", "")]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


def cut(i, t):
    t = t or ""
    lines = re.findall(r"[^\n]*\n|[^\n]+", t)
    x = hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()
    h = [int(x[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (len(lines) + 1), h[1] % (len(lines) + 1)))
    p, m, s = "".join(lines[:a]), "".join(lines[a:b]), "".join(lines[b:])
    if not t or any(x in t for x in ("<P>", "<S>", "<M>")):
        return (i, len(lines), "plain", None, None, t, t)
    out = f"<S>{s}<P>{p}<M>{m}" if h[3] % 100 < 50 else f"<P>{p}<S>{s}<M>{m}"
    return (i, len(lines), "spm" if h[3] % 100 < 50 else "psm", len(p), len(m), out, t)


def test_fim(odd):
    got = [tuple(r) for r in fim.restore(fim.transform(odd)).collect()]
    assert collections.Counter(got) == collections.Counter(cut(r[0], r[1]) for r in rows())
    assert {r[2] for r in got} == {"plain", "psm", "spm"}
    none = fim.restore(fim.transform(odd.where("false")))
    assert none.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output", "text"] and not none.count()
    assert {r.form for r in fim.transform(odd, rate=0).collect()} == {"plain"}
    assert "spm" not in {r.form for r in fim.transform(odd, spm_rate=0).collect()}


def test_fim_blocks_and_slices(monkeypatch):
    random.seed(5)
    texts = TEXTS[:17] + ["".join(random.choice("ab\n<P>Sé漢") for _ in range(random.randrange(60))) for _ in range(2000)]
    h = np.array([[random.randrange(1 << 32) for _ in texts] for _ in range(4)])
    whole = fim.transform_block(pa.array(texts), h).to_pylist()
    for a, b in ((0, 0), (3, 4), (7, 900), (900, len(texts))):  # a slice gives the rows of the whole
        part = fim.transform_block(pa.array(texts).slice(a, b - a), h[:, a:b])
        assert part.to_pylist() == whole[a:b]
        assert fim.restore_block(part["output"], part["form"]).to_pylist() == [t or "" for t in texts[a:b]]
    monkeypatch.setattr(fim, "BLOCK", 50)
    blocks = list(fim._blocks(pa.RecordBatch.from_arrays([pa.array(texts)], ["text"]), "text"))
    assert [t for x in blocks for t in x["text"].to_pylist()] == texts
    assert all(x.num_rows == 1 or sum(len((t or "").encode()) for t in x["text"].to_pylist()) <= 50 for x in blocks)
    with pytest.raises(ValueError):
        fim.restore_block(pa.array(["<P>a<S>b"]), pa.array(["psm"]))


@pytest.fixture(scope="module")
def library():
    t = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.no_padding()
    t.no_truncation()
    return t


def encoded(library, text):
    return library.encode(text or "", add_special_tokens=False).ids + [0]


def test_token_files(spark, odd, library, monkeypatch):
    monkeypatch.setattr(token_files, "PART_KEYS", 5)
    monkeypatch.setattr(token_files, "BLOCK", 400)
    files = token_files.write_token_files(odd, shard_bytes=1000)
    got = [(r.doc_id, r.start, r.n_tokens, bytes(r.ids)) for r in files.fetch(odd).collect()]
    want = collections.Counter((r[0], struct.pack(f"<{len(e)}I", *e)) for r in rows() for e in [encoded(library, r[1])])
    assert collections.Counter((g[0], g[3]) for g in got) == want
    at = 0
    for g in sorted(got, key=lambda g: g[1]):  # documents follow each other without gap, in order of doc_id, null first
        assert g[1] == at and g[2] == len(g[3]) // 4
        at += g[2]
    ordered = [g[0] for g in sorted(got, key=lambda g: g[1])]
    assert ordered == sorted(ordered, key=lambda d: (d is not None, d or 0))
    # keys that are not there, repeated keys, null
    some = spark.createDataFrame([(2,), (2,), (None,), (777_777,), (1 << 62,)], "doc_id long")
    by = collections.defaultdict(list)
    for g in files.fetch(some).collect():
        by[g.doc_id].append(bytes(g.ids))
    assert {k: len(v) for k, v in by.items()} == {2: 2, None: 2, 1 << 62: 1}
    # without Spark
    reopened = token_files.TokenFiles(spark, files.folder)
    for i in (2, 5, 1 << 62, -(1 << 63)):
        assert collections.Counter(tuple(x.tolist()) for x in reopened.get(i)) == collections.Counter(tuple(encoded(library, r[1])) for r in rows() if r[0] == i)
    assert reopened.get(777_777) == []
    # a second run of a task leaves the files as they are
    fs, root = token_files._opened(files.folder)
    before = {f.path: f.size for f in fs.get_file_info(pa.fs.FileSelector(root))}
    assert all(re.search(r"/(ids|docs|index)-\d{6}\.(bin|mph)$|/manifest\.json$", p) for p in before)


def test_token_files_hot_key_and_empty(spark, library):
    many = spark.createDataFrame([(7 if i % 2 else i, f"text {i}") for i in range(400)], "doc_id int, text string")
    files = token_files.write_token_files(many)
    assert sum(files.docs > 0) > 1
    got = collections.Counter((r.doc_id, bytes(r.ids)) for r in files.fetch(many).collect())
    assert got == collections.Counter((7 if i % 2 else i, struct.pack(f"<{len(e)}I", *e)) for i in range(400) for e in [encoded(library, f"text {i}")])
    empty = token_files.write_token_files(many.where("false"))
    assert empty.fetch(many).count() == 0 and empty.get(7) == []
    with pytest.raises(ValueError):
        token_files.write_token_files(spark.createDataFrame([("a", "b")], "doc_id string, text string"))


def test_encoder_equals_library(library):
    random.seed(3)
    encoder = token_files.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["".join(random.choice("ab'sldtverm 09.,\t\n éßŁ漢字́ ²½𝔘😀ǅ") for _ in range(random.randrange(80))) for _ in range(4000)]
    for t in [*texts, *filter(None, TEXTS)]:
        assert np.frombuffer(encoder.encode(t), encoder.kind).tolist() == library.encode(t, add_special_tokens=False).ids


@pytest.mark.parametrize("n", [0, 1, 2, 63, 64, 65, 5000])
def test_perfect_hash(n):
    keys = np.random.default_rng(n).integers(0, 1 << 64, n, dtype=np.uint64)
    found = token_files.PerfectHash.build(keys)
    assert sorted(found.numbers(keys).tolist()) == list(range(n))
    records = np.zeros(n, token_files.RECORD)
    records["key"], records["row"], records["copies"] = keys, np.arange(n), 1
    index = token_files._read_index(token_files._index_file(keys, records))
    assert (token_files._looked_up(index, keys)["row"] == np.arange(n)).all()
    assert not token_files._looked_up(index, ~keys)["copies"].any()
    if n > 1:
        with pytest.raises(ValueError):
            token_files.PerfectHash.build(np.append(keys, keys[0]))


LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def variants(table, least_length=6, least_count=5, modulus=199):
    n = collections.Counter()
    for i, t in table:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = run.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % modulus == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            n[w] += 1
    n = {w: c for w, c in n.items() if len(w) >= least_length and c >= least_count}
    near = {w: [v for v in n if v != w and abs(len(v) - len(w)) < 2 and one_edit(v, w)] for w in n}
    best = {w: min(near[w], key=lambda v: (-n[v], v)) for w in n if near[w]}
    form = {w: v for w, v in best.items() if n[v] >= 5 * n[w]}

    def root(w):
        return root(form[w]) if w in form else w

    return {(w, form.get(w), root(w), n[w], len(near[w]), n[form[w]] if w in form else None) for w in n}


def test_spelling(spark, monkeypatch):
    random.seed(11)
    letters, table = "bÀé", []
    words = ["".join(random.choice(letters) for _ in range(random.randrange(6, 9))) for _ in range(250)]
    words += ["abcabc", "abcabd", "bcabca", "aabcabc", "abcabcc", "abccabc", "Abcabc", "ABCABC", "abcab", "×abcabc÷"]
    for i in range(60):
        table.append((random.choice([i, i, None, 3]), " ".join(random.choice(words) for _ in range(120)) + "\nabcabc " * (40 if i < 20 else 0)))
    table += [(1, None), (2, ""), (3, "1234 --"), (4, "abcabd " * 2000), (5, "z" * 20_000), (5, "z" * 20_000)]
    df = spark.createDataFrame([(i, t, 0, "w", "b") for i, t in table], "doc_id long, text string, n long, word string, b string").repartition(3)
    want = variants(table, modulus=7)
    got = [tuple(r) for r in spelling.spelling_variants(df, modulus=7).collect()]
    assert len(got) == len(want) and set(got) == want
    assert any(r[1] for r in want) and any(r[4] > 5 for r in want)
    assert spelling.spelling_variants(df.where("false")).count() == 0


def test_spelling_chain(spark):
    count, words = 5, ["aaaaaaaa", "aaaaaaab", "aaaaaabb", "aaaaabbb", "aaaabbbb", "aaabbbbb"]
    table = []
    for w in words:
        table.append((len(table), f"{w} " * count))
        count *= 5
    got = {tuple(r) for r in spelling.spelling_variants(spark.createDataFrame(table, "doc_id long, text string"), modulus=1 << 40).collect()}
    assert got == variants(table, modulus=1 << 40) and {r[2] for r in got} == {words[-1]}


@pytest.mark.parametrize("name", ["op11_fim", "op13_spelling"])
def test_query(spark, name):
    assert compare(spark, name, SF, queries.QUERIES, queries.ORACLES) is None


def test_token_query(spark, library):
    at, want = 0, set()
    for r in sorted(spark.read.parquet(f"{SF}/documents.parquet").collect(), key=lambda r: r.doc_id):
        ids = encoded(library, r.text)
        want.add((r.doc_id, at, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
        at += len(ids)
    got = [tuple(r) for r in queries.op12_token_files(spark, SF).select("doc_id", "start", "n_tokens", "ids_crc32").collect()]
    assert set(got) == want and len(got) == len(want)
