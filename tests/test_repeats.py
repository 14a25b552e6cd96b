"""Splitting of repeats against plain Python on random graphs, and a genome that two passes through a repeat make ambiguous."""

import random

import pytest

from skein.operators import contigs as C, paths as P, repeats as R

RC = str.maketrans("ACGT", "TGCA")


def rc(s):
    return s.translate(RC)[::-1]


def plain(e, support):
    """Edges as pairs of vertex copies, a copy being (vertex, ends that belong to it)."""
    ways = {}
    for a, r, b, state in support:
        if state != "unsupported":
            if r % 2:
                a, r, b = b ^ 1, r ^ 1, a ^ 1
            if (a, r) in e and (r, b) in e:
                ways.setdefault(r, set()).add((("in", a), ("out", b)))
    label = {}
    for r, links in ways.items():
        ends = {("in", u) for u, v in e if v == r} | {("out", v) for u, v in e if u == r}
        group = {x: {x} for x in ends}
        for i, o in links:
            both = group[i] | group[o]
            for x in both:
                group[x] = both
        linked = {x for link in links for x in link}
        if linked == ends and len(group[min(ends)]) == len(ends):
            continue
        for x in ends:
            label[r, x] = frozenset(group[x]) if x in linked else None
    turn = {"in": "out", "out": "in"}

    def copy(w, way, x):
        if w % 2:
            got = label.get((w ^ 1, (turn[way], x ^ 1)), "whole")
            return got and (w, got if got == "whole" else frozenset((turn[d], y ^ 1) for d, y in got))
        got = label.get((w, (way, x)), "whole")
        return got and (w, got)

    out = [(copy(u, "out", v), copy(v, "in", u)) for u, v in e]
    out = [x for x in out if None not in x]
    # an edge may be lost at its other end: a copy is told by the edges that it keeps
    kept = {}
    for u, v in out:
        kept.setdefault(u, set()).add(("out", v[0]))
        kept.setdefault(v, set()).add(("in", u[0]))
    told = lambda x: x if x[1] == "whole" else (x[0], tuple(sorted(kept[x])))
    return sorted(((told(u), told(v)) for u, v in out), key=repr), {w >> 1 for w, _ in label}


def named(edges, copies, e):
    """The same of the operator's result, by the edges that its vertices have."""
    of = {c.contig_id: c.copy_of for c in copies}
    old = lambda w: of[w >> 1] * 2 + w % 2 if w >> 1 in of else w
    ends = {}
    for u, v in edges:
        ends.setdefault(u, set()).add(("out", old(v)))
        ends.setdefault(v, set()).add(("in", old(u)))
    copy = lambda w: (old(w), tuple(sorted(ends[w])) if w >> 1 in of else "whole")
    return sorted(((copy(u), copy(v)) for u, v in edges), key=repr), set(of.values())


@pytest.mark.parametrize("seed", range(5))
def test_splitting_of_random_graphs(spark, seed):
    rng = random.Random(seed)
    e = {(rng.randrange(24), rng.randrange(24)) for _ in range(30)}
    e |= {(v ^ 1, u ^ 1) for u, v in e}
    support = []
    for r in range(0, 24, 2):
        ins, outs = [u for u, v in e if v == r], [v for u, v in e if u == r]
        if len(ins) > 1 and len(outs) > 1:
            for a in ins:
                for b in outs:
                    state = rng.choice(["supported", "unsupported", "unsupported", "unknown"])
                    support.append((a, r, b, state))
                    if rng.random() < 0.5:
                        support.append((b ^ 1, r ^ 1, a ^ 1, state))
    support += support[:3] + [(98, 0, 99, "supported")]
    df = spark.createDataFrame([(u, v, -u * v) for u, v in e], "u long, v long, distance long")
    got, copies = R.split_repeats(df, spark.createDataFrame(support, "a long, rep long, b long, state string"), 0.0)
    rows, copies = got.collect(), copies.collect()
    edges, split = named([(r.u, r.v) for r in rows], copies, e)
    want, repeats = plain(e, support)
    assert edges == want and split == repeats and len({c.contig_id for c in copies}) == len(copies)
    assert {(r.v ^ 1, r.u ^ 1) for r in rows} == {(r.u, r.v) for r in rows}


def test_too_little_support_changes_nothing(spark):
    e = spark.createDataFrame([(0, 4), (2, 4), (4, 6), (4, 8)], "u long, v long")
    support = [(0, 4, 6, "supported")] + [(2, 4, 8, "unsupported")] * 9
    for rows in (support, [(0, 4, 6, "unknown")], []):
        got, copies = R.split_repeats(e, spark.createDataFrame(rows, "a long, rep long, b long, state string"))
        assert got.count() == 4 and copies.count() == 0


def test_two_ways_through_a_repeat(spark):
    """Reads that reach over a repeat of 30 bases take it apart, and the two ways come out whole."""
    rng = random.Random(8)
    dna = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    k, r = 11, 40
    a, b, c, d, rep = dna(80), dna(80), dna(80), dna(80), dna(30)
    o = k - 1
    contigs = [(0, a + rep[:o]), (1, b + rep[:o]), (2, rep), (3, rep[-o:] + c), (4, rc(rep[-o:] + d))]
    e = [(0, 4), (2, 4), (4, 6), (4, 9)]
    e += [(v ^ 1, u ^ 1) for u, v in e]
    ways = [a + rep + c, b + rep + d]
    reads = [(w[i : i + 60],) for w in ways for i in range(0, len(w) - 59, 3)]
    g, made = R.resolve_repeats(spark.createDataFrame([(u, v, -o) for u, v in e], "u long, v long, distance long"), spark.createDataFrame(contigs, "contig_id long, seq string"), spark.createDataFrame(reads, "seq string"), r, o)
    paths = C.assemble_paths(g).select("head", "nodes").withColumnRenamed("head", "path_id")
    from pyspark.sql import functions as F

    merged = P.merge_contigs(paths, made.withColumn("coverage", F.lit(1)), g, k)
    assert {min(x.seq, rc(x.seq)) for x in merged.collect()} == {min(w, rc(w)) for w in ways}
