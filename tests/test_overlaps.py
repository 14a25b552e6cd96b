"""Overlaps of every length, guided overlaps and barcode links against plain Python."""

import itertools
import random

import pytest

from skein.operators import overlaps as O


def rc(s):
    return s[::-1].translate(str.maketrans("ACGT", "TGCA"))


def oriented(contigs):
    return {2 * i + s: rc(x) if s else x for i, x in contigs for s in (0, 1)}


def sizes(t, h, most):
    return [n for n in range(most, 0, -1) if t[-n:] == h[:n]]


@pytest.mark.parametrize("seed, least, below, reduced", [(1, 2, 6, False), (2, 3, 9, True), (3, 1, 4, False)])
def test_overlaps_of_every_length(spark, seed, least, below, reduced):
    rng = random.Random(seed)
    contigs = [(i, "".join(rng.choice("ACG" if i % 3 else "AT") for _ in range(rng.randrange(0, 14)))) for i in range(25)]
    df = spark.createDataFrame([(i, s, i) for i, s in contigs] + [(99, None, 0)], "contig_id long, seq string, u int")
    w, want = oriented(contigs), {}
    for u, v in itertools.product(w, w):
        most = min(below - 1, len(w[u]) - 1, len(w[v]) - 1)
        found = [n for n in sizes(w[u], w[v], most) if n >= least] if most >= least else []
        if found:
            want[u, v] = -found[0]
    if reduced:
        plain = {x for x in want if x[0] != x[1]}
        gone = {(a, c) for a, b in plain for b2, c in plain if b == b2 and a != c and (a, c) in want}
        gone |= {(c ^ 1, a ^ 1) for a, c in gone}
        want = {x: d for x, d in want.items() if x not in gone}
    assert {(r.u, r.v): r.distance for r in O.all_overlaps(df, least, below, reduced).collect()} == want


def plain_guided(est, e, contigs, least, scaffold, keep):
    w, best = oriented(contigs), {}
    for u, v, d, sd in est:
        if None in (u, v, d) or u // 2 == v // 2:
            continue
        x = min((u, v), (v ^ 1, u ^ 1))
        best[x] = min(best.get(x, (d, sd or 0)), (d, sd or 0))
    kept = {}
    for (u, v), (d, sd) in best.items():
        if (d >= 0 and not scaffold) or u in {a for a, _ in e} or v in {b for _, b in e} or u not in w or v not in w:
            continue
        found = sizes(w[u], w[v], min(len(w[u]), len(w[v]))) if d - -(-(3 * sd + 6) // 1) <= 0 else []
        o = found[0] if found and found[0] >= least else 0
        if o and len(found) > 2 and found[0] - found[1] == found[1] - found[2] and not keep:
            continue
        if o or scaffold:
            kept[u, v] = kept[v ^ 1, u ^ 1] = (d, o)
    single = lambda g: {x for x in g if sum(y[0] == x[0] for y in g) == 1 == sum(y[1] == x[1] for y in g)}
    joined = single({x for x, (_, o) in kept.items() if o})
    out = {(*x, -kept[x][1], kept[x][1]) for x in joined}
    if scaffold:
        left = {x for x in kept if x[0] not in {a for a, _ in joined} and x[1] not in {b for _, b in joined}}
        out |= {(*x, *kept[x]) for x in single(left) if not kept[x][1]}
    return out


@pytest.mark.parametrize("seed, least, scaffold, keep", [(1, 1, False, False), (2, 2, True, False), (3, 1, True, True), (4, 3, False, True)])
def test_guided_overlaps(spark, seed, least, scaffold, keep):
    rng = random.Random(seed)
    contigs = [(i, "".join(rng.choice("ACGT" if i % 4 else "AC") for _ in range(rng.randrange(1, 9)))) for i in range(60)]
    contigs[:4] = [(0, "GGAAAA"), (1, "AAAAGG"), (2, "CTGTGTG"), (3, "TGTGTGC")]
    est = [(0, 2, -5, 1.0), (4, 6, -6, 0.5), (6 ^ 1, 4 ^ 1, -7, 0.5), (8, 8, -3, 1.0), (8, 9, -3, 1.0), (None, 1, -1, 1.0), (10, 12, None, 1.0), (10, 200, -4, 1.0), (14, 16, -4, None)]
    est += [(rng.randrange(120), rng.randrange(120), rng.randrange(-9, 12), rng.choice([0.0, 0.4, 2.0])) for _ in range(60)]
    e = [(rng.randrange(120), rng.randrange(120)) for _ in range(12)]
    e += [(v ^ 1, u ^ 1) for u, v in e]
    got = O.guided_overlaps(
        spark.createDataFrame(est, "u long, v long, distance int, sd double"),
        spark.createDataFrame(e, "u long, v long"),
        spark.createDataFrame([*contigs, (77, None)], "contig_id long, seq string"),
        least,
        scaffold,
        keep,
    )
    rows = [tuple(r) for r in got.collect()]
    want = plain_guided(est, e, contigs, least, scaffold, keep)
    assert len(rows) == len(set(rows)) and set(rows) == want and want


def test_borders_are_linear():
    assert O._borders("A" * 200_000, "A" * 200_000) == [200_000, 199_999, 199_998]
    assert O._borders("", "A") == [] and O._borders("AC", "GT") == []


@pytest.mark.parametrize("percent, least", [(50, 1), (80, 2), (100, 1), (10, 1)])
def test_barcode_links(spark, percent, least):
    rng = random.Random(percent)
    sets = {w: {rng.choice("abcdefgh") + str(rng.randrange(3)) for _ in range(rng.randrange(1, 9))} for w in range(30)}
    sets |= {w: set(sets[w - 30]) | ({"hot"} if w % 2 else set()) for w in range(30, 60)}
    rows = [(w, b, 0) for w, s in sets.items() for b in s]
    df = spark.createDataFrame(rows + rows[:5] + [(None, "a0", 0), (3, None, 0), (99, None, 0)], "w long, barcode string, n int")
    want = set()
    for a, b in itertools.combinations(sorted(sets), 2):
        shared, all_ = len(sets[a] & sets[b]), len(sets[a] | sets[b])
        if shared >= least and 100 * shared >= percent * all_:
            want.add((a, b, shared, all_))
    rows = [tuple(r) for r in O.barcode_links(df, percent, least).collect()]
    assert len(rows) == len(set(rows)) and set(rows) == want and want


def test_empty_tables(spark):
    none = lambda s: spark.createDataFrame([], s)
    assert O.all_overlaps(none("contig_id long, seq string"), 3, 6).count() == 0
    assert O.guided_overlaps(none("u long, v long, distance long, sd double"), none("u long, v long"), none("contig_id long, seq string")).count() == 0
    assert O.barcode_links(none("w long, barcode string"), 50).count() == 0
