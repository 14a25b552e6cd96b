"""True branches, codes of extensions and branch depths against plain Python on random graphs."""

import random
from collections import deque

import pytest

from skein.operators import branches as B


def around(edges):
    out, into = {}, {}
    for u, v in edges:
        out.setdefault(u, set()).add(v)
        into.setdefault(v, set()).add(u)
    return {"out": out, "in": into}


TURNED = {"out": "in", "in": "out"}


def true_branch(near, u, v, way, limit):
    """Whether any walk from u over v, straight on or turning, meets a vertex twice or goes straight for more than limit vertices."""

    def walk(came, at, way, run, seen):
        if at in seen or run > limit:
            return True
        seen = seen | {at}
        on = any(walk(at, x, way, run + 1, seen) for x in near[way].get(at, ()))
        return on or any(walk(at, x, TURNED[way], 1, seen) for x in near[TURNED[way]].get(at, ()) if x != came)

    return walk(u, v, way, 1, frozenset())


def step(near, w, way, trim):
    limit = 0
    while True:
        left = [x for x in near[way].get(w, ()) if true_branch(near, w, x, way, limit)]
        if not left:
            return "DEAD_END", None
        if len(left) == 1:
            return "NEXT", left[0]
        if limit == trim:
            return "AMBI_OUT", None
        limit = min(trim, limit * 2 or 1)


def extended(steps, w, most):
    path = [w]
    while most is None or len(path) < most:
        at = path[-1]
        code, back = steps[at]["in"]
        if code == "AMBI_OUT" or (len(path) > 1 and back != path[-2]):
            return len(path) - 1, "AMBI_IN"
        code, ahead = steps[at]["out"]
        if code != "NEXT":
            return len(path) - 1, code
        if ahead in path:
            return len(path) - 1, "CYCLE"
        path.append(ahead)
    return len(path) - 1, "LENGTH_LIMIT"


def random_graph(seed):
    """Lines with tips, bubbles, circles, loops, repeated edges and lone vertices."""
    rng, e, n = random.Random(seed), [], 0
    for _ in range(6):
        line = list(range(n, n + rng.randrange(3, 9)))
        n += len(line)
        e += list(zip(line, line[1:]))
        if rng.random() < 0.3:
            e.append((line[-1], line[0] if rng.random() < 0.5 else rng.choice(line)))
        for _ in range(rng.randrange(3)):
            tip = list(range(n, n + rng.randrange(1, 4)))
            n += len(tip)
            tip = [rng.choice(line), *tip]
            e += [(a, b) if seed % 2 else (b, a) for a, b in zip(tip, tip[1:])] if rng.random() < 0.7 else list(zip(tip, tip[1:]))
    for _ in range(rng.randrange(4)):
        e.append((rng.randrange(n), rng.randrange(n)))
    return n + 2, e + e[:2]


@pytest.mark.parametrize("seed, trim, most", [(1, 2, None), (2, 3, 4), (3, 0, None), (4, 5, None), (5, 1, 3), (6, 4, None)])
def test_branches_of_random_graphs(spark, seed, trim, most):
    n, e = random_graph(seed)
    near = around(e)
    df = spark.createDataFrame([(u, v, 0) for u, v in e] + [(None, 1, 0), (1, None, 0)], "u long, v long, x int")
    spans = B.branch_spans(df, trim)
    for r in spans.collect():
        for way, u, v, span in (("out", r.u, r.v, r.out_span), ("in", r.v, r.u, r.in_span)):
            for limit in range(trim + 1):
                assert true_branch(near, u, v, way, limit) == (span is None or span > limit), (r, way, limit)
    vertices = spark.createDataFrame([(w,) for w in range(n)], "w long")
    steps = B.next_vertices(spans, vertices, trim)
    got = {r.w: {"out": (r.out_code, r.out_next), "in": (r.in_code, r.in_next)} for r in steps.collect()}
    want = {w: {way: step(near, w, way, trim) for way in ("out", "in")} for w in range(n)}
    assert got == want
    assert {r.w: (r.steps, r.code) for r in B.extensions(steps, most).collect()} == {w: extended(want, w, most) for w in range(n)}


def test_vertices_that_stand_for_several(spark):
    """A tip of one vertex of three is a true branch where two are trimmed, and none where three are."""
    e = spark.createDataFrame([(0, 1), (1, 2), (1, 3)], "u long, v long")
    n = spark.createDataFrame([(0, 9), (1, 1), (2, 9), (3, 3)], "w long, n int")
    for trim, true in ((2, True), (3, False)):
        assert {(r.u, r.v): r.out_span is None for r in B.branch_spans(e, trim, n).collect()}[1, 3] is true


def test_depths_of_random_graphs(spark):
    n, e = random_graph(7)
    near = around(e)["out"]

    def depth(v):
        far, queue = {v: 0}, deque([v])
        while queue:
            at = queue.popleft()
            for x in near.get(at, ()):
                if x not in far:
                    far[x] = far[at] + 1
                    queue.append(x)
        return max(far.values())

    want = {}
    for u, vs in near.items():
        top = max(depth(v) + 1 for v in vs)
        best = [v for v in vs if depth(v) + 1 == top]
        want[u] = (min(best), top, len(best) > 1)
    roots = spark.createDataFrame([(w,) for w in range(n)], "w long")
    got = B.longest_branches(spark.createDataFrame(e, "u long, v long"), roots).collect()
    assert {r.w: (r.next, r.depth, r.tied) for r in got} == want


def test_contigs_pass_tips(spark):
    """A genome with an error near one end of a read: its tip of three k-mers no longer ends the contig."""
    rng = random.Random(11)
    genome, k = "".join(rng.choice("ACGT") for _ in range(60)), 9
    rc = lambda s: s[::-1].translate(str.maketrans("ACGT", "TGCA"))
    wrong = {"A": "C", "C": "G", "G": "T", "T": "A"}[genome[30]]
    read = genome[10:30] + wrong + genome[31:33]
    kmers = {min(x, rc(x)) for s in (genome, read) for x in (s[i : i + k] for i in range(len(s) - k + 1))}
    df = spark.createDataFrame([(x, 1) for x in kmers], "kmer string, n int")
    whole = min(genome, rc(genome))
    assert whole in {r.seq for r in B.branch_contigs(df, k, 3).collect()}
    assert whole not in {r.seq for r in B.branch_contigs(df, k, 2).collect()}


def test_no_edges(spark):
    e = spark.createDataFrame([], "u long, v long")
    assert B.branch_spans(e, 3).count() == 0
    w = spark.createDataFrame([(1,)], "w long")
    assert [tuple(r) for r in B.extensions(B.next_vertices(B.branch_spans(e, 3), w, 3)).collect()] == [(1, 0, "DEAD_END")]
    assert B.longest_branches(e, w).count() == 0
