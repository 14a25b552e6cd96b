"""The scaffolder as a whole against plain Python, step by step by the steps' definitions, on a random graph."""

import random

import test_bubbles as TB
from skein.operators import contigs as C


def both(edges):
    edges = set(edges)
    return edges | {(v ^ 1, u ^ 1) for u, v in edges}


def without(g, contigs):
    return {e: x for e, x in g.items() if e[0] // 2 not in contigs and e[1] // 2 not in contigs}


def around(g):
    nxt, prev = {}, {}
    for u, v in g:
        nxt.setdefault(u, set()).add(v)
        prev.setdefault(v, set()).add(u)
    return nxt, prev


def pruned(g):
    nxt, prev = around(g)
    return without(g, {v // 2 for u, v in g if not nxt.get(v) and len(prev[v]) == 1 and len(nxt[u]) > 1})


def plain_scaffold(full, lengths, n, s):
    g = without({e: x for e, x in full.items() if x[0] >= n}, {c for c, size in lengths.items() if size < s})
    cut = both((u, v) for u, v in g if (v, u) in g)
    g = {e: x for e, x in g.items() if e not in cut}
    nxt, _ = around(g)
    add = {e for vs in nxt.values() for a in vs for b in vs if a < b and ((a, b) in full) != ((b, a) in full) for e in [(a, b) if (a, b) in full else (b, a)] if e not in g}
    g = {e: full[e] for e in both(add)} | g
    g = pruned(g)
    nxt, _ = around(g)
    joined = lambda a, b: (a, b) in g or (b, a) in g
    rep = {v for u, v in g for w in nxt.get(v, ()) if (u, w) in g and any(x != w and not joined(w, x) for x in nxt[v])}
    cut = both(e for e in g if e[0] in rep)
    g = without({e: x for e, x in g.items() if e not in cut}, {w // 2 for w in rep if w ^ 1 in rep})
    nxt, _ = around(g)
    cut = both((u, w) for u, w in g if u != w and any(v != u and v != w and w in nxt.get(v, ()) for v in nxt[u]))
    g = pruned({e: x for e, x in g.items() if e not in cut})
    bubbles = TB.brute(set(g))
    dist = {e: x[1] for e, x in g.items()}
    over = {}
    for (u, v), inner in bubbles.items():
        for e in both([(u, v)]):
            over[e] = max(over.get(e, 1), TB.longest(u, v, inner, dist))
    inner = {w // 2 for s_ in bubbles.values() for w in s_}
    g = without({**{e: (None, d) for e, d in over.items() if e not in g}, **g}, inner)
    nxt, prev = around(g)
    weak = set()
    for u, v in g:
        if len(nxt[u]) == 2 and len(prev[v]) == 2 and g[u, v][0] is not None:
            (a,), (b,) = nxt[u] - {v}, prev[v] - {u}
            sides = [g[u, a][0], g[b, v][0]]
            if len(prev[a]) == 1 and len(nxt[b]) == 1 and None not in sides and g[u, v][0] < min(sides):
                weak.add((u, v))
    return {e: x for e, x in g.items() if e not in both(weak)}, len(bubbles), len(weak)


def plain_paths(g, full):
    nxt, prev = around(g)
    link = {u: min(vs) for u, vs in nxt.items() if len(vs) == 1 and len(prev[min(vs)]) == 1 and min(vs) != u ^ 1}
    for h in set(link) - set(link.values()):
        run = [h]
        while run[-1] in link:
            run.append(link[run[-1]])
        if h < run[-1] ^ 1:
            gap = [max(50, full[e][1]) if e in full else 50 for e in zip(run, run[1:])]
            yield h, tuple(zip(run, [*gap, None]))


def random_links(rng):
    e, base = {}, 0
    while base < 150:
        n = rng.randrange(5, 11)
        for (u, v), d in TB.graph(rng, n).items():
            e[u + 2 * base, v + 2 * base] = (rng.randrange(1, 9), d * 4)
        base += n + 1
    done = {}
    for (u, v), x in e.items():  # both strands tell the same
        if u != v:
            done[u, v] = done[v ^ 1, u ^ 1] = done.get((v ^ 1, u ^ 1), x)
    return done


def test_scaffolder_equals_plain_python(spark):
    full = random_links(random.Random(31))
    rows = [(u, v, n, d, 1.0) for (u, v), (n, d) in full.items()]
    e = spark.createDataFrame(rows, "u long, v long, n long, distance long, sd double").repartition(3)
    want, bubbles, _ = plain_scaffold(full, TB.LENGTHS, 2, 4)
    g = C.scaffold_graph(e, TB.lengths(spark), 2, 4).cache()
    assert {(r.u, r.v): (r.n, r.distance) for r in g.collect()} == want and bubbles and want
    got = {(r.head, tuple((s.w, s.gap) for s in r.steps)) for r in C.scaffold_paths(g, e).collect()}
    assert got == set(plain_paths(want, full)) and len(got) > 3


def test_optimise_takes_the_first_best_point(spark):
    full = random_links(random.Random(32))
    e = spark.createDataFrame([(u, v, n, d, 1.0) for (u, v), (n, d) in full.items()], "u long, v long, n long, distance long, sd double")
    best = None
    for n in (2, 5):
        paths = list(plain_paths(plain_scaffold(full, TB.LENGTHS, n, 0)[0], full))
        used = {w // 2 for _, steps in paths for w, _ in steps}
        sizes = sorted([sum(TB.LENGTHS[w // 2] for w, _ in steps) for _, steps in paths] + [x for c, x in TB.LENGTHS.items() if c not in used], reverse=True)
        run = 0
        for x in sizes:
            run += x
            if 2 * run >= sum(sizes):
                break
        if best is None or x > best[2]:
            best = (n, 0, x)
    assert C.optimise(e, TB.lengths(spark), [2, 5], [0]) == best
