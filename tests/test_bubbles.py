"""Bubbles against brute force by their definition, on random graphs with cycles, palindromes and nested bubbles."""

import itertools
import random

from skein.operators import bubbles as B, contigs as C

LENGTHS = {c: 3 + c % 7 for c in range(200)}


def reach(start, stop, nxt):
    """Vertices met from start without going through stop."""
    out, todo = {start}, [start]
    while todo:
        u = todo.pop()
        for v in nxt.get(u, ()) if u != stop else ():
            if v not in out:
                out.add(v)
                todo.append(v)
    return out


def brute(edges):
    """By definition: for every pair (u, v), the set between them; then the least and the outermost ones."""
    nxt, prev = {}, {}
    for u, v in edges:
        nxt.setdefault(u, set()).add(v)
        prev.setdefault(v, set()).add(u)
    found = {}
    for u in nxt:
        if len(nxt[u]) < 2:
            continue
        for v in prev:
            if u == v:
                continue
            inside = reach(u, v, nxt)
            if v not in inside or len(inside) < 3:
                continue
            if any(not nxt.get(x, set()) <= inside or not nxt.get(x) for x in inside - {v}) or any(not prev.get(x, set()) <= inside for x in inside - {u}):
                continue
            inner = {x: nxt[x] - {u} for x in inside - {v}}
            if any(v in prev.get(x, ()) for x in inside - {u}):
                continue  # a cycle through the exit
            if any(u in nxt[x] for x in inside - {v}) or any(x in reach(y, None, inner) for x in inside - {u, v} for y in inner[x]):
                continue  # a cycle
            if u not in found or len(inside) < len(found[u][1]):
                found[u] = (v, inside)
    found = {u: x for u, x in found.items() if u != x[0] ^ 1}
    nested = set().union(*[s - {u, v} for u, (v, s) in found.items()]) if found else set()
    return {(u, v): s - {u, v} for u, (v, s) in found.items() if u not in nested}


def longest(u, v, inner, edges):
    at, order = {u: 0}, [u]
    left = set(inner) | {v}
    while left:
        w = min(x for x in left if all(p in at for p, y in edges if y == x and (p in inner or p == u)))
        at[w] = max(0, *[at[p] + edges[p, y] + LENGTHS[w // 2] for p, y in edges if y == w and p in at and p != v])
        order.append(w)
        left.discard(w)
    return at[v] - LENGTHS[v // 2]


def graph(rng, n):
    e = {}
    for i in range(n - 1):
        for _ in range(rng.choice([1, 1, 2, 3])):
            j = min(n - 1, i + rng.choice([1, 1, 2, 3]))
            e[2 * i, 2 * j] = rng.randrange(-6, 30)
    for _ in range(rng.randrange(3)):  # cycles, palindromes, edges to the other strand
        u, v = 2 * rng.randrange(n), 2 * rng.randrange(n) + rng.randrange(2)
        e[u, v] = rng.randrange(30)
    if rng.random() < 0.5:
        e[2 * (n - 1), 2 * (n - 1) + 1] = 5
    return e | {(v ^ 1, u ^ 1): d for (u, v), d in e.items()}


def table(spark, e):
    return spark.createDataFrame([(u, v, d) for (u, v), d in e.items()], "u long, v long, distance long")


def lengths(spark):
    return spark.createDataFrame(list(LENGTHS.items()), "contig_id long, length long")


def test_bubbles_of_random_graphs(spark):
    rng, all_, base = random.Random(6), {}, 0
    while base < 180:  # many small graphs side by side
        n = rng.randrange(4, 11)
        all_ |= {(u + 2 * base, v + 2 * base): d for (u, v), d in graph(rng, n).items()}
        base += n + 1
    want = brute(all_)
    found, inner = B.find_bubbles(table(spark, all_), lengths(spark))
    got = {(r.u, r.v): r.distance for r in found.collect()}
    assert got == {(u, v): longest(u, v, s, all_) for (u, v), s in want.items()}
    by = {k: {r[2] for r in g} for k, g in itertools.groupby(sorted(map(tuple, inner.collect())), key=lambda r: r[:2])}
    assert by == want and len(want) > 10 and max(map(len, want.values())) > 2


def test_bubbles_are_scaffolded_over(spark):
    # 0 -> {1 -> 2, 3} -> 4 -> 5, a direct edge over a second bubble 5 -> {6, } -> 7
    e = {(0, 2): 1, (2, 4): 2, (0, 6): 10, (4, 8): -3, (6, 8): 4, (8, 10): 0, (10, 12): 1, (10, 14): 9, (12, 14): 2}
    e |= {(v ^ 1, u ^ 1): d for (u, v), d in e.items()}
    left, gone = B.scaffold_over_bubbles(table(spark, e), lengths(spark))
    size = lambda c: LENGTHS[c]
    way = max(1 + size(1) + 2 + size(2) - 3, 10 + size(3) + 4)
    got = {(r.u, r.v): r.distance for r in left.collect()}
    assert got == {(0, 8): way, (9, 1): way, (8, 10): 0, (11, 9): 0, (10, 14): 9, (15, 11): 9}
    assert {r.w // 2 for r in gone.collect()} == {1, 2, 3, 6}
    none, vertices = B.find_bubbles(table(spark, e).where("false"), lengths(spark))
    assert none.count() == 0 and vertices.count() == 0


def test_scaffold_graph_pops_bubbles(spark):
    rows = [(0, 2, 5, 20), (2, 4, 5, 20), (0, 6, 5, 22), (6, 4, 5, 21), (4, 8, 5, 10)]
    e = C.add_complements(spark.createDataFrame([(u, v, n, d, 1.0) for u, v, n, d in rows], "u long, v long, n long, distance long, sd double"))
    g = C.scaffold_graph(e, lengths(spark), 1, 0)
    assert {(r.u, r.v) for r in g.collect()} == {(0, 4), (5, 1), (4, 8), (9, 5)}
