"""The two-sided search for walks between flanks against plain enumeration on random graphs."""

import random

import pytest

from skein.operators import gaps as B

RC = str.maketrans("ACGT", "TGCA")


def rc(s):
    return s.translate(RC)[::-1]


def plain(pairs, kmers, k, longest, most):
    """All walks of each pair by depth-first enumeration."""
    graph = set(kmers) | {rc(x) for x in kmers}
    found = {}
    for pair, left, right in set(pairs):
        if left is None or right is None or len(left) < k or len(right) < k:
            continue
        begin, goal = left[-k:].upper(), right[:k].upper()
        if begin not in graph or goal not in graph:
            continue
        stack = [begin]
        while stack:
            walk = stack.pop()
            for b in "ACGT":
                if (walk + b)[-k:] not in graph:
                    continue
                if (walk + b)[-k:] == goal:
                    found.setdefault(pair, set()).add(walk + b)
                elif len(walk) + 1 - k < longest + k:
                    stack.append(walk + b)
    return {pair: (min(w), min(len(w), most)) for pair, w in found.items()}


@pytest.mark.parametrize("seed, k, longest, most", [(1, 4, 5, 2), (2, 5, 6, 1000), (3, 3, 4, 3), (4, 5, 7, 2)])
def test_walks_of_random_graphs(spark, seed, k, longest, most):
    """Cycles, palindromes and repeats abound in short k-mers; odd and even distances; equal, repeated, short, null and unknown flanks."""
    rng = random.Random(seed)
    genome = "".join(rng.choice("ACGT") for _ in range({3: 24, 4: 70, 5: 240}[k]))
    kmers = {min(w, rc(w)) for w in (genome[i : i + k] for i in range(len(genome) - k + 1))}
    pairs = []
    for i in range(40):
        a, d = rng.randrange(len(genome) - 2 * k), rng.randrange(0, longest + k)
        left, right = genome[max(0, a - 3) : a + k], genome[a + d : a + d + k + 2]
        pairs.append((i, left, right.lower() if i % 5 == 0 else right))
    pairs += [(0, *pairs[0][1:]), (1, genome[-k:], genome[:k]), (None, genome[:k], genome[3 : 3 + k]), (90, None, "A" * k), (91, "AC", "ACGTA"), (92, "N" * k, genome[:k]), (93, genome[:k], genome[:k])]
    df = spark.createDataFrame([(*p, "x") for p in pairs], "pair long, left string, right string, node string")
    known = spark.createDataFrame([(x, 1) for x in kmers], "kmer string, n long")
    got = {r.pair: (r.seq, r.n_paths) for r in B.connect(df, known, k, longest, most).collect()}
    assert got == plain(pairs, kmers, k, longest, most) and len(got) > 20


def test_very_many_walks_are_counted_and_not_listed(spark):
    """Forty steps in the graph of all 3-mers: 4 ** 37 or so walks, a row for each k-mer."""
    import itertools

    kmers = {min(w, rc(w)) for w in ("".join(x) for x in itertools.product("ACGT", repeat=3))}
    df = spark.createDataFrame([(1, "AAA", "TTT")], "pair long, left string, right string")
    r = B.connect(df, spark.createDataFrame([(x,) for x in kmers], "kmer string"), 3, 37, 10**6).collect()
    assert [(x.pair, x.n_paths) for x in r] == [(1, 10**6)] and r[0].seq.startswith("AAAA") and r[0].seq.endswith("TTT")


def test_no_kmers(spark):
    df = spark.createDataFrame([(1, "AAA", "TTT")], "pair long, left string, right string")
    assert B.connect(df, spark.createDataFrame([], "kmer string"), 3, 5).count() == 0
