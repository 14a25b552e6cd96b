"""Alignment in little memory, contigs merged over unlike overlaps, and the consensus of alternate walks, against plain Python."""

import random
import tracemalloc

import pytest

from skein.operators import align as L, paths as P

SETS = {"A": "A", "C": "C", "G": "G", "T": "T", "R": "AG", "Y": "CT", "M": "AC", "K": "GT", "S": "CG", "W": "AT", "N": "ACGT"}
CODES = {frozenset(v): c for c, v in SETS.items()}


def rc(s):
    return s[::-1].translate(str.maketrans("ACGT", "TGCA"))


def fits(a, b):
    s, t = set(SETS[a.upper()]), set(SETS[b.upper()])
    return s <= t or t <= s


def best_score(a, b):
    """The score of the best global alignment, cell by cell."""
    low, n, m = -(10**9), len(a), len(b)
    t = {(0, 0): (0, low, low)}
    for i in range(n + 1):
        for j in range(m + 1):
            if i or j:
                pair = max(t[i - 1, j - 1]) + (5 if fits(a[i - 1], b[j - 1]) else -4) if i and j else low
                down = max(t[i - 1, j][1] - 4, max(t[i - 1, j][0], t[i - 1, j][2]) - 12) if i else low
                right = max(t[i, j - 1][2] - 4, max(t[i, j - 1][0], t[i, j - 1][1]) - 12) if j else low
                t[i, j] = pair, down, right
    return max(t[n, m])


def test_best_alignments_of_random_pairs():
    rng = random.Random(3)
    for i in range(150):
        letters = "ACGT" if i % 3 else "ACGTRYN"
        a = [rng.choice(letters) for _ in range(rng.randrange(0, 30))]
        b = list(a)
        for _ in range(rng.randrange(0, 4)):
            at = rng.randrange(len(b) + 1)
            b[at : at + rng.randrange(0, 4)] = [rng.choice(letters) for _ in range(rng.randrange(0, 4))]
        a, b = "".join(a), "".join(b)
        consensus, matches, columns = L.global_alignment(a, b)
        pairs = sum(c.isupper() for c in consensus)
        assert columns == len(consensus) and 2 * pairs + columns - pairs == len(a) + len(b)
        # gaps cost as many openings as it takes at the least
        rest = best_score(a, b) - 5 * matches + 4 * (pairs - matches)
        opened, odd = divmod(rest + 4 * (columns - pairs), -8)
        assert odd == 0 and 0 <= opened <= columns - pairs, (a, b)


def test_long_sequences_in_little_memory():
    rng = random.Random(4)
    a = "".join(rng.choice("ACGT") for _ in range(20_000))
    b = a[:7_000] + "ACGTACGT" + a[7_000:15_000] + a[15_100:]
    tracemalloc.start()
    consensus, matches, columns = L.global_alignment(a, b)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (matches, columns) == (19_900, 20_008) and peak < 100_000_000


def test_agreement_of_overlaps():
    assert L.agreed("ACGT", "ACGT") == "ACGT" and L.agreed("ACRT", "ACGT") == "ACRT" and L.agreed("ANg", "ACG") == "ACg"
    assert L.agreed("ACKT", "ACRT") is None and L.agreed("", "") == ""
    for x in SETS:
        for y in SETS:
            want = CODES[frozenset(SETS[x]) | frozenset(SETS[y])] if fits(x, y) else None
            assert L.agreed(x, y) == (y if x == "N" else x if y == "N" else want)


def test_merging_over_unlike_overlaps(spark):
    rng = random.Random(5)
    dna = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    core, a, b = dna(40), dna(30), dna(25)
    wrong = core[:20] + {"A": "C", "C": "G", "G": "T", "T": "A"}[core[20]] + core[21:]
    other = dna(40)
    contigs = [(0, a + core, 3), (1, wrong + b, 4), (2, rc(wrong + b), 5), (3, other + b, 6), (4, core[:-1] + "N" + b, 7), (5, None, 8)]
    e = [(0, 2, -40), (0, 5, -40), (0, 6, -40), (0, 8, -40)]
    paths = [(1, [0, 2]), (2, [0, 5]), (3, [0, 6]), (4, [0, 8]), (5, [0, -3, 2]), (6, [2, 0]), (7, [0, 10]), (8, [0])]
    got = P.merge_contigs(spark.createDataFrame(paths, "path_id int, nodes array<long>"), spark.createDataFrame(contigs, "contig_id long, seq string, coverage long"), spark.createDataFrame(e, "u long, v long, distance long"), 41)
    seqs = {r.path_id: (r.seq, r.coverage) for r in got.collect()}
    code = CODES[frozenset({core[20], wrong[20]})]
    one = a + core[:20] + code + core[21:] + b
    assert seqs[1] == (one, 7) and seqs[2] == (one, 8)
    assert seqs[3] == (a + core + "n" + other + b, 9) and seqs[4] == (a + core + b, 10)
    assert seqs[5] == (a + core + "NNN" + wrong + b, 7) and seqs[6] == (wrong + b + "n" + a + core, 7)
    assert seqs[7] == (None, 11) and seqs[8] == (a + core, 3)


@pytest.mark.parametrize("most", [2, 4])
def test_consensus_of_walks(spark, most):
    """Contigs that overlap by three bases: codes and sequences of gaps of every kind."""
    k, rng = 4, random.Random(6)
    dna = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    left, right = "CCC" + dna(20) + "AAA", "GGG" + dna(20)
    base = "AAA" + dna(40) + "GGG"
    change = lambda s, i: s[:i] + {"A": "C", "C": "G", "G": "T", "T": "A"}[s[i]] + s[i + 1 :]
    like, third = change(base, 10), change(base, 20)
    unlike, short = "AAA" + dna(40) + "GGG", "AAAGGG"
    seqs = [left, right, base, like, third, unlike, short, base]
    contigs = spark.createDataFrame([(i, s, 1) for i, s in enumerate(seqs)], "contig_id long, seq string, coverage long")
    e = spark.createDataFrame([(0, 2 * i, -3) for i in range(2, 8)] + [(2 * i, 2, -3) for i in range(2, 8)], "u long, v long, distance long")
    way = lambda *i: [0, *(2 * x for x in i), 2]
    gaps = {"one": [way(2)], "pair": [way(2), way(3)], "unlike": [way(2), way(5)], "lengths": [way(2), way(6)], "same": [way(2), way(7)], "three": [way(2), way(3), way(4)], "five": [way(i) for i in range(2, 7)], "bare": [way(6), way()]}
    rows = [(g, w) for g, ws in gaps.items() for w in ws] + [("one", way(2)), ("none", [0]), ("none", None)]
    got = {r.gap: r for r in P.path_consensus(spark.createDataFrame(rows, "gap string, nodes array<long>"), contigs, e, k, 0.9, most).collect()}
    assert set(got) == set(gaps)
    told = lambda g: (got[g].n, got[g].code, got[g].before, got[g].seq, got[g].after)
    assert told("one") == (1, "UNIQUE", way(2), None, None)
    merged = base[:10] + CODES[frozenset({base[10], like[10]})] + base[11:]
    assert told("pair") == (2, "MERGED", [0], merged, [2])
    assert told("unlike")[:3] == (2, "DIFFERENT", None) and told("lengths")[:3] == (2, "DIFFERENT", None)
    assert told("same") == (2, "SAME", way(2), None, None)
    assert told("five") == (5, "TOO_MANY", None, None, None)
    assert told("bare")[:2] == (2, "DIFFERENT")
    if most == 2:
        assert told("three") == (3, "TOO_MANY", None, None, None)
    else:
        both = merged[:20] + CODES[frozenset({base[20], third[20]})] + merged[21:]
        assert told("three") == (3, "MERGED", [0], both, [2])
    bare = P.path_consensus(spark.createDataFrame([("x", way(6)), ("x", way())], "gap string, nodes array<long>"), contigs, e, k, 0.5).collect()
    assert [(r.code, r.seq) for r in bare] == [("MERGED", "AAAggg")]


def test_no_walks(spark):
    none = lambda s: spark.createDataFrame([], s)
    assert P.path_consensus(none("gap long, nodes array<long>"), none("contig_id long, seq string, coverage long"), none("u long, v long, distance long"), 4).count() == 0
