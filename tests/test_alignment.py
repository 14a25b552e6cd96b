"""The overlap alignment against a plain table, cell by cell."""

import random

from pyspark.sql import functions as F

from skein.operators import align as L

SETS = {"A": "A", "C": "C", "G": "G", "T": "T", "R": "AG", "Y": "CT", "M": "AC", "K": "GT", "S": "CG", "W": "AT", "N": "ACGT"}


def plain(a, b):
    cells = {(i, 0): (0, "start", i, 0) for i in range(len(a) + 1)}  # score, last step, begin, matches
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            s, t = set(SETS[a[i - 1].upper()]), set(SETS[b[j - 1].upper()])
            fits = s <= t or t <= s
            ways = []
            for at, step in (((i - 1, j - 1), "pair"), ((i - 1, j), "down"), ((i, j - 1), "right")):
                if at in cells:
                    score, last, begin, matches = cells[at]
                    cost = (5 if fits else -4) if step == "pair" else (-4 if last == step else -12)
                    ways.append((score + cost, step, begin, matches + (fits and step == "pair")))
            cells[i, j] = max(ways, key=lambda w: w[0])  # the first of the best
    score, _, begin, matches, end = max(((*cells[len(a), j], j) for j in range(len(b) + 1) if (len(a), j) in cells), key=lambda w: w[0])
    return score, begin, end, matches


def test_overlaps_equal_a_plain_table(spark):
    rng = random.Random(5)
    rows = []
    for i in range(300):
        letters = "ACGT" if i % 3 else "ACGTRYMKSWNacgt"
        shared = [rng.choice(letters) for _ in range(rng.randrange(0, 40))]
        changed = list(shared)
        for _ in range(rng.randrange(0, 4)):
            if changed:
                at = rng.randrange(len(changed))
                changed[at : at + rng.randrange(0, 3)] = [rng.choice(letters) for _ in range(rng.randrange(0, 4))]
        any_of = lambda: "".join(rng.choice(letters) for _ in range(rng.randrange(0, 15)))
        rows.append((any_of() + "".join(shared), "".join(changed) + any_of()))
    rows += [("", ""), ("", "ACGT"), ("ACGT", ""), ("A", "A"), ("A", "C"), ("ACGT", "ACGT"), ("R", "K"), ("R", "G"), ("N", "T")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)] + [(900, None, "A"), (901, "A", None)], "id long, a string, b string")
    got = {r.id: r.x for r in df.select("id", L.align_overlap(F.col("a"), F.col("b")).alias("x")).collect()}
    for i, (a, b) in enumerate(rows):
        assert tuple(got[i]) == plain(a, b), (a, b)
    assert all(v is None for i in (900, 901) for v in got[i])
    assert tuple(got[len(rows) - 3]) == (0, 1, 0, 0)  # R and K share a base, and neither holds the other
