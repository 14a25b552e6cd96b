"""Pairwise alignment of sequence columns; the kernels work on one pair at a time in vectorised pandas UDFs."""

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from skein.functions.sequence import IUPAC

# The scores of the global alignment.
MATCH, MISMATCH, GAP_OPEN, GAP_EXTEND = 5, -4, -12, -4

_LOW = -(10**9)
_MASK = np.zeros(256, np.uint8)
for _c, _m in IUPAC.items():
    _MASK[ord(_c)] = _MASK[ord(_c.lower())] = _m
_CODE = {m: c for c, m in IUPAC.items()}


def _masks(s: str) -> np.ndarray:
    return _MASK[np.frombuffer(s.encode("latin-1", "replace"), np.uint8)]


def _fits(x, y):
    """Whether one of two sets of bases holds the other."""
    both = x | y
    return (both == x) | (both == y)


def _next_row(row: np.ndarray, i: int, x: np.uint8, y: np.ndarray) -> np.ndarray:
    """Row i of the table of best scores (0 pairs, 1 gap in b, 2 gap in a) from the one before; a gap in a opens at the best place before."""
    at = np.arange(len(y) + 1, dtype=np.int32)
    new = np.empty_like(row)
    new[:, 0] = _LOW
    new[0, 1:] = row[:, :-1].max(axis=0) + np.where(_fits(x, y), MATCH, MISMATCH)
    new[1, 1:] = np.maximum(row[1] + GAP_EXTEND, np.maximum(row[0], row[2]) + GAP_OPEN)[1:]
    new[1, 0] = GAP_OPEN + GAP_EXTEND * (i - 1)
    opened = np.maximum.accumulate(np.maximum(new[0], new[1]) + GAP_OPEN - GAP_EXTEND * at)
    new[2, 1:] = opened[:-1] + GAP_EXTEND * at[:-1]
    return new


def global_alignment(a: str, b: str) -> tuple[str, int, int]:
    """L1: (consensus, matches, columns) of the best global alignment with affine gaps.

    Bases match if one's IUPAC set holds the other's; the consensus has the union of both, lower case
    where one has a gap. A row is a few vector operations. Every so many rows one is kept, as many as there are rows between
    two, and those between are made again on the way back: memory is the length of b times the root of that of a."""
    x, y = _masks(a), _masks(b)
    n, m = len(x), len(y)
    row = np.full((3, m + 1), _LOW, np.int32)
    row[0, 0] = 0
    row[2, 1:] = GAP_OPEN + GAP_EXTEND * np.arange(m)
    stride = max(1, int(n**0.5))
    kept = {0: row}
    for i in range(1, n + 1):
        row = _next_row(row, i, x[i - 1], y)
        if i % stride == 0:
            kept[i] = row
    block: dict[int, np.ndarray] = {n: row}

    def best(i: int) -> np.ndarray:
        if i not in block:
            block.clear()
            first = i // stride * stride
            block[first] = kept[first]
            for r in range(first + 1, i + 1):
                block[r] = _next_row(block[r - 1], r, x[r - 1], y)
        return block[i]

    i, j, state, out, matches = n, m, int(row[:, m].argmax()), [], 0
    while i or j:
        here = best(i)[state, j]
        if state == 0:
            matches += bool(_fits(x[i - 1], y[j - 1]))
            out.append(_CODE.get(int(x[i - 1] | y[j - 1]), "N"))
            i, j = i - 1, j - 1
            state = int(best(i)[:, j].argmax())
        elif state == 1:
            out.append(a[i - 1].lower())
            i -= 1
            now = best(i)[:, j]
            state = 1 if now[1] + GAP_EXTEND == here else (0 if now[0] >= now[2] else 2)
        else:
            out.append(b[j - 1].lower())
            j -= 1
            now = best(i)[:, j]
            state = 2 if now[2] + GAP_EXTEND == here else (0 if now[0] >= now[1] else 1)
    return "".join(reversed(out)), matches, len(out)


def align_global(a: Column, b: Column) -> Column:
    """L1 as a column function: consensus, matches and columns; nulls for null sequences."""

    def run(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        found = [global_alignment(s, t) if s is not None and t is not None else (None, None, None) for s, t in zip(a, b, strict=True)]
        return pd.DataFrame(found, columns=["consensus", "matches", "columns"])

    return F.pandas_udf(run, "consensus string, matches long, columns long")(a, b)


def overlap_alignment(a: str, b: str, match: int = MATCH, mismatch: int = MISMATCH, gap_open: int = GAP_OPEN, gap_extend: int = GAP_EXTEND) -> tuple[int, int, int, int]:
    """L3: (score, begin in a, end in b, matches) of the best alignment of a suffix of a with a prefix of b.

    Bases match if one's IUPAC set holds the other's. A cell keeps its best step alone: a pair, else a gap in b, else one in a; a gap
    is extended where that step was the same gap. Of ends of one score the first counts. Without a score over 0, as with an empty
    sequence, there is no overlap: score 0, begin at a's end, end 0. Rows run along anti-diagonals; a cell takes five bytes."""
    score, begin, end, consensus, matches = _overlap(a, b, match, mismatch, gap_open, gap_extend)
    return score, begin, end, matches


def _overlap(a: str, b: str, match: int = MATCH, mismatch: int = MISMATCH, gap_open: int = GAP_OPEN, gap_extend: int = GAP_EXTEND) -> tuple[int, int, int, str, int]:
    """Score, begin in a, end in b, consensus (unions, lower case where a base is or where one has a gap) and matches of overlap_alignment()."""
    x, y = _masks(a), _masks(b)
    n, m = len(x), len(y)
    h, step = np.zeros((n + 1, m + 1), np.int32), np.zeros((n + 1, m + 1), np.int8)
    h[0, 1:] = -(10**9)  # b begins inside a or at its start
    for d in range(2, n + m + 1):
        i = np.arange(max(1, d - m), min(n, d - 1) + 1)
        j = d - i
        pair = h[i - 1, j - 1] + np.where(_fits(x[i - 1], y[j - 1]), match, mismatch)
        down = h[i - 1, j] + np.where(step[i - 1, j] == 1, gap_extend, gap_open)
        right = h[i, j - 1] + np.where(step[i, j - 1] == 2, gap_extend, gap_open)
        ways = np.stack([pair, down, right])
        step[i, j], h[i, j] = ways.argmax(axis=0), ways.max(axis=0)
    end = int(h[n].argmax())
    i, j, matches, out = n, end, 0, []
    while j:
        if step[i, j] == 0:
            matches += bool(_fits(x[i - 1], y[j - 1]))
            c = _CODE.get(int(x[i - 1] | y[j - 1]), "N")
            out.append(c.lower() if a[i - 1].islower() or b[j - 1].islower() else c)
        else:
            out.append((a[i - 1] if step[i, j] == 1 else b[j - 1]).lower())
        i, j = i - (step[i, j] != 2), j - (step[i, j] != 1)
    return int(h[n, end]), int(i), end, "".join(reversed(out)), matches


def agreed(a: str, b: str) -> str | None:
    """The consensus of two sequences of one length, if at each place one set of bases holds the other: the union, but the other's
    base for an N; lower case where either is. None if they disagree."""
    if a == b:
        return a
    x, y = _masks(a), _masks(b)
    if not _fits(x, y).all():
        return None
    x, y = np.where(x == _MASK[ord("N")], y, x), np.where(y == _MASK[ord("N")], x, y)
    codes = (_CODE.get(int(c), "N") for c in x | y)
    return "".join(c.lower() if s.islower() or t.islower() else c for c, s, t in zip(codes, a, b, strict=True))


def joined(pieces: list[str], overlaps: list[int], least_match: int = 20, identity: float = 0.9) -> str:
    """Pieces laid over each other by so many bases each (0: put behind it; -1: one n between). Where the bases of an overlap do not agree, n at
    the end of what there is are taken off one by one, as long as they do not; else the overlap is aligned and its consensus taken if matches and
    identity are enough; else there is one n between."""
    out = pieces[0]
    for s, o in zip(pieces[1:], overlaps[1:], strict=True):
        o = int(min(o, len(out), len(s)))
        if o <= 0:
            out += ("n" if o < 0 else "") + s
            continue
        tail, cut = out[len(out) - o :], out
        both = agreed(tail, s[:o])
        while both is None and cut.endswith("n") and len(cut) > o:
            cut = cut[:-1]
            both = agreed(cut[len(cut) - o :], s[:o])
        if both is not None:
            out = cut[: len(cut) - o] + both + s[o:]
            continue
        _, begin, end, consensus, matches = _overlap(tail, s[:o])
        good = matches >= least_match and matches >= identity * len(consensus)
        out = out[: len(out) - o + begin] + consensus + s[end:] if good else out + "n" + s
    return out


def align_overlap(a: Column, b: Column) -> Column:
    """L3 as a column function."""

    def run(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        found = [overlap_alignment(s, t) if s is not None and t is not None else (None,) * 4 for s, t in zip(a, b, strict=True)]
        return pd.DataFrame(found, columns=["score", "begin", "end", "matches"])

    return F.pandas_udf(run, "score long, begin long, end long, matches long")(a, b)


def consensus_of(seqs: list[str]) -> str:
    """L2: a progressive multiple alignment of a group's sequences, longest first, as an IUPAC consensus."""
    order = sorted(seqs, key=lambda s: (-len(s), s))
    out = order[0]
    for s in order[1:]:
        out, _, _ = global_alignment(out.upper(), s)
    return out


def align_group(seqs: Column) -> Column:
    """L2 over an array column of a bounded group's sequences."""

    def run(seqs: pd.Series) -> pd.Series:
        return pd.Series([consensus_of([x for x in s if x]) if s is not None and any(s) else None for s in seqs])

    return F.pandas_udf(run, "string")(seqs)


def pop_similar(branches: DataFrame, identity: float = 0.9, most: int = 2) -> DataFrame:
    """C11: of branches (head, tail, contig_id, seq, mean_coverage) that join the same head and tail, at most `most`, those to drop: all but
    that of the highest coverage where every branch is similar enough to it. Lengths bound the identity before anything is aligned."""
    group = branches.groupBy("head", "tail").agg(F.array_sort(F.collect_list(F.struct((-F.col("mean_coverage")).alias("rank"), "contig_id", "seq"))).alias("b"))
    group = group.where(F.size("b").between(2, most)).withColumn("best", F.element_at("b", 1))
    others = group.select("head", "tail", "best", F.explode(F.slice("b", 2, most)).alias("o"))
    bound = F.least(F.length("best.seq"), F.length("o.seq")) / F.greatest(F.length("best.seq"), F.length("o.seq"))
    likely = others.where(bound >= identity)
    scored = likely.withColumn("x", align_global(F.col("best.seq"), F.col("o.seq"))).where(F.col("x.matches") >= identity * F.col("x.columns"))
    n = scored.groupBy("head", "tail").agg(F.count("*").alias("similar"), F.collect_list("o.contig_id").alias("dropped"))
    return n.join(group.select("head", "tail", F.size("b").alias("size")), ["head", "tail"]).where("similar = size - 1").select("head", "tail", F.explode("dropped").alias("contig_id"))
