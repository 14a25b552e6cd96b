"""Column functions on sequences, qualities, read names and alignments; all Spark built-ins.

Sequences are strings over the IUPAC alphabet; lower case is a soft mask. Functions keep null
for null unless they say otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# The IUPAC nucleotide codes, their complements, and their sets of bases (A=1 C=2 G=4 T=8).
IUPAC = {"A": 1, "C": 2, "M": 3, "G": 4, "R": 5, "S": 6, "V": 7, "T": 8, "W": 9, "Y": 10, "H": 11, "K": 12, "D": 13, "B": 14, "N": 15}
COMPLEMENT = {"A": "T", "C": "G", "G": "C", "T": "A", "M": "K", "R": "Y", "W": "W", "S": "S", "Y": "R", "K": "M", "V": "B", "H": "D", "D": "H", "B": "V", "N": "N"}

_FROM = "".join(COMPLEMENT) + "".join(COMPLEMENT).lower()
_TO = "".join(COMPLEMENT.values()) + "".join(COMPLEMENT.values()).lower()
#: Bases of a window that are read at once: substring() counts characters from the start of its string.
CHUNK = 256


def reverse_complement(seq: Column) -> Column:
    """reverse and complement, keeping case and IUPAC codes."""
    return F.reverse(F.translate(seq, _FROM, _TO))


def canonical(seq: Column) -> Column:
    """the smaller of a sequence and its reverse complement."""
    return F.least(seq, reverse_complement(seq))


def is_palindrome(seq: Column) -> Column:
    """equal to its own reverse complement."""
    return seq == reverse_complement(seq)


def is_edge_palindrome(seq: Column, forward: bool = True) -> Column:
    """whether the sequence without its first (or last) base is its own reverse complement."""
    inner = F.substr(seq, F.lit(2)) if forward else F.substr(seq, F.lit(1), F.length(seq) - 1)
    return is_palindrome(inner)


def ambiguity_mask(code: Column) -> Column:
    """the bases of an IUPAC code as a 4-bit set; null for other characters."""
    return F.create_map(*[x for k, v in IUPAC.items() for x in (F.lit(k), F.lit(v))])[F.upper(code)]


def ambiguity_code(mask: Column) -> Column:
    """the IUPAC code of a 4-bit set."""
    return F.create_map(*[x for k, v in IUPAC.items() for x in (F.lit(v), F.lit(k))])[mask]


def flatten_ambiguity(seq: Column) -> Column:
    """every ambiguity code replaced by the first base it stands for."""
    first = {k: next(b for b in "ACGT" if IUPAC[b] & v) for k, v in IUPAC.items()}
    return F.translate(seq, "".join(first) + "".join(first).lower(), "".join(first.values()) + "".join(first.values()).lower())


def colour_encode(seq: Column) -> Column:
    """the colour between each two bases (A0 C1 G2 T3, exclusive or); '.' beside another character."""
    codes = F.transform(F.split(F.translate(seq, "ACGTacgt", "01230123"), ""), lambda c: F.when(c.rlike("^[0-3]$"), c.cast("int")))
    pairs = F.zip_with(F.slice(codes, 1, F.greatest(F.size(codes) - 1, F.lit(0))), F.slice(codes, 2, F.greatest(F.size(codes) - 1, F.lit(0))), lambda a, b: F.coalesce(a.bitwiseXOR(b).cast("string"), F.lit(".")))
    return F.array_join(pairs, "")


def colour_decode(anchor: Column, colours: Column) -> Column:
    """bases of a colour string read on from its anchor base, which is left out."""
    start = F.struct(F.instr(F.lit("ACGT"), anchor).alias("at"), F.lit("").alias("seq"))
    step = lambda a, c: F.struct(((a["at"] - 1).bitwiseXOR(c.cast("int")) + 1).alias("at"), F.concat(a["seq"], F.substr(F.lit("ACGT"), (a["at"] - 1).bitwiseXOR(c.cast("int")) + 1, F.lit(1))).alias("seq"))
    return F.aggregate(F.filter(F.split(colours, ""), lambda c: c.rlike("^[0-3]$")), start, step, lambda a: a["seq"])


def windows(df: DataFrame, k: int, seq: str = "seq", name: str = "kmer", pos: str | None = None, valid: bool = True) -> DataFrame:
    """F8: one row for each k-window of seq (dropped from the output), without windows of other characters
    than ACGT if valid; pos names a column for the window's 0-based place.

    Long sequences are cut into overlapping chunks first, as substring() takes time in
    proportion to its offset."""
    others = [c for c in df.columns if c != seq]
    last = F.length(seq) - k
    cut = df.where(last >= 0).withColumn("__at", F.explode(F.sequence(F.lit(0), last, F.lit(CHUNK))))
    piece = F.substr(F.col(seq), F.col("__at") + 1, F.lit(CHUNK + k - 1))
    each = cut.select(*others, "__at", piece.alias("__piece"))
    each = each.select(*others, "__at", F.posexplode(F.transform(F.sequence(F.lit(1), F.length("__piece") - k + 1), lambda i: F.substr(F.col("__piece"), i, F.lit(k)))).alias("__i", name))
    if valid:
        each = each.where(F.col(name).rlike("^[ACGTacgt]+$"))
    return each.select(*others, *([(F.col("__at") + F.col("__i")).cast("long").alias(pos)] if pos else []), name)


def trim_masked(seq: Column) -> Column:
    """without lower-case ends."""
    return F.regexp_replace(seq, "^[a-z]+|[a-z]+$", "")


def _good(threshold: int, offset: int = 33) -> str:
    return rf"[\x{offset + threshold:02x}-\x7e]"


def quality_bounds(qual: Column, threshold: int) -> tuple[Column, Column]:
    """1-based start and length from the first to the last base of quality threshold or more;
    a read without any keeps its first base."""
    good = _good(threshold)
    lead = F.length(F.regexp_extract(qual, f"^([^{good[1:-1]}]*)", 1))
    kept = F.length(F.regexp_extract(qual, f"({good}(?:.*{good})?)", 1))
    return F.when(kept > 0, lead + 1).otherwise(1), F.when(kept > 0, kept).otherwise(1)


def quality_trim(seq: Column, qual: Column, threshold: int) -> tuple[Column, Column]:
    """seq and qual cut to quality_bounds()."""
    start, length = quality_bounds(qual, threshold)
    return F.substr(seq, start, length), F.substr(qual, start, length)


def quality_mask(seq: Column, qual: Column, threshold: int) -> Column:
    """bases of lower quality become N; an empty sequence stays empty."""
    masked = F.array_join(F.zip_with(F.split(seq, ""), F.split(qual, ""), lambda s, q: F.when(F.ascii(q) - 33 >= threshold, s).otherwise(F.when(s.isNotNull(), F.lit("N")))), "")
    return F.when(F.length(seq) > 0, masked).otherwise(seq)  # split() makes one empty base of an empty sequence


def quality_64_to_33(qual: Column) -> Column:
    """Phred+64 to Phred+33, negative qualities clamped to 0."""
    return F.array_join(F.transform(F.filter(F.split(qual, ""), lambda c: F.length(c) > 0), lambda c: F.chr(F.greatest(F.ascii(c) - 31, F.lit(33)))), "")


def pair_name(name: Column) -> Column:
    """a read name without /1 or /2."""
    return F.regexp_replace(name, "/[12]$", "")


def mate_name(name: Column) -> Column:
    """the name of a read's mate by its suffix: 1/2, A/B, F/R, f/r, F3/R3, forward/reverse; else the name itself. Both
    reads of a pair from an SRR archive have one name, which stays."""
    swaps = [("forward", "reverse"), ("F3", "R3"), ("1", "2"), ("A", "B"), ("F", "R"), ("f", "r")]
    out = name
    for a, b in reversed(swaps):
        out = F.when(name.endswith(a), F.concat(F.substr(name, F.lit(1), F.length(name) - len(a)), F.lit(b))).when(name.endswith(b), F.concat(F.substr(name, F.lit(1), F.length(name) - len(b)), F.lit(a))).otherwise(out)
    return F.when(name.startswith("SRR"), name).otherwise(out)


def strand_flip(name: Column, seq: Column) -> Column:
    """a strand-specific library's read turned to its transcript's strand: first reads of pairs, whose names end in /1, are
    reverse-complemented. A null name is no first read."""
    return F.when(name.endswith("/1"), reverse_complement(seq)).otherwise(seq)


def max_length_trim(seq: Column, longest: int) -> Column:
    """F16: the first `longest` bases, or qualities, of each read; shorter ones stay whole."""
    return F.left(seq, F.lit(longest))


def count_acgt(seq: Column) -> Column:
    """number of unambiguous bases."""
    return F.length(F.regexp_replace(seq, "[^ACGTacgt]", ""))


def spaced_mask(k: int, kind: str = "pair", arm: int = 0) -> str:
    """a seed as a string of 1 (used) and 0 (ignored) places. kind 'pair': two arms at the ends;
    'qr': quadratic residues of a prime length of 11 or more."""
    if kind == "pair":
        return "1" * arm + "0" * (k - 2 * arm) + "1" * arm
    if k < 11 or any(k % d == 0 for d in range(2, int(k**0.5) + 1)):
        raise ValueError("a quadratic-residue seed needs a prime length of 11 or more")
    residues = {i * i % k for i in range(1, k)} | {0}
    return "".join("1" if i in residues else "0" for i in range(k))


def masked_key(kmer: Column, mask: str) -> Column:
    """the bases of a window at a seed's used places."""
    runs, at = [], 0
    while at < len(mask):
        end = at
        while end < len(mask) and mask[end] == mask[at]:
            end += 1
        if mask[at] == "1":
            runs.append(F.substr(kmer, F.lit(at + 1), F.lit(end - at)))
        at = end
    return F.concat(*runs)


def inconsistent_overlap(u: Column, v: Column, overlap: Column) -> Column:
    """whether the last `overlap` bases of u cannot be the first of v under IUPAC codes."""
    tail, head = F.split(F.right(u, overlap), ""), F.split(F.left(v, overlap), "")
    return F.exists(F.zip_with(tail, head, lambda a, b: F.coalesce(ambiguity_mask(a).bitwiseAND(ambiguity_mask(b)) == 0, F.lit(True))), lambda x: x)


def allowed_error(sd: Column, d: int = 6) -> Column:
    """the distance error allowed for an estimate."""
    return F.ceil(3 * sd + d)


def gap_sequence(length: Column, k: int) -> Column:
    """F32: a run of N, in lower case if shorter than k."""
    return F.when(length < k, F.repeat(F.lit("n"), length)).otherwise(F.repeat(F.lit("N"), length))


def _cigar_sum(cigar: Column, ops: str) -> Column:
    lengths = F.regexp_extract_all(cigar, F.lit(rf"([0-9]+)[{ops}]"), F.lit(1))
    return F.aggregate(lengths, F.lit(0), lambda a, x: a + x.cast("int"))


def cigar_fields(cigar: Column) -> dict[str, Column]:
    """of a CIGAR string: whether it is valid, the lengths of query, aligned query and target span,
    and the clips at its ends. Other fields are null if it is invalid."""
    # no repeated groups that Java would recurse for: long reads have many thousand operations
    valid = (F.length(cigar) > 0) & (F.regexp_replace(cigar, "[0-9]+[MIDNSHPX=]", "") == "")
    of = lambda c: F.when(valid, c)
    clip = lambda rx, i: _cigar_sum(F.regexp_extract(cigar, rx, i), "SH")
    return {
        "valid": F.coalesce(valid, F.lit(False)),
        "query_length": of(_cigar_sum(cigar, "MISHX=")),
        "query_span": of(_cigar_sum(cigar, "MIX=")),
        "target_span": of(_cigar_sum(cigar, "MDNX=")),
        "clip_start": of(clip("^(?:[0-9]+[SH])++", 0)),
        "clip_end": of(clip("(?:^|[MIDNPX=])((?:[0-9]+[SH])*+)$", 1)),
    }


def target_at_query_start(pos: Column, clip: Column, span: Column, query_length: Column, reverse: Column) -> Column:
    """where a read's first base falls on the target; on the reverse strand where its last base ends."""
    return F.when(reverse, pos + span + (query_length - span - clip)).otherwise(pos - clip)


def has_flag(flag: Column, mask: int) -> Column:
    """whether any bit of a SAM flag mask is set."""
    return flag.bitwiseAND(mask) != 0


def si_number(x: float) -> str:
    """a number with an SI prefix, at most four digits."""
    for size, mark in ((1e12, "T"), (1e9, "G"), (1e6, "M"), (1e3, "k")):
        if abs(x) >= size:
            return f"{x / size:.4g}{mark}"
    return f"{x:.4g}"


def parse_si(s: str) -> float:
    """the inverse of si_number(), for bytes or counts."""
    marks = {"k": 1e3, "K": 1e3, "M": 1e6, "G": 1e9, "T": 1e12}
    s = s.strip().removesuffix("B")
    return float(s[:-1]) * marks[s[-1]] if s and s[-1] in marks else float(s)
