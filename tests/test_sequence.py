from pyspark.sql import functions as F

from skein.functions import sequence as S


def one(spark, **columns):
    df = spark.range(1)
    return df.select(*[c.alias(n) for n, c in columns.items()]).first()


def test_reverse_complement_keeps_case_and_codes(spark):
    r = one(spark, a=S.reverse_complement(F.lit("ACGTNacgtRY")), b=S.canonical(F.lit("TTTA")), c=S.is_palindrome(F.lit("ACGT")), d=S.is_edge_palindrome(F.lit("CACGT")))
    assert (r.a, r.b, r.c, r.d) == ("RYacgtNACGT", "TAAA", True, True)


def test_windows_of_a_read(spark):
    df = spark.createDataFrame([(1, "TAATGCCA"), (2, "TAAT"), (3, "TAANGCCATT"), (4, None)], "id int, seq string")
    got = [(r.id, r.pos, r.kmer) for r in S.windows(df, 5, pos="pos").orderBy("id", "pos").collect()]
    assert got == [(1, 0, "TAATG"), (1, 1, "AATGC"), (1, 2, "ATGCC"), (1, 3, "TGCCA"), (3, 4, "GCCAT"), (3, 5, "CCATT")]


def test_windows_across_chunks(spark):
    seq = "ACGTTGCA" * 100
    df = spark.createDataFrame([(seq,)], "seq string")
    got = [r.kmer for r in S.windows(df, 21, pos="pos").orderBy("pos").collect()]
    assert got == [seq[i : i + 21] for i in range(len(seq) - 20)]


def test_masking_keeps_empty_and_null_sequences(spark):
    df = spark.createDataFrame([(1, "", ""), (2, None, None), (3, "A", "#")], "id int, seq string, qual string")
    assert [r.x for r in df.select("id", S.quality_mask(F.col("seq"), F.col("qual"), 15).alias("x")).orderBy("id").collect()] == ["", None, "N"]


def test_qualities(spark):
    seq, qual = S.quality_trim(F.lit("ACGTA"), F.lit("#I#I#"), 20)
    allbad, _ = S.quality_trim(F.lit("ACGTA"), F.lit("#####"), 20)
    r = one(spark, seq=seq, qual=qual, allbad=allbad, mask=S.quality_mask(F.lit("ACGT"), F.lit("I#I#"), 20), q=S.quality_64_to_33(F.lit("@Bh;")))
    assert (r.seq, r.qual, r.allbad, r.mask, r.q) == ("CGT", "I#I", "A", "ANGN", "!#I!")


def test_cigar(spark):
    f = S.cigar_fields(F.lit("3S10M2D5I4M6S"))
    bad = S.cigar_fields(F.lit("3S10"))
    r = one(spark, **f)
    assert (r.valid, r.query_length, r.query_span, r.target_span, r.clip_start, r.clip_end) == (True, 28, 19, 16, 3, 6)
    assert one(spark, v=bad["valid"], q=bad["query_length"]) == (False, None)


def test_names_and_masks(spark):
    r = one(spark, a=S.mate_name(F.lit("x/1")), b=S.mate_name(F.lit("yF3")), c=S.pair_name(F.lit("z/2")), d=S.trim_masked(F.lit("acGTaCg")), e=S.flatten_ambiguity(F.lit("ANRY")), f=S.masked_key(F.lit("ACGTAC"), "110011"))
    assert tuple(r) == ("x/2", "yR3", "z", "GTaC", "AAAC", "ACAC")
    assert S.spaced_mask(11, "qr") == "11011100010"


def test_ambiguity_and_overlaps(spark):
    r = one(spark, a=S.inconsistent_overlap(F.lit("AAR"), F.lit("GCC"), F.lit(1)), b=S.inconsistent_overlap(F.lit("AAR"), F.lit("CCC"), F.lit(1)), c=S.ambiguity_code(F.lit(5)), d=S.ambiguity_mask(F.lit("n")))
    assert tuple(r) == (False, True, "R", 15)


def test_colours(spark):
    r = one(spark, c=S.colour_encode(F.lit("ATGCA")), d=S.colour_decode(F.lit("A"), S.colour_encode(F.lit("ATGCA"))))
    assert tuple(r) == ("3131", "TGCA")


def test_mates_of_archives_and_lower_case(spark):
    r = one(spark, a=S.mate_name(F.lit("SRR1.1")), b=S.mate_name(F.lit("xf")), c=S.mate_name(F.lit("xr")), d=S.mate_name(F.lit("xreverse")))
    assert (r.a, r.b, r.c, r.d) == ("SRR1.1", "xr", "xf", "xforward")


def test_packed_windows_equal_strings(spark):
    import random

    from skein.functions import packed as Q

    rng = random.Random(1)
    seqs = ["".join(rng.choice("ACGTacgtN") if rng.random() < 0.3 else rng.choice("ACGT") for _ in range(n)) for n in (0, 1, 5, 40, 400, 3000)] + [None, "ACGT" * 10]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(seqs)], "id long, seq string")
    complement = str.maketrans("ACGT", "TGCA")
    piece, Q.PIECE = Q.PIECE, 100
    try:
        for k in (1, 2, 5, 16, 21, 31):
            got = sorted((r.id, r.pos, r.kmer, r.forward) for r in Q.packed_windows(df, k, "id").select("id", "pos", Q.unpacked(F.col("code"), k).alias("kmer"), "forward").collect())
            want = []
            for i, s in enumerate(seqs):
                for p in range(len(s or "") - k + 1):
                    w = s[p : p + k].upper()
                    if set(w) <= set("ACGT"):
                        rc = w.translate(complement)[::-1]
                        want.append((i, p, min(w, rc), w <= rc))
            assert got == sorted(want)
    finally:
        Q.PIECE = piece


def test_cigars_of_long_reads(spark):
    n = 30_000
    rows = [("2H5S" + "3M1D" * n,), ("1M" * n + "3S2H",), ("5S3H",), ("3M4",), ("M",), ("",), (None,), ("4S10M2I3D6N5S",)]
    df = spark.createDataFrame(rows, "c string")
    got = [tuple(r) for r in df.select(*[c.alias(k) for k, c in S.cigar_fields(F.col("c")).items()]).collect()]
    none = (False, None, None, None, None, None)
    assert got == [(True, 7 + 3 * n, 3 * n, 4 * n, 7, 0), (True, n + 5, n, n, 0, 5), (True, 8, 0, 0, 8, 8), none, none, none, none, (True, 21, 12, 19, 4, 5)]
