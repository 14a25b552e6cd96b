from pyspark.sql import functions as F

from skein.operators import contigs as C
from skein.plans import assembly
from skein.sources import readers as R, writers as W
from skein.streaming import kmers as S


def put(tmp_path, name, text):
    p = tmp_path / name
    p.write_text(text)
    return str(p)


def test_fasta_and_fastq(spark, tmp_path):
    fa = put(tmp_path, "a.fa", ">x one two\nACGT\nAC\n>y\nTTTT\n")
    assert [(r.id, r.comment, r.seq) for r in R.read_fasta(spark, fa).orderBy("id").collect()] == [("x", "one two", "ACGTAC"), ("y", None, "TTTT")]
    fq = put(tmp_path, "a.fq", "@r1 1:N:0:A\nACGT\n+\nIIII\n@r2 2:Y:0:A\nAC\n+\n@I\n@r3\nAC\n+\nI\n")
    assert [(r.id, r.seq) for r in R.read_fastq(spark, fq).collect()] == [("r1/1", "ACGT")]
    assert R.read_fastq(spark, fq, chastity=False).count() == 2


def test_sam(spark, tmp_path):
    sam = put(tmp_path, "a.sam", "@HD\n" + "\t".join("q 83 c1 11 60 4M = 1 -14 AACG IIIJ BX:Z:bc".split()) + "\n" + "\t".join("q 256 c1 11 60 4M * 0 0 AACG IIIJ".split()) + "\n")
    df = R.read_sam(spark, sam)
    assert [(r.pos, r.mrnm, r.mpos) for r in df.collect()] == [(10, "c1", 0), (10, None, -1)]
    assert tuple(R.sam_reads(df).first()) == ("q/1", "bc", "CGTT", "JIII")
    assert W.sam(df).first().value.split("\t")[3:8] == ["11", "60", "4M", "=", "1"]


def test_qseq_and_kmers(spark, tmp_path):
    q = put(tmp_path, "a.qseq", "\t".join(["M", "1", "2", "3", "4", "5", "0", "1", "AC.T", "hhBh", "1"]) + "\n" + "\t".join(["M", "1", "2", "3", "4", "6", "0", "1", "ACGT", "hhhh", "0"]) + "\n")
    assert [tuple(r) for r in R.read_qseq(spark, q).collect()] == [("M_1:2:3:4:5/1", None, "ACNT", "II#I")]
    k = put(tmp_path, "k.fa", ">3\nacgt\n>0.2\nTTTT\n")
    assert sorted(map(tuple, R.read_kmer_counts(spark, k).collect())) == [("ACGT", 3), ("TTTT", 1)]


def test_graphs_round_trip(spark, tmp_path):
    contigs = spark.createDataFrame([(0, "ACGTACGTAA", 5), (1, "CGTAATTTTT", 6)], "contig_id long, seq string, coverage long").withColumn("length", F.length("seq").cast("long"))
    e = C.add_complements(spark.createDataFrame([(0, 2, -6)], "u long, v long, distance long"))
    edges = {("0+", "1+", -6)}
    closed = edges | {("1-", "0-", -6)}
    for name, lines, read, want in (
        ("g.adj", W.adj(e, contigs), R.read_adj, closed),
        ("g.dot", W.dot(e, contigs), R.read_dot, closed),
        ("g.gfa", W.gfa1(e, contigs), R.read_gfa, edges),
        ("g2.gfa", W.gfa2(e, contigs), R.read_gfa, edges),
        ("g.asqg", W.asqg(e, contigs), R.read_asqg, edges),
    ):
        path = str(tmp_path / name)
        lines.write.text(path)
        v, got = read(spark, path)
        assert {(r.u, r.v, r.distance) for r in got.collect()} == want, name
        assert v.count() in (2, 4), name


def test_estimates_paths_and_index(spark, tmp_path):
    e = C.add_complements(spark.createDataFrame([(0, 2, 10, 5, 1.5), (0, 5, -3, 2, 2.0)], "u long, v long, distance long, n long, sd double"))
    path = str(tmp_path / "d")
    W.dist(e).write.text(path)
    got = {(r.u, r.v, r.distance, r.n, r.sd) for r in R.read_dist(spark, path).collect()}
    assert got == {("0+", "1+", 10, 5, 1.5), ("0+", "2-", -3, 2, 2.0), ("1-", "0-", 10, 5, 1.5), ("2+", "0-", -3, 2, 2.0)}
    p = put(tmp_path, "p", "1\t3+ 4- 12N 5+\n")
    assert R.read_paths(spark, p).first().nodes == ["3+", "4-", "12N", "5+"]
    records = spark.createDataFrame([(i, f"s{i}", "A" * (i + 1)) for i in range(5)], "at long, id string, seq string")
    assert [r.offset for r in R.fasta_index(records, "at").orderBy("at").collect()] == [0, 1, 3, 6, 10]
    both = R.interleave(records, records.where("at < 2"))
    assert [(r.turn, r.file) for r in both.collect()][:5] == [(0, 0), (0, 1), (1, 0), (1, 1), (2, 0)]


def test_stream_counts_equal_batch(spark, tmp_path):
    rows = [(i, s) for i, s in enumerate(["ACGTACGT", "TTTTACG", "GGGACGT"])]
    src = str(tmp_path / "in")
    spark.createDataFrame(rows, "id long, seq string").repartition(3).write.parquet(src)
    S.run_available(S.stream_counts(S.stream_reads(spark, src), 4), "counted", str(tmp_path / "ck"))
    from skein.operators import kmers as K

    want = {r.kmer: r.n for r in K.coverage(K.count_kmers(spark.read.parquet(src), 4)).collect()}
    assert {r.kmer: r.n for r in spark.table("counted").collect()} == want


def test_assembly_plan(spark):
    import random

    g = "".join(random.Random(1).choices("ACGT", k=500))
    reads = spark.createDataFrame([(g[i : i + 70],) for i in range(0, 431, 2)], "seq string")
    p = assembly.Parameters(k=21, kc=1, erosion=0, tips=21, bubbles=40)
    u = assembly.unitigs(reads, p)
    rc = g[::-1].translate(str.maketrans("ACGT", "TGCA"))
    assert [r.seq for r in u.collect()] == [min(g, rc)]
    assert [r.seq for r in assembly.contigs_of(u, p).collect()] == [min(g, rc)]
    assert assembly.statistics({"unitigs": u}, 100).first()["n50"] == 500


def test_compressed_and_broken_fastq(spark, tmp_path):
    import gzip

    import pytest

    with gzip.open(tmp_path / "a.fastq.gz", "wt") as f:
        f.write("@r1 1:N:0:A\nACGT\n+\n@III\n\n@r2\nAC\n+r2\n@@\n")
    got = [(r.id, r.seq, r.qual) for r in R.read_fastq(spark, str(tmp_path / "a.fastq.gz")).orderBy("id").collect()]
    assert got == [("r1/1", "ACGT", "@III"), ("r2", "AC", "@@")]
    (tmp_path / "b.fastq").write_text("@r1\nACGT\n+\nIIII\nACGT\n@r2\nAC\n+\nII\n")
    with pytest.raises(Exception, match="no FASTQ record at line 5"):
        R.read_fastq(spark, str(tmp_path / "b.fastq")).collect()


def test_a_read_graph_is_rewritten_and_named_again(spark, tmp_path):
    from skein.operators import contigs as C

    (tmp_path / "g.adj").write_text("x 10 2\t; y+ z-\t;\ny 12 3\t;\t; x-\nz 9 1\t; x-\t;\n")
    vertices, edges = R.read_adj(spark, str(tmp_path / "g.adj"))
    contigs, e = R.numbered(vertices, edges)
    assert {r.name: r.length for r in contigs.collect()} == {"x": 10, "y": 12, "z": 9}
    ids = {r.name: r.contig_id for r in contigs.collect()}
    assert all(isinstance(r.u, int) for r in e.collect())
    closed = C.add_complements(e.select("u", "v").distinct())
    back = {(r.u, r.v) for r in R.named(contigs, closed).collect()}
    assert {("x+", "y+"), ("x+", "z-"), ("z+", "x-"), ("y-", "x-")} <= back
    paths = spark.createDataFrame([(1, ["x+", "12N", "z-"])], "path_id long, nodes array<string>")
    assert R.numbered_paths(paths, contigs).first().nodes == [2 * ids["x"], -12, 2 * ids["z"] + 1]
