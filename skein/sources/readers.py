"""Readers of sequence, alignment and graph text formats as DataFrames.

Files are read by Spark's own text sources, so any store and codec that Spark knows will do.
Multi-line records are split on their record mark, lines of fixed groups are numbered within
their file.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from skein.functions.sequence import has_flag, quality_64_to_33, reverse_complement
from skein.plans.iterate import materialize

READ_SCHEMA = "id string, comment string, seq string, qual string"


def read_fasta(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Id, comment, seq, qual (null), file: records of FASTA files, sequences over any number of lines.

    The text source is cut at '\\n>', so large files split into tasks."""
    raw = spark.read.option("lineSep", "\n>").text(path).select(F.regexp_replace("value", "^>", "").alias("r"), F.input_file_name().alias("file"))
    head = F.substring_index("r", "\n", 1)
    seq = F.regexp_replace(F.substr("r", F.length(head) + 2), r"[\r\n]|;.*", "")
    return raw.where(F.length(F.trim("r")) > 0).select(F.regexp_extract(head, r"^(\S*)", 1).alias("id"), F.nullif(F.trim(F.regexp_extract(head, r"^\S*\s*(.*)", 1)), F.lit("")).alias("comment"), seq.alias("seq"), F.lit(None).cast("string").alias("qual"), "file")


def read_fastq(spark: SparkSession, path: str | list[str], chastity: bool = True) -> DataFrame:
    """Id, comment, seq, qual of FASTQ records of four lines, from plain or compressed files.

    A file is one task's, which holds its text: a quality line may begin as a record does, so a file cannot be cut
    anywhere. Blank lines between records are passed over and records whose lengths differ are dropped; any other line out
    of place and a missing '+' are errors, as what follows could not be told apart. Comments of the form 1:Y:0:IDX mark filtered reads,
    dropped if chastity, and give the read number."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            for content, file in zip(x["value"].to_pylist(), x["file"].to_pylist(), strict=True):
                rows, lines, i = [], [s.rstrip("\r") for s in content.split("\n")], 0
                while i < len(lines):
                    if not lines[i]:
                        i += 1
                        continue
                    head, seq, plus, qual = (lines[i : i + 4] + [""] * 4)[:4]
                    if head[0] != "@" or plus[:1] != "+":
                        raise ValueError(f"{file}: no FASTQ record at line {i + 1}")
                    if len(seq) == len(qual):
                        name, _, comment = head[1:].partition(" ")
                        rows.append((name, comment or None, seq, qual))
                    i += 4
                columns = list(zip(*rows, strict=True)) or [[], [], [], []]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], ["id", "comment", "seq", "qual"])

    paths = [path] if isinstance(path, str) else path
    df = spark.read.text(paths, wholetext=True).select("value", F.input_file_name().alias("file")).mapInArrow(parse, READ_SCHEMA)
    return casava(df, chastity)


def casava(reads: DataFrame, chastity: bool = True) -> DataFrame:
    """S3: reads with ids ending in the read number of a comment 1:Y:0:IDX, filtered ones dropped if chastity."""
    marked = F.col("comment").rlike("^[12]:[YN]:")
    kept = reads.where(~F.coalesce(marked & (F.substr("comment", F.lit(3), F.lit(1)) == "Y"), F.lit(False))) if chastity else reads
    return kept.withColumn("id", F.when(marked, F.concat("id", F.lit("/"), F.left("comment", F.lit(1)))).otherwise(F.col("id")))


def read_sam(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Qname, flag, rname, pos (0-based), mapq, cigar, mrnm (= spelled out), mpos, isize, seq, qual, tags; '*' is null."""
    f = F.split("value", "\t")
    star = lambda c: F.nullif(c, F.lit("*"))
    raw = spark.read.text(path).where(~F.col("value").startswith("@") & (F.size(f) >= 9))
    get = lambda i: F.get(f, F.lit(i))
    return raw.select(
        get(0).alias("qname"), get(1).cast("int").alias("flag"), star(get(2)).alias("rname"), (get(3).cast("long") - 1).alias("pos"), get(4).cast("int").alias("mapq"), star(get(5)).alias("cigar"),
        star(F.when(get(6) == "=", get(2)).otherwise(get(6))).alias("mrnm"), (get(7).cast("long") - 1).alias("mpos"), get(8).cast("long").alias("isize"), star(get(9)).alias("seq"), star(get(10)).alias("qual"), F.slice(f, 12, 1000).alias("tags"),
    )


def sam_reads(sam: DataFrame, chastity: bool = True) -> DataFrame:
    """SAM records as reads: secondary ones dropped (0x100), failed ones too if chastity (0x200), read numbers from flags,
    reverse ones turned back, a BX tag as comment."""
    kept = sam.where(~has_flag(F.col("flag"), 0x100))
    if chastity:
        kept = kept.where(~has_flag(F.col("flag"), 0x200))
    number = F.when(has_flag(F.col("flag"), 0x40), "/1").when(has_flag(F.col("flag"), 0x80), "/2").otherwise("")
    turned = has_flag(F.col("flag"), 0x10)
    bx = F.substr(F.get(F.filter("tags", lambda t: t.startswith("BX:Z:")), F.lit(0)), F.lit(6))
    return kept.select(F.concat("qname", number).alias("id"), bx.alias("comment"), F.when(turned, reverse_complement(F.col("seq"))).otherwise(F.col("seq")).alias("seq"), F.when(turned, F.reverse("qual")).otherwise(F.col("qual")).alias("qual"))


def read_qseq(spark: SparkSession, path: str | list[str], chastity: bool = True) -> DataFrame:
    """Reads of qseq (11 fields) and export (22 fields) lines, qualities turned to Phred+33, failed ones dropped if chastity."""
    f = F.split("value", "\t")
    get = lambda i: F.get(f, F.lit(i))
    raw = spark.read.text(path)
    name = F.concat(F.concat_ws("_", get(0), get(1)), F.lit(":"), F.concat_ws(":", *[get(i) for i in range(2, 6)]), F.when(F.coalesce(get(7), F.lit("")) != "", F.concat(F.lit("/"), get(7))).otherwise(""))
    last = F.when(F.size(f) == 11, get(10)).otherwise(get(21))
    ok = last.isin("1", "Y") if chastity else F.lit(True)
    return raw.where(F.size(f).isin(11, 22) & ok).select(name.alias("id"), F.lit(None).cast("string").alias("comment"), F.translate(get(8), ".", "N").alias("seq"), quality_64_to_33(get(9)).alias("qual"))


def read_kmer_counts(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Kmer, n of a k-mer count dump in FASTA form (>count, k-mer); counts of 1 at least."""
    raw = read_fasta(spark, path)
    return raw.select(F.upper("seq").alias("kmer"), F.greatest(F.lit(1), F.ceil(F.col("id").cast("double"))).cast("long").alias("n"))


def interleave(*reads: DataFrame) -> DataFrame:
    """Records of several tables (at, ...) by their number `at`, one of each in turn: turn, file, and their columns."""
    out = None
    for i, r in enumerate(reads):
        part = r.withColumn("file", F.lit(i))
        out = part if out is None else out.unionByName(part)
    return out.withColumnRenamed("at", "turn").orderBy("turn", "file")


def fasta_index(records: DataFrame, order: str) -> DataFrame:
    """Order, id, offset, size: where each sequence begins when all are put end to end in the order of a column.

    Offsets are running sums of sizes within ranges of the column plus the ranges' totals, so no task sees all."""
    from pyspark.sql import Window

    from skein.plans.iterate import materialize

    sized = materialize(records.select(order, "id", F.length("seq").cast("long").alias("size")).repartitionByRange(order).withColumn("part", F.spark_partition_id()))
    totals, at = {}, 0
    for p, s in sorted(sized.groupBy("part").agg(F.sum("size")).collect()):  # a row for each partition
        totals[p], at = at, at + s
    base = F.create_map(*[x for p, v in totals.items() for x in (F.lit(p), F.lit(v))]) if totals else None
    run = F.sum("size").over(Window.partitionBy("part").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return sized.select(order, "id", ((base[F.col("part")] if totals else F.lit(0)) + run - F.col("size")).alias("offset"), "size")


def _vertex(name: Column, sign: Column) -> Column:
    return F.concat(name, sign)


def read_adj(spark: SparkSession, path: str | list[str]) -> tuple[DataFrame, DataFrame]:
    """(vertices(name, length, coverage), edges(u, v, distance)) of an ADJ file: id length coverage ; out ; in; vertex names end in + or -."""
    raw = spark.read.text(path).select(F.split("value", ";").alias("p"))
    head = F.split(F.trim(F.get("p", F.lit(0))), r"\s+")
    v = raw.select(F.get(head, F.lit(0)).alias("name"), F.get(head, F.lit(1)).cast("long").alias("length"), F.coalesce(F.get(head, F.lit(2)), F.lit("0")).cast("long").alias("coverage"))

    def side(i: int, out: bool) -> DataFrame:
        hits = F.regexp_extract_all(F.coalesce(F.get("p", F.lit(i)), F.lit("")), F.lit(r"(\S+?[+-])(?=\s|$)"), F.lit(1))
        dist = F.regexp_extract_all(F.coalesce(F.get("p", F.lit(i)), F.lit("")), F.lit(r"\S+?[+-]\s*(\[d=-?[0-9]+\])?"), F.lit(1))
        each = raw.select(F.get(head, F.lit(0)).alias("name"), F.explode(F.arrays_zip(hits.alias("t"), dist.alias("d"))).alias("x"))
        d = F.regexp_extract("x.d", "-?[0-9]+", 0)
        e = each.select("name", F.col("x.t").alias("t"), F.when(d != "", d.cast("long")).alias("distance"))
        flip = F.concat(F.substr("t", F.lit(1), F.length("t") - 1), F.when(F.col("t").endswith("+"), "-").otherwise("+"))
        return e.select(F.concat("name", F.lit("+")).alias("u"), F.col("t").alias("v"), "distance") if out else e.select(F.concat("name", F.lit("-")).alias("u"), flip.alias("v"), "distance")

    return v, side(1, True).union(side(2, False))


def read_dot(spark: SparkSession, path: str | list[str]) -> tuple[DataFrame, DataFrame]:
    """(vertices(name, length, coverage), edges(u, v, distance, sd, n)) of a DOT file; attributes not given are null."""
    raw = spark.read.text(path)
    attr = lambda k: F.nullif(F.regexp_extract("value", rf"\b{k}=\"?(-?[0-9.]+)", 1), F.lit(""))
    edge = r"^\s*\"([^\"]+)\"\s*->\s*\"([^\"]+)\""
    e = raw.where(F.col("value").rlike(edge)).select(F.regexp_extract("value", edge, 1).alias("u"), F.regexp_extract("value", edge, 2).alias("v"), attr("d").cast("long").alias("distance"), attr("e").cast("double").alias("sd"), attr("n").cast("long").alias("n"))
    vertex = r"^\s*\"([^\"]+)\"\s*\["
    v = raw.where(F.col("value").rlike(vertex)).select(F.regexp_extract("value", vertex, 1).alias("name"), attr("l").cast("long").alias("length"), attr("C").cast("long").alias("coverage"))
    return v, e


def read_gfa(spark: SparkSession, path: str | list[str]) -> tuple[DataFrame, DataFrame]:
    """(vertices(name, seq, length), edges(u, v, distance)) of a GFA file, version 1 (S, L) or 2 (S, E)."""
    raw = spark.read.text(path).select(F.split("value", "\t").alias("f"))
    g = lambda i: F.get("f", F.lit(i))
    two = F.col("f")[2].rlike("^[0-9]+$")
    tag = F.regexp_extract(F.array_join("f", "\t"), r"LN:i:([0-9]+)", 1)
    seq = F.nullif(F.when(two, g(3)).otherwise(g(2)), F.lit("*"))
    length = F.coalesce(F.when(two, g(2).try_cast("long")), F.nullif(tag, F.lit("")).try_cast("long"), F.length(seq).cast("long"))
    v = raw.where(g(0) == "S").select(g(1).alias("name"), seq.alias("seq"), length.alias("length"))
    one = raw.where(g(0) == "L").select(F.concat(g(1), g(2)).alias("u"), F.concat(g(3), g(4)).alias("v"), (-F.regexp_extract(g(5), "^([0-9]+)M", 1).try_cast("long")).alias("distance"))
    span = lambda a, b: F.regexp_replace(b, r"\$", "").try_cast("long") - F.regexp_replace(a, r"\$", "").try_cast("long")
    both = raw.where(g(0) == "E").select(g(2).alias("u"), g(3).alias("v"), (-span(g(4), g(5))).alias("distance"))
    return v, one.union(both)


def read_asqg(spark: SparkSession, path: str | list[str]) -> tuple[DataFrame, DataFrame]:
    """(vertices(name, seq), edges(u, v, distance)) of an ASQG file: VT and ED lines."""
    raw = spark.read.text(path).select(F.split("value", "\t").alias("f"))
    g = lambda i: F.get("f", F.lit(i))
    v = raw.where(g(0) == "VT").select(g(1).alias("name"), g(2).alias("seq"))
    p = F.split(g(1), " ")
    n = lambda i: F.get(p, F.lit(i)).try_cast("long")
    rc = F.get(p, F.lit(8)) == "1"
    from_start = n(2) == 0
    e = raw.where(g(0) == "ED").select(F.concat(F.get(p, F.lit(0)), F.when(from_start, "-").otherwise("+")).alias("u"), F.concat(F.get(p, F.lit(1)), F.when(from_start != rc, "-").otherwise("+")).alias("v"), (n(2) - n(3) - 1).alias("distance"))
    return v, e


def read_dist(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """edges(u, v, distance, n, sd) of a distance-estimate file: id then target,distance,pairs,sd ... ; the other strand's."""
    raw = spark.read.text(path).select(F.split("value", ";").alias("p"))
    name = F.regexp_extract(F.get("p", F.lit(0)), r"^(\S+)", 1)

    def side(i: int, sign: str) -> DataFrame:
        part = F.coalesce(F.get("p", F.lit(i)), F.lit(""))
        each = raw.select(name.alias("name"), F.explode(F.regexp_extract_all(part, F.lit(r"(\S+[+-],-?[0-9]+,[0-9]+,[0-9.]+)"), F.lit(1))).alias("x")).select("name", F.split("x", ",").alias("x"))
        t = F.col("x")[0]
        v = t if sign == "+" else F.concat(F.substr(t, F.lit(1), F.length(t) - 1), F.when(t.endswith("+"), "-").otherwise("+"))
        return each.select(F.concat("name", F.lit(sign)).alias("u"), v.alias("v"), F.col("x")[1].cast("long").alias("distance"), F.col("x")[2].cast("long").alias("n"), F.col("x")[3].cast("double").alias("sd"))

    return side(0, "+").union(side(1, "-"))


def numbered(vertices: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A read graph as operators and writers take it: (contigs(contig_id, name ...), edges(u, v ...)) of vertices (name ...) and edges
    (u, v ...) between names with + or -. A vertex becomes 2 * contig_id + strand; contig_ids are unique, with
    gaps. Names that only edges have are contigs too, with nulls. Of parallel edges all stay."""
    plain = lambda c: F.expr(f"left({c}, length({c}) - 1)")
    names = vertices.select("name").union(edges.select(plain("u"))).union(edges.select(plain("v"))).distinct()
    ids = materialize(names.withColumn("contig_id", F.monotonically_increasing_id()))  # written once, so the numbers stay
    ids = ids.hint("merge")  # names and numbers in order are files of a tenth of what a driver would hold of them
    end = lambda x: ids.select(F.col("name").alias(f"__{x}"), (F.col("contig_id") * 2).alias(f"__id_{x}"))
    met = edges.withColumns({"__u": plain("u"), "__v": plain("v")}).join(end("u"), "__u").join(end("v"), "__v")
    strand = lambda c: F.when(F.col(c).endswith("-"), F.lit(1)).otherwise(F.lit(0))
    e = met.withColumns({"u": F.col("__id_u") + strand("u"), "v": F.col("__id_v") + strand("v")}).select(*edges.columns)
    return ids.join(vertices, "name", "left"), e


def named(contigs: DataFrame, edges: DataFrame) -> DataFrame:
    """The inverse of numbered() for edges: u and v as names with + or -, by contigs (contig_id, name)."""
    end = lambda x: contigs.select(F.col("contig_id").alias(f"__{x}"), F.col("name").alias(f"__name_{x}"))
    met = edges.withColumns({"__u": F.shiftright("u", 1), "__v": F.shiftright("v", 1)}).join(end("u"), "__u").join(end("v"), "__v")
    sign = lambda c: F.when(F.col(c) % 2 == 1, "-").otherwise("+")
    return met.withColumns({"u": F.concat("__name_u", sign("u")), "v": F.concat("__name_v", sign("v"))}).select(*edges.columns)


def numbered_paths(paths: DataFrame, contigs: DataFrame) -> DataFrame:
    """path_id, nodes of read paths (path_id, nodes as names with + or -, runs of N as 12N) as numbers, by contigs (contig_id, name): vertices,
    and gaps as negative lengths, as merge_contigs() takes them."""
    each = paths.select("path_id", F.posexplode("nodes").alias("at", "n"))
    gap = F.col("n").rlike("^[0-9]+N$")
    size = F.expr("left(n, length(n) - 1)")
    met = each.select("path_id", "at", "n", gap.alias("gap"), size.alias("name")).join(contigs.select("name", "contig_id"), "name", "left")
    vertex = F.when(F.col("gap"), -F.col("name").try_cast("long")).otherwise(F.col("contig_id") * 2 + F.when(F.col("n").endswith("-"), 1).otherwise(0))
    return met.groupBy("path_id").agg(F.array_sort(F.collect_list(F.struct("at", vertex.alias("w")))).alias("x")).select("path_id", F.transform("x", lambda s: s["w"]).alias("nodes"))


def read_histogram(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Value, n of a two-column file."""
    return spark.read.csv(path, sep="\t", schema="value long, n long")


def read_paths(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """path_id, nodes: names with + or -; runs of N as e.g. 12N."""
    f = F.split("value", "\t")
    return spark.read.text(path).select(F.get(f, F.lit(0)).alias("path_id"), F.split(F.trim(F.get(f, F.lit(1))), r"\s+").alias("nodes"))


def read_kmer_set(spark: SparkSession, *paths: str, how: str = "union") -> DataFrame:
    """K-mer tables written as Parquet, joined as they are read: union or intersect."""
    sets = [spark.read.parquet(p).select("kmer") for p in paths]
    out = sets[0]
    for s in sets[1:]:
        out = out.union(s) if how == "union" else out.intersect(s)
    return out.distinct()
