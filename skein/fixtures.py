"""Reads, contigs, graphs and alignments derived from the supplied tables, in Spark and in SQL.

The supplied tables hold no sequences; each adapter exists twice with the same meaning, as a
DataFrame function and as the text of a DuckDB common table expression. Whole tables and
whole texts are used.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

ALPHABET = "abcdefghijklmnopqrstuvwxyz"
BASES = ("ACGT" * 7)[:26]
#: As BASES, with the bases of a and e soft-masked.
MASKED = "".join(b.lower() if a in "ae" else b for a, b in zip(ALPHABET, BASES, strict=True))
#: A Phred+33 quality for each letter, from 0 to 40; no quote or backslash is among them.
QUALITIES = "".join(chr(33 + q) if chr(33 + q) not in "'\\\"" else "I" for q in ((i * 7 + 2) % 41 for i in range(26)))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _letters(text):
    return F.lower(F.regexp_replace(text, "[^a-zA-Z]", ""))


def contigs(spark: SparkSession, sf_dir: str, name: str = "documents", key: str = "doc_id") -> DataFrame:
    """contigs(contig_id, seq): the letters of each text as bases."""
    return table(spark, sf_dir, name).select(F.col(key).alias("contig_id"), F.translate(_letters(F.col("text")), ALPHABET, BASES).alias("seq"))


def contigs_sql(name: str = "documents", key: str = "doc_id", cte: str = "contigs") -> str:
    return f"{cte} AS (SELECT {key} AS contig_id, translate(lower(regexp_replace(text,'[^a-zA-Z]','','g')),'{ALPHABET}','{BASES}') AS seq FROM {name})"


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """reads(id, seq, masked, qual): as contigs, with a soft-masked form and a quality for each base."""
    w = _letters(F.col("text"))
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.translate(w, ALPHABET, BASES).alias("seq"), F.translate(w, ALPHABET, MASKED).alias("masked"), F.translate(w, ALPHABET, QUALITIES).alias("qual"))


READS_SQL = f"""reads AS (SELECT doc_id AS id, translate(w,'{ALPHABET}','{BASES}') AS seq, translate(w,'{ALPHABET}','{MASKED}') AS masked, translate(w,'{ALPHABET}','{QUALITIES}') AS qual
 FROM (SELECT doc_id, lower(regexp_replace(text,'[^a-zA-Z]','','g')) AS w FROM documents))"""


def scaffolds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """scaffolds(scaffold_id, seq): lines of a text as sequences with ten N between them."""
    marked = F.regexp_replace(F.regexp_replace("text", "[^a-zA-Z]*\n[^a-zA-Z]*", "~"), "[^a-zA-Z~]", "")
    seq = F.replace(F.translate(F.lower(marked), ALPHABET, BASES), F.lit("~"), F.lit("N" * 10))
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("scaffold_id"), seq.alias("seq"))


SCAFFOLDS_SQL = f"""scaffolds AS (SELECT doc_id AS scaffold_id, replace(translate(lower(regexp_replace(regexp_replace(text,'[^a-zA-Z]*\\n[^a-zA-Z]*','~','g'),'[^a-zA-Z~]','','g')),'{ALPHABET}','{BASES}'),'~','NNNNNNNNNN') AS seq FROM documents)"""


def line_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_returnflag", "l_discount", "l_quantity", (F.col("l_partkey") * 10 + F.col("l_suppkey") % 10).alias("contig"), F.row_number().over(order).alias("rn"))


LINE_ITEMS_SQL = """li AS (SELECT l_orderkey, l_partkey, l_suppkey, l_returnflag, l_discount, l_quantity, l_partkey * 10 + l_suppkey % 10 AS contig,
 row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS rn FROM lineitem)"""


def estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """est(src, dst, n, distance): contigs that follow each other in orders, as distance estimates.

    A contig is a part with a tenth of its suppliers."""
    li = line_items(spark, sf_dir)
    nxt = Window.partitionBy("l_orderkey").orderBy("rn")
    steps = li.select(F.col("contig").alias("src"), F.lead("contig").over(nxt).alias("dst"), (F.col("l_quantity") + F.lead("l_quantity").over(nxt)).alias("q"))
    kept = steps.where("dst is not null and src <> dst")
    return kept.groupBy("src", "dst").agg(F.count("*").alias("n"), (F.min("q") - 60).cast("long").alias("distance"))


ESTIMATES_SQL = (
    LINE_ITEMS_SQL
    + """, est AS (SELECT a.contig AS src, b.contig AS dst, count(*) AS n, CAST(min(a.l_quantity + b.l_quantity) - 60 AS BIGINT) AS distance
 FROM li a JOIN li b ON a.l_orderkey = b.l_orderkey AND b.rn = a.rn + 1
 WHERE a.contig <> b.contig GROUP BY 1, 2)"""
)


def oriented_links(spark: SparkSession, sf_dir: str, apart: int = 1) -> DataFrame:
    """oe0(src, dst): contigs that follow each other in orders, or so many items apart, oriented; not closed under complement.

    A vertex is 2 * contig + strand, as everywhere in skein; its complement is the vertex xor 1."""
    li = line_items(spark, sf_dir)
    nxt = Window.partitionBy("l_orderkey").orderBy("rn")
    vertex = F.col("contig") * 2 + (F.col("l_returnflag") == "R").cast("long")
    steps = li.select(F.col("contig").alias("a"), F.lead("contig", apart).over(nxt).alias("b"), vertex.alias("src"), F.lead(vertex, apart).over(nxt).alias("dst"))
    return steps.where("b is not null and a <> b").select("src", "dst").distinct()


def oriented(spark: SparkSession, sf_dir: str, apart: int = 1) -> DataFrame:
    """oe(src, dst): oriented_links() closed under complement."""
    e = oriented_links(spark, sf_dir, apart)
    return e.union(e.select(F.col("dst").bitwiseXOR(F.lit(1)), F.col("src").bitwiseXOR(F.lit(1)))).distinct()


ORIENTED_SQL = (
    LINE_ITEMS_SQL
    + """, oe0 AS (SELECT DISTINCT a.contig * 2 + CAST(a.l_returnflag = 'R' AS BIGINT) AS src, b.contig * 2 + CAST(b.l_returnflag = 'R' AS BIGINT) AS dst
 FROM li a JOIN li b ON a.l_orderkey = b.l_orderkey AND b.rn = a.rn + 1
 WHERE a.contig <> b.contig),
oe AS (SELECT src, dst FROM oe0 UNION SELECT xor(dst, 1), xor(src, 1) FROM oe0)"""
)


#: sk(src, dst): as oe, of items two apart.
SKIPPING_SQL = """sk0 AS (SELECT DISTINCT a.contig * 2 + CAST(a.l_returnflag = 'R' AS BIGINT) AS src, b.contig * 2 + CAST(b.l_returnflag = 'R' AS BIGINT) AS dst
 FROM li a JOIN li b ON a.l_orderkey = b.l_orderkey AND b.rn = a.rn + 2
 WHERE a.contig <> b.contig),
sk AS (SELECT src AS u, dst AS v FROM sk0 UNION SELECT xor(dst, 1), xor(src, 1) FROM sk0)"""


def seed_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """seeds(path_id, nodes): for each contig, the items up to two before and after its first one in the first order that has it."""
    li = line_items(spark, sf_dir).withColumn("w", F.col("contig") * 2 + (F.col("l_returnflag") == "R").cast("long"))
    near = Window.partitionBy("l_orderkey").orderBy("rn").rowsBetween(-2, 2)
    around = li.select("contig", "w", "l_orderkey", "rn", F.collect_list("w").over(near).alias("nodes"))
    first = around.groupBy("contig").agg(F.min_by(F.struct("w", "nodes"), F.struct("l_orderkey", "rn")).alias("f"))
    turned = F.reverse(F.transform("f.nodes", lambda v: v.bitwiseXOR(F.lit(1))))
    return first.select(F.col("contig").alias("path_id"), F.when(F.col("f.w") % 2 == 1, turned).otherwise(F.col("f.nodes")).alias("nodes"))


def seed_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lengths(contig_id, length) of the contigs of seed_paths()."""
    return line_items(spark, sf_dir).select(F.col("contig").alias("contig_id"), (F.col("contig") % 50 + 1).alias("length")).distinct()


SEED_PATHS_SQL = (
    LINE_ITEMS_SQL
    + """, lw AS (SELECT contig, l_orderkey, rn, contig * 2 + CAST(l_returnflag = 'R' AS BIGINT) AS w FROM li),
ar AS (SELECT *, list(w) OVER (PARTITION BY l_orderkey ORDER BY rn ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS nodes FROM lw),
fi AS (SELECT * FROM ar QUALIFY row_number() OVER (PARTITION BY contig ORDER BY l_orderkey, rn) = 1),
seeds AS (SELECT contig AS path_id, CASE WHEN w % 2 = 1 THEN list_reverse(list_transform(nodes, lambda v: xor(v, 1))) ELSE nodes END AS nodes FROM fi)"""
)


def alignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """al(qname, read, rname, pos, reverse, unmapped): items 1 and 2, 3 and 4 ... of each order as read pairs, a last odd one as a mateless read."""
    return line_items(spark, sf_dir).select(
        (F.col("l_orderkey") * 1000 + F.floor((F.col("rn") - 1) / 2)).cast("long").alias("qname"),
        ((F.col("rn") - 1) % 2 + 1).alias("read"),
        (F.col("l_suppkey") % 10).alias("rname"),
        F.col("l_partkey").alias("pos"),
        (F.col("l_returnflag") == "R").alias("reverse"),
        (F.col("l_discount") < 0.01).alias("unmapped"),
    )


ALIGNMENTS_SQL = (
    LINE_ITEMS_SQL
    + """, al AS (SELECT l_orderkey * 1000 + (rn - 1) // 2 AS qname, (rn - 1) % 2 + 1 AS read, l_suppkey % 10 AS rname, l_partkey AS pos, l_returnflag = 'R' AS reverse, l_discount < 0.01 AS unmapped FROM li)"""
)


def histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """hist(value, n): whole parts of the events' values."""
    return table(spark, sf_dir, "events").groupBy(F.floor("value").cast("long").alias("value")).agg(F.count("*").alias("n"))


HISTOGRAM_SQL = "hist AS (SELECT CAST(floor(value) AS BIGINT) AS value, count(*) AS n FROM events GROUP BY 1)"
