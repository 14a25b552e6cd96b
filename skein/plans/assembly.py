"""The assembler's stages put together: unitigs, contigs, scaffolds, and their statistics."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from skein.operators import alignments as A, contigs as C, debruijn as G, histogram as H, kmers as K, paths as P
from skein.plans.iterate import materialize


@dataclass(frozen=True)
class Parameters:
    """k-mer size; thresholds of coverage (None: from the histogram), erosion and tips; pairs and lengths for scaffolds."""

    k: int = 31
    kc: int = 2
    erosion: int | None = None
    tips: int | None = None
    least_coverage: float | None = None
    bubbles: int | None = None
    seed: int = 50
    pairs: int = 10
    scaffold_length: int = 1000


def unitigs(reads: DataFrame, p: Parameters) -> DataFrame:
    """contig_id, seq, length, coverage of the reads' (seq) unitigs, numbered from the longest on."""
    kmers = materialize(K.apply_threshold(K.count_kmers(reads, p.k), p.kc))
    found = K.coverage_parameters(K.coverage_histogram(kmers))
    u = G.assemble(
        reads, p.k, p.kc, erosion=p.erosion if p.erosion is not None else int(found["e"]), both=int(found["E"]), tips=p.tips if p.tips is not None else p.k, least_coverage=p.least_coverage or 0, bubbles=p.bubbles if p.bubbles is not None else 3 * p.k
    )
    return materialize(number(u.select("seq", "coverage")))


def number(seqs: DataFrame) -> DataFrame:
    """contig_id, seq, length, coverage: ids from 0 by length, then sequence; by ranges, so that no task sorts all."""
    from skein.sources.readers import fasta_index

    keyed = seqs.withColumn("order", F.struct((-F.length("seq")).alias("n"), "seq"))
    one = keyed.select("order", F.lit("").alias("id"), F.lit("x").alias("seq"))
    at = fasta_index(one, "order").select("order", F.col("offset").alias("contig_id"))
    return keyed.join(at, "order").select("contig_id", "seq", F.length("seq").cast("long").alias("length"), "coverage")


def overlap_graph(contigs: DataFrame, k: int) -> DataFrame:
    """Edges of contigs that overlap by k - 1 bases."""
    return materialize(C.exact_overlaps(contigs, k - 1))


def contigs_of(unitig: DataFrame, p: Parameters) -> DataFrame:
    """Unambiguous paths of unitigs merged, and the unitigs on none, numbered anew."""
    e = overlap_graph(unitig, p.k)
    paths = materialize(C.assemble_paths(e).select(F.col("head").alias("path_id"), "nodes"))
    merged = P.merge_contigs(paths, unitig.select("contig_id", "seq", "coverage"), e, p.k)
    used = paths.select(F.explode("nodes").alias("w")).select((F.col("w") / 2).cast("long").alias("contig_id")).distinct()
    alone = unitig.join(used, "contig_id", "left_anti")
    return materialize(number(merged.select("seq", "coverage").union(alone.select("seq", "coverage"))))


def scaffolds_of(contig: DataFrame, pairs: DataFrame, p: Parameters) -> DataFrame:
    """scaffold steps of contigs linked by mapped read pairs (as of alignments.pair_up())."""
    pmf = materialize(A.fragment_distribution(A.fragment_sizes(pairs)))
    fragments = materialize(A.linking_fragments(pairs, contig.select(F.col("contig_id").alias("rname"), "length")))
    e = materialize(C.add_complements(A.estimate_by_median(fragments, pmf, p.pairs)))
    return C.scaffold_paths(C.scaffold_graph(e, contig, p.pairs, p.scaffold_length), e)


def statistics(named: dict[str, DataFrame], least: int = 500) -> DataFrame:
    """A10 for each of several sets of sequences (seq)."""
    out = None
    for name, df in named.items():
        part = df.select(F.lit(name).alias("name"), F.length("seq").alias("length"))
        out = part if out is None else out.union(part)
    return H.contiguity(out, ["name"], least)
