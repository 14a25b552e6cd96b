"""K-mer graphs, contig graphs and gaps against brute force on small random genomes."""

import random

import numpy as np
from pyspark.sql import functions as F

from skein.operators import align as L, alignments as A, contigs as C, debruijn as G, gaps as B, histogram as H, kmers as K, paths as P

FLIP = str.maketrans("ACGT", "TGCA")


def rc(s):
    return s[::-1].translate(FLIP)


def canon(s):
    return min(s, rc(s))


def genome(n, seed=1):
    return "".join(random.Random(seed).choices("ACGT", k=n))


def reads_of(spark, g, size=60, step=7):
    rows = [(i, g[i : i + size] if i % 2 else rc(g[i : i + size])) for i in range(0, len(g) - size + 1, step)] + [(len(g), g[-size:])]
    return spark.createDataFrame(rows, "id long, seq string")


def brute_unitigs(kmers):
    both = set(kmers) | {rc(x) for x in kmers}
    nxt = {u: [v for b in "ACGT" if (v := u[1:] + b) in both] for u in both}
    prev = {u: [v for b in "ACGT" if (v := b + u[:-1]) in both] for u in both}

    def link(u):
        return nxt[u][0] if len(nxt[u]) == 1 and len(prev[nxt[u][0]]) == 1 and nxt[u][0] != rc(u) else None

    has_back = {link(u) for u in both if link(u)}
    out = set()
    for u in both - has_back:
        s = u
        while v := link(u):
            s, u = s + v[-1], v
        out.add(canon(s))
    return out


def test_counts_and_strands(spark):
    df = spark.createDataFrame([("AACGTT",), ("TTACG",)], "seq string")
    got = {r.kmer: (r.cov_fwd, r.cov_rev) for r in K.count_kmers(df, 3).collect()}
    want = {}
    for s in ("AACGTT", "TTACG"):
        for i in range(len(s) - 2):
            w = s[i : i + 3]
            f, r = want.get(canon(w), (0, 0))
            want[canon(w)] = (f + (w == canon(w)), r + (w != canon(w)))
    assert got == want


def test_unitigs_of_a_genome_and_of_errors(spark):
    g = genome(400)
    for errors in (False, True):
        reads = reads_of(spark, g)
        if errors:
            reads = reads.union(spark.createDataFrame([(999, g[100:130] + ("A" if g[130] != "A" else "C") + g[131:160])], "id long, seq string"))
        kmers = K.count_kmers(reads, 15)
        got = {r.seq for r in G.unitigs(kmers).collect()}
        assert got == brute_unitigs([r.kmer for r in kmers.collect()])


def test_strand_flips_do_not_matter(spark):
    g = genome(300, 5)
    a = reads_of(spark, g)
    b = a.select("id", F.reverse(F.translate("seq", "ACGT", "TGCA")).alias("seq"))
    assert {r.seq for r in G.assemble(a, 15).collect()} == {r.seq for r in G.assemble(b, 15).collect()}


def test_bubbles_tips_and_erosion(spark):
    g = genome(300, 2)
    snp = g[:150] + ("A" if g[150] != "A" else "C") + g[151:]
    reads = reads_of(spark, g).union(reads_of(spark, g)).union(reads_of(spark, snp[100:200], 60, 5))
    kept, alleles = G.pop_bubbles(K.count_kmers(reads, 15), 15, 40)
    assert alleles.count() == 2
    assert {r.seq for r in G.unitigs(kept).collect()} == {canon(g)}
    tip = reads_of(spark, g).union(spark.createDataFrame([(1, g[80:110] + rc(g[3:8]))], "id long, seq string"))
    assert {r.seq for r in G.unitigs(G.trim_tips(K.count_kmers(tip, 15), 15, 10)).collect()} == {canon(g)}
    eroded = {r.kmer for r in G.erode(K.count_kmers(tip, 15), 2).collect()}
    assert canon(g[140:155]) in eroded


def test_erosion_ends_when_no_weak_end_is_left(spark):
    g = genome(260, 12)
    texts = [g[:150], g[:150], g[60:200], g[100:] + genome(60, 13), g[20:50] + genome(50, 14), genome(40, 15), "ACGTACGTACGTACGTACGTACG"]
    kmers = K.count_kmers(spark.createDataFrame([(t,) for t in texts], "seq string"), 11)
    left = {r.kmer: r.cov_fwd + r.cov_rev for r in kmers.collect()}
    rounds = 0
    while True:
        both = set(left) | {rc(x) for x in left}
        end = {x for x in left if left[x] < 2 and not (any(x[1:] + b in both for b in "ACGT") and any(b + x[:-1] in both for b in "ACGT"))}
        if not end:
            break
        left, rounds = {x: n for x, n in left.items() if x not in end}, rounds + 1
    assert rounds > 20
    assert {r.kmer for r in G.erode(kmers, 2, max_rounds=5).collect()} == set(left)


def test_first_minimum_and_parameters(spark):
    minimum = lambda *n: K.first_local_minimum({v: c for v, c in enumerate(n, 1) if c})
    assert minimum(100, 50, 10, 20, 30, 40, 50, 60) == 3
    assert minimum(100, 10, 20, 30) == 2  # the histogram may end before it has risen four times
    assert minimum(100, 50, 10) == 0 and minimum() == 0 and minimum(5) == 0
    assert K.first_local_minimum({1: 9, 4: 2, 9: 3, 20: 4, 30: 5, 31: 6, 99: 1}) == 4
    hist = spark.createDataFrame([(1, 100), (2, 50), (3, 10), (4, 20), (5, 30), (6, 40), (7, 50), (8, 60)], "value long, n long")
    assert K.coverage_parameters(hist)["e"] >= 2


def test_histogram_cases(spark):
    h = spark.createDataFrame([(2, 1), (4, 1), (6, 1), (8, 1), (10, 5)], "value long, n long")
    assert H.statistics(h).first()["size"] == 9
    noisy = spark.createDataFrame([(10, 5), (20, 10)], "value long, n long")
    assert [(r.value, r.n) for r in H.remove_noise(noisy).collect()] == [(20, 10)]
    lengths = spark.createDataFrame([("a", n) for n in (500, 600, 700, 1000, 100)], "g string, length long")
    r = H.contiguity(lengths, ["g"], 500).first()
    assert (r.n_all, r.n, r.n50, r.l50, r.total) == (5, 4, 700, 2, 2800)


def test_paths_are_assembled_once(spark):
    e = C.add_complements(spark.createDataFrame([(0, 2), (2, 4), (4, 6), (8, 6)], "u long, v long"))
    got = [r.nodes for r in C.assemble_paths(e).collect()]
    assert got in ([[0, 2, 4]], [[5, 3, 1]])


def test_circles_have_no_head(spark):
    links = spark.createDataFrame([(0, 1), (1, 2), (2, 0), (5, 6)], "u long, v long")
    got = {r.w: r.head for r in G.chains(links, spark.createDataFrame([(i,) for i in (0, 1, 2, 5, 6)], "w long")).collect()}
    assert got == {0: None, 1: None, 2: None, 5: 5, 6: 5}


def test_shims_are_bridged(spark):
    contigs = spark.createDataFrame([(0, 100), (1, 30), (2, 100)], "contig_id long, length long")
    e = C.add_complements(spark.createDataFrame([(0, 2, -20), (2, 4, -20)], "u long, v long, distance long"))
    got = {(r.u, r.v, r.distance) for r in C.remove_shims(e, contigs, 50, 1, 10).collect()}
    assert got == {(0, 4, -10), (5, 1, -10)}


def test_walks_are_bounded_by_distance_and_solutions(spark):
    # 0 leads to 1 over a chain of 12 edges and over each of 150 others of 250; 400 has a loop that does not grow
    chain = [0, *range(2, 13), 1]
    e = [*zip(chain, chain[1:])] + [(0, i) for i in range(100, 350)] + [(i, 1) for i in range(100, 250)] + [(0, 400), (400, 401), (401, 400)]
    graph = spark.createDataFrame([(u, v, -10) for u, v in e], "u long, v long, distance long")
    lengths = spark.createDataFrame([(w, 10 if w >= 400 else 11) for w in {w for x in e for w in x}], "w long, length long")
    pairs = spark.createDataFrame([(7, 0, 1)], "pair long, u long, v long")
    got = {tuple(r.nodes): r.distance for r in P.walks(graph, pairs, lengths, 11, None).collect()}
    assert got == {tuple(chain): 1} | {(0, i, 1): -9 for i in range(100, 250)}
    assert P.walks(graph, pairs, lengths, 10, None).count() == 150
    assert P.walks(graph, pairs, lengths, 11, 2).count() == 150
    assert P.walks(graph, pairs, lengths, 11, None, most_walks=150).count() == 0


def test_likeliest_distance_of_a_hot_pair(spark, monkeypatch):
    fit = A.likeliest_distance
    rng = random.Random(3)
    draws = {(0, 2): [round(rng.gauss(60, 8)) for _ in range(3000)], (2, 4): [55, 58, 58, 61], (4, 6): [50]}
    values = np.exp(-(((np.arange(120) - 90) / 10) ** 2)) + 1e-6
    want = {k: fit(np.array(v), values, 200, 200, -100, 120) for k, v in draws.items() if len(v) > 1}
    fragments = spark.createDataFrame([(*k, x) for k, v in draws.items() for x in v], "u long, v long, size long")
    pmf = spark.createDataFrame([(i, float(x)) for i, x in enumerate(values)], "value long, p double")
    lengths = spark.createDataFrame([(i, 200) for i in range(4)], "rname long, length long")
    got = A.estimate_by_likelihood(fragments, pmf, lengths, 2, -100, 120)
    assert {(r.u, r.v): (r.distance, r.n) for r in got.collect()} == want
    # what reaches the fit is a histogram
    sizes, counts = np.unique(draws[0, 2], return_counts=True)
    monkeypatch.setattr(A, "SIZES_AT_ONCE", 7)
    assert fit(sizes, values, 200, 200, -100, 120, counts) == want[0, 2]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [u#" in plan and "size#" in plan.split("Aggregate [u#")[1].splitlines()[0]


def test_merge_contigs(spark):
    g = genome(200, 3)
    contigs = spark.createDataFrame([(0, g[:90], 5), (1, rc(g[70:150]), 6), (2, g[140:], 7)], "contig_id long, seq string, coverage long")
    paths = spark.createDataFrame([(1, [0, 3, 4]), (2, [0, -5, 4])], "path_id long, nodes array<long>")
    e = spark.createDataFrame([(0, 3, -20), (3, 4, -10)], "u long, v long, distance long")
    got = {r.path_id: (r.seq, r.coverage) for r in P.merge_contigs(paths, contigs, e, 11).collect()}
    assert got == {1: (g, 18), 2: (g[:90] + "NNNNN" + g[140:], 12)}


def test_gaps_are_closed(spark):
    g = genome(300, 4)
    scaffold = spark.createDataFrame([(7, g[:120] + "N" * 40 + g[150:])], "scaffold_id long, seq string")
    r = B.close_gaps(scaffold, reads_of(spark, g), [21], 60, least=1).first()
    assert (r.seq.upper(), r.closed) == (g, 1)
    parts = [(x.begin, x.end, x.kind) for x in B.agp(scaffold).orderBy("part").collect()]
    assert parts == [(1, 120, "W"), (121, 160, "N"), (161, 310, "W")]


def test_reads_are_corrected_and_merged(spark):
    g = genome(200, 6)
    wrong = g[:50] + ("A" if g[50] != "A" else "C") + g[51:100]
    kmers = K.kmer_set(reads_of(spark, g), 15)
    df = spark.createDataFrame([(1, wrong), (2, g[20:90])], "id long, seq string")
    assert {r.id: r.seq for r in B.correct_reads(df, kmers, 15).collect()} == {1: g[:100], 2: g[20:90]}
    pair = spark.createDataFrame([(1, g[:60], rc(g[30:90]))], "id long, seq1 string, seq2 string")
    assert B.merge_pairs(pair, 20).first().seq == g[:90]


def test_alignment_kernels():
    assert L.global_alignment("ACGT", "ACGT") == ("ACGT", 4, 4)
    consensus, matches, columns = L.global_alignment("ACGTACGTAC", "ACGTCGTAC")
    assert (matches, columns) == (9, 10) and consensus.upper().replace("A", "") .count("G") == 2
    g = genome(60, 8)
    assert L.overlap_alignment(g[:40], g[25:])[1:] == (25, 15, 15)
    assert L.consensus_of(["ACGTAC", "ACGAAC", "ACGTAC"]) == "ACGWAC"


def test_repeat_support(spark):
    g = genome(400, 9)
    rep = g[100:130]
    contigs = {0: g[:110], 1: rep, 2: g[120:220], 3: genome(100, 10) + rep[:10], 4: rep[-10:] + genome(100, 11)}
    c = spark.createDataFrame(list(contigs.items()), "contig_id long, seq string")
    e = C.add_complements(spark.createDataFrame([(0, 2), (6, 2), (2, 4), (2, 8)], "u long, v long"))
    ways = P.repeat_paths(e).where("r = 2")
    got = {(r.a, r.b): r.state for r in P.path_support(ways, c, reads_of(spark, g, 80, 3), 40, 10).collect()}
    assert got[0, 4] == "supported" and got[6, 8] == "unsupported"


def test_substitutions_against_brute_force(spark):
    rnd = random.Random(3)
    g = genome(400, 5)
    other = "".join(b if rnd.random() > 0.05 else rnd.choice("ACGT") for b in g)
    kmers = {canon(other[i : i + 9]) for i in range(len(g) - 8)} | {canon(g[i : i + 9]) for i in range(0, 300)}
    solid = {canon(g[i : i + 9]) for i in range(len(g) - 8)}
    want = set()
    for x in kmers - solid:
        for i in range(9):
            for b in "ACGT".replace(x[i], ""):
                y = canon(x[:i] + b + x[i + 1 :])
                if y in solid:
                    want.add((x, y))
    frame = lambda s: spark.createDataFrame([(x,) for x in s], "kmer string")
    got = [tuple(r) for r in K.substitutions(frame([*kmers, *kmers, "ACGTNACGT"]), frame(solid)).collect()]
    assert want and sorted(got) == sorted(want)
    assert K.substitutions(frame([]), frame([])).count() == 0


def test_pair_edges_against_brute_force(spark):
    g = genome(200, 8)
    pairs = K.kmer_pairs(spark.createDataFrame([(g,)], "seq string"), 3, 10)
    both = {(g[i : i + 3], g[i + 7 : i + 10]) for i in range(len(g) - 9)}
    both |= {(rc(b), rc(a)) for a, b in both}
    want = {(a, b, x, y) for a, b in both for x, y in both if a[1:] == x[:-1] and b[1:] == y[:-1]}
    got = [tuple(r) for r in G.pair_edges(pairs).collect()]
    assert len(got) == len(want) and set(got) == want


def test_junctions_and_layout(spark):
    # 0 - 2 - 4 is a chain through 2; 6 has two successors, so 8 has no say over it
    e = [(0, 2), (2, 4), (6, 8), (6, 10), (8, 12)]
    closed = e + [(v ^ 1, u ^ 1) for u, v in e]
    frame = lambda rows: spark.createDataFrame(rows, "u long, v long")
    graph = frame(closed)
    found = {tuple(r) for r in C.junctions(graph, frame([(0, 4), (6, 12), (0, 8)])).collect()}
    assert found == {(0, 2, 4), (6, 8, 12)}
    paths = [r["nodes"] for r in C.junction_paths(graph, frame([(0, 4)])).collect()]
    assert paths in ([[0, 2, 4]], [[5, 3, 1]])
    assert C.junctions(graph, frame([])).count() == 0
    extra = closed + [(0, 4), (5, 1)]
    forms = lambda rows: {min(tuple(r["nodes"]), tuple(x ^ 1 for x in reversed(r["nodes"]))) for r in rows.collect()}
    assert forms(C.layout(frame(extra))) == {(0, 2, 4), (8, 12)}
    assert (0, 2, 4) not in forms(C.layout(frame(extra), reduce=False))
    assert forms(C.layout(frame(extra), spark.createDataFrame([(0,), (2,)], "w long"))) == {(0, 2)}


def test_solid_runs_of_many_batches_make_no_row_for_a_window(spark, monkeypatch):
    from skein.functions import packed

    monkeypatch.setattr(packed, "LOOKUP", 300)
    rng, k = random.Random(5), 7
    texts = ["".join(rng.choices("ACGT" if i % 4 else "ACGTN", k=rng.choice([0, 3, 7, 40, 200, 900]))) for i in range(60)] + [None, "acgtacgtACGTAC", "A" * 500]
    reads = spark.createDataFrame(list(enumerate(texts)), "id long, seq string").repartition(3)
    seen = [canon(x) for t in texts for i in range(len(t or "") - k + 1) if "N" not in (x := t.upper()[i : i + k])]
    solid = {x for x in seen if rng.random() < 0.8 and x != canon("ACGTACG")}
    kmers = spark.createDataFrame([(x,) for x in solid], "kmer string")
    runs, hits = {}, {}
    for i, t in enumerate(texts):
        ok = [canon(t.upper()[j : j + k]) in solid if "N" not in t[j : j + k] else False for j in range(len(t or "") - k + 1)]
        hits[i], n = sum(ok), 0
        for j, x in enumerate(ok):
            n = n + 1 if x else 0
            if n > runs.get(i, (0, 0))[0]:
                runs[i] = n, j - n + 1
    trimmed = K.trim_to_solid(reads, kmers, k, "id")
    assert {(r.id, r.start, r.seq) for r in trimmed.collect()} == {(i, at, texts[i][at : at + n + k - 1]) for i, (n, at) in runs.items()}
    judged = K.solidity(reads, kmers, k, "id")
    assert {r.id: r.n_solid for r in judged.collect()} == hits
    assert not any("forward#" in df._jdf.queryExecution().executedPlan().toString() for df in (trimmed, judged))
    assert K.trim_to_solid(reads, kmers.where("false"), k, "id").count() == 0 and K.solidity(reads.where("false"), kmers, k, "id").count() == 0


def test_contained_sequences_by_digests(spark):
    rng = random.Random(3)
    base = ["".join(rng.choices("ACGT", k=n)) for n in (400, 300, 90)] + ["A" * 200, "ACGTTGCA" * 30 + "N" + "GATTACA" * 9]
    cut = [s[i : i + n] for s in base for i, n in ((0, 25), (0, 60), (7, 40), (len(s) - 50, 50), (20, 24), (30, 55)) if i + n <= len(s)]
    seqs = base + cut + [rc(s) for s in cut[::2]] + base[:1] + [rc(base[1]), base[0][:50] + base[1][:50], base[0][:80].lower(), None, "", "N" * 30, "ACGTNNNNNN" * 5, ("ACGTNNNNNN" * 5)[4:40]]
    seqs += [base[2][:45] + x for x in ("A", "C", "G", "T", "")]
    rng.shuffle(seqs)
    up = {i: s.upper() for i, s in enumerate(seqs) if s and len(s) >= 25}
    inside = lambda i, j: (len(up[j]) > len(up[i]) or (len(up[j]) == len(up[i]) and j < i)) and (up[i] in up[j] or rc(up[i]) in up[j])
    want = {i for i in up if any(inside(i, j) for j in up if i != j)}
    df = spark.createDataFrame(list(enumerate(seqs)), "contig_id long, seq string").repartition(4)
    assert {r.contig_id for r in A.contained_sequences(df).collect()} == want and 10 < len(want) < len(up)
    assert A.contained_sequences(df.where("false")).count() == 0


def test_candidates_of_containment_carry_no_sequences(spark, monkeypatch):
    """Each candidate had both sequences, and each window was a string: 300 texts of a common beginning made 300 squared such rows."""
    rows, keep = [], A.packed_windows
    monkeypatch.setattr(A, "packed_windows", lambda *a, **b: rows.append(keep(*a, **b)) or rows[-1])
    rng = random.Random(8)
    head = "".join(rng.choices("ACGT", k=60))
    df = spark.createDataFrame([(i, head + "".join(rng.choices("ACGT", k=600 + i % 7))) for i in range(300)], "contig_id long, seq string")
    assert A.contained_sequences(df).count() == 0
    assert rows[0].count() < 300 * 60


def test_erosion_of_random_sets_equals_plain_rounds(spark, monkeypatch):
    """The edges of all k-mers were made in each round."""
    calls = []
    monkeypatch.setattr(G, "edges", lambda *a: calls.append(1))
    for seed, k, e, both in ((1, 5, 3, 0), (2, 4, 3, 1), (3, 7, 2, 0)):
        rng = random.Random(seed)
        text = "".join(rng.choices("ACGT", k=45 if k == 4 else 260)) + "A" * 12
        rows = {canon(text[i : i + k]): (rng.randint(0, 3), rng.randint(0, 2)) for i in range(len(text) - k + 1) if rng.random() < 0.9}
        left = dict(rows)
        while True:
            weak = [x for x, (f, r) in left.items() if f + r < e or min(f, r) < both]
            end = lambda x: any(all(canon(b + w[:-1]) not in left for b in "ACGT") for w in (x, rc(x)))
            gone = [x for x in weak if end(x)]
            if not gone:
                break
            for x in gone:
                del left[x]
        df = spark.createDataFrame([(x, *c) for x, c in rows.items()], "kmer string, cov_fwd long, cov_rev long")
        assert {(r.kmer, r.cov_fwd, r.cov_rev) for r in G.erode(df, e, both).collect()} == {(x, *c) for x, c in left.items()} and len(left) < len(rows)
    assert not calls and G.erode(df.where("kmer = 'none'"), 2).count() == 0
