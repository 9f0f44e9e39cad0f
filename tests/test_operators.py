"""Miniatures whose results are worked out by hand, and properties."""

import math
import pathlib
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pyspark.sql.datasource import EqualTo, GreaterThan, StringContains

from weftline import functions as W
from weftline import sources as S
from weftline.operators import blocks as B
from weftline.operators import clustering as CL
from weftline.operators import columns as C
from weftline.operators import intervals as I
from weftline.operators import kmers as K
from weftline.operators import mappings as M
from weftline.operators import neighbours as N
from weftline.operators import phylogeny as P
from weftline.operators import similarity as Y
from weftline.operators import statistics as T
from weftline.sources import packed
from weftline.sources.files import FilesWriter, write_whole

PART = "array<struct<src:string,start:bigint,size:bigint,strand:string,src_size:bigint,text:string>>"


def blocks_of(spark, *rows):
    return spark.createDataFrame([(k, [tuple(c) for c in comps]) for k, comps in enumerate(rows)], f"block_id long, components {PART}")


def texts(df):
    return [[c["text"] for c in r["components"]] for r in df.orderBy("block_id").collect()]


def comp(text, src="hg17.chr1", start=0, size=None, strand="+", src_size=1000):
    return (src, start, len(text) if size is None else size, strand, src_size, text)


def test_extend_and_windows(spark):
    one = spark.createDataFrame([("chr1", 4, 20)], "chrom string, start long, end long")
    assert [tuple(r) for r in I.extend(one, 10, 5).collect()] == [("chr1", 0, 25)]
    for size, want, literal in ((25, [(0, 10), (10, 20), (20, 25)], [(0, 10), (10, 20), (20, 30)]), (20, [(0, 10), (10, 20)], [(0, 10), (10, 20), (20, 30)])):
        chroms = spark.createDataFrame([("hg17", "chr1", size)], "build string, chrom string, size long")
        assert sorted((r.start, r.end) for r in I.genome_windows(chroms, "hg17", 10).collect()) == want
        assert sorted((r.start, r.end) for r in I.genome_windows(chroms, "hg17", 10, literal=True).collect()) == literal


def test_translate_filter_symbols(spark):
    assert texts(B.translate_chars(blocks_of(spark, [comp("A#=X@x-")]))) == [["A-***x-"]]
    three = blocks_of(spark, [comp("A*A"), comp("**C"), comp("CCG")])
    assert B.filter_max_wildcards(three, 2, 1).count() == 1
    assert B.filter_max_wildcards(three, 3, 1).count() == 0
    pair = blocks_of(spark, [comp("AT"), comp("CT")], [comp(""), comp("")])
    mapping = spark.createDataFrame([("AC", "3")], "key string, symbol string")
    assert [r.symbols for r in B.to_symbols(pair, mapping).collect()] == ["3 -1"]
    assert [list(r.symbols) for r in B.sequence_symbols(spark.createDataFrame([("ACGT-*N",), ("",)], "seq string")).collect()] == [[0, 1, 2, 3, 4, 5, -1], []]


def test_mapping_operators(spark):
    m = spark.createDataFrame([("A-", "1"), ("A*", "2"), ("**", "3")], "key string, symbol string")
    assert {tuple(r) for r in M.convert_missing(m, 1, True).collect()} == {("A-", "1"), ("A*", "1"), ("**", "-1")}
    a = spark.createDataFrame([("AAA", "4")], "key string, symbol string")
    b = spark.createDataFrame([("4", "2")], "key string, symbol string")
    assert [tuple(r) for r in M.compose(a, b).collect()] == [("AAA", "2")]
    with pytest.raises(Exception, match="no symbol"):
        M.compose(a, b.where("key = '5'")).collect()
    words = {r.row: r.word for r in M.ordered_words(spark, 2).collect()}
    assert words[1] == "1 0 0" and words[4] == "0 0 1" and len(words) == 8


def test_kmers_and_chain(spark):
    s = spark.createDataFrame([(1, [1, 2, 1, 2]), (2, [5]), (3, [])], "seq_id long, ints array<int>")
    assert {(r.kmer, r["count"]) for r in K.kmer_counts(s, 2).collect()} == {("1 2", 2), ("2 1", 1)}
    assert {(r.kmer, r["count"]) for r in K.kmer_counts(s, 2, literal=True).collect()} == {("1 2", 1), ("2 1", 1)}
    assert {(r.prev, r.next, r.p) for r in K.transitions(s).collect()} == {(1, 2, 1.0), (2, 1, 1.0)}
    w = K.profile_weights(s, k=2, runs=20)
    assert {tuple(r) for r in w.collect()} == {tuple(r) for r in w.collect()}


def test_partition_overlap(spark):
    iv = spark.createDataFrame([(1, "chr1", 0, 10), (2, "chr2", 0, 10), (3, "chr1", 5, 5)], "row_idx long, chrom string, start long, end long")
    parts = spark.createDataFrame([(0, "P1", "7", "chr1", 8, 20), (0, "P1", "7", "chr1", 9, 15)], "ord int, name string, score string, chrom string, start long, end long")
    got = {r.row_idx: (r.name, r.score, r.frac_overlap) for r in I.first_partition(iv, parts).collect()}
    assert got == {1: ("P1", "7", "0.2000"), 2: ("OTHER", "-1", "1.0000"), 3: ("OTHER", "-1", "1.0000")}


def test_merge_is_cover(spark):
    rng = np.random.default_rng(3)
    rows = [("c", int(s), int(s + n)) for s, n in zip(rng.integers(0, 300, 60), rng.integers(0, 12, 60), strict=True)]
    got = I.merge_overlaps(spark.createDataFrame(rows, "chrom string, start long, end long")).orderBy("start").collect()
    covered = {p for _, s, e in rows for p in range(s, e)}
    assert {p for r in got for p in range(r.start, r.end)} == covered
    assert all(a.end < b.start for a, b in zip(got, got[1:], strict=False))


def test_stretches_of_an_order(spark, monkeypatch):
    """Runs and covers that go on over stretches; sparse, negative and repeated keys."""
    monkeypatch.setattr(B, "STRETCH", 4)
    rng = np.random.default_rng(8)
    keys = [int(k) for k in rng.integers(-(10**15), 10**15, 300)]
    got = B.dense_order(spark.createDataFrame([(k,) for k in keys + keys[:9]], "k long"), "k").collect()
    assert [r.k for r in sorted(got, key=lambda r: r._place)] == sorted(keys + keys[:9]) and sorted(r._place for r in got) == list(range(1, 310))
    breaks = {0, 3, 4, 29, 30, 31}
    at, rows, want = 0, [], []
    for k in range(40):
        at += 3 * (k in breaks)
        rows.append([comp("AC", start=at)])
        want = [*want, [k, "AC"]] if k in breaks else [*want[:-1], [want[-1][0], want[-1][1] + "AC"]]
        at += 2
    got = B.fuse_adjacent(blocks_of(spark, *rows)).orderBy("block_id").collect()
    assert [[r.block_id, r.components[0].text] for r in got] == want
    spans = [("c", int(s), int(s + n)) for s, n in zip(rng.integers(0, 900, 90), rng.integers(0, 40, 90), strict=True)] + [("d", 0, 500), ("d", 10, 20), ("d", 490, 501), ("e", 5, 6)]
    for cell in (4, 65_536):
        cover = I.merge_overlaps(spark.createDataFrame(spans, "chrom string, start long, end long"), cell=cell).collect()
        for c in "cde":
            assert {p for r in cover if r.chrom == c for p in range(r.start, r.end)} == {p for x, s, e in spans if x == c for p in range(s, e)}
            own = sorted((r.start, r.end) for r in cover if r.chrom == c)
            assert all(a[1] < b[0] for a, b in zip(own, own[1:], strict=False))


def test_fusing(spark):
    a = [comp("AC", start=0), comp("GT", "mm5.chr2", start=5)]
    b = [comp("G", start=2), comp("T", "mm5.chr2", start=7)]
    c = [comp("A", start=3), comp("A", "mm5.chr2", start=9)]
    got = B.fuse_adjacent(blocks_of(spark, a, b, c)).orderBy("block_id").collect()
    assert [(r.block_id, r.n_blocks, [x.text for x in r.components]) for r in got] == [(0, 2, ["ACG", "GTT"]), (2, 1, ["A", "A"])]
    need = B.require_species(blocks_of(spark, [comp("A-C")], [comp("TT", "mm5.chr1")]), ["hg17", "mm5*"])
    assert texts(need) == [["AC", "**"]]
    with pytest.raises(ValueError):
        B.require_species(need, ["mm5*"])


def test_long_blocks(spark):
    """A block of 100,000 columns: all that reads columns is linear in their number."""
    rng = np.random.default_rng(2)
    long = ["".join(rng.choice(list("ACGT-*"), 100_000)) for _ in range(3)]
    parts = [comp(t, src, size=len(t.replace("-", "")), src_size=200_000) for t, src in zip(long, ("hg17.chr1", "panTro1.chr1", "mm5.chr1"), strict=True)]
    rows = blocks_of(spark, parts)
    columns = ["".join(c) for c in zip(*long, strict=True)]
    assert rows.select(W.text_columns(F.col("components")).alias("c")).first().c == columns
    good = sum(c.count("*") <= 1 for c in columns)
    assert B.filter_max_wildcards(rows, good, 1).count() == 1 and B.filter_max_wildcards(rows, good + 1, 1).count() == 0
    kept = [k for k, c in enumerate(columns) if set(c) - set("-*")]
    assert texts(B.drop_gap_columns(rows)) == [["".join(t[k] for k in kept) for t in long]]
    mask = spark.createDataFrame([("chr1", s, s + 70) for s in range(0, 80_000, 900)], "chrom string, start long, end long")
    masked = mask_brute(long[0], 0, "+", 200_000, [(s, s + 70) for s in range(0, 80_000, 900)])
    got = texts(B.mask_blocks(rows, mask))[0]
    assert got[0] == masked and all((a == "X") == (b == "X") for a, b in zip(got[1], masked, strict=True))
    mapping = spark.createDataFrame([("ACG", "7"), ("---", "0")], "key string, symbol string")
    want = " ".join({"ACG": "7", "---": "0"}.get(c, "-1") for c in columns)
    assert [r.symbols for r in B.to_symbols(rows, mapping).collect()] == [want] == [r.symbols for r in B.to_symbols(rows, mapping, sent_keys=1).collect()]


def test_ragged_blocks(spark):
    rows = blocks_of(spark, [comp("AC-T"), comp("A--", "mm5.c")], [], [comp(""), comp("A", "mm5.c")])
    assert [r.c for r in rows.orderBy("block_id").select(W.text_columns(F.col("components")).alias("c")).collect()] == [["AA", "C-", "--"], [], []]
    assert texts(B.drop_gap_columns(rows)) == [["ACT", "A-"], [], ["", ""]]
    assert [r.c for r in rows.where("block_id = 0").select(W.zipped([F.col("components")[k]["text"] for k in (1, 0)]).alias("c")).collect()] == [["AA", "-C", "--"]]


def mask_brute(text, start, strand, src_size, spans, literal=False):
    state, at = [], start
    for ch in text:
        if ch == "-":
            state.append(None)
        else:
            p = src_size - 1 - at if strand == "-" else at
            state.append(any(s <= p < e for s, e in spans))
            at += 1
    out = []
    for i, s in enumerate(state):
        if s is None:
            after = next((x for x in state[i:] if x is not None), None)
            before = [x for x in state[:i] if x is not None]
            s = after if after is not None else bool(before) if literal else next(reversed(before), False)
        out.append("X" if s else text[i])
    return "".join(out)


def test_masking(spark):
    rng = np.random.default_rng(5)
    rows = [[comp("".join(rng.choice(list("ACGT--"), 12)), start=int(s), strand=str(rng.choice(["+", "-"])), size=0)] for s in rng.integers(0, 80, 25)]
    rows = [[(c[0], c[1], len(c[5].replace("-", "")), c[3], 100, c[5])] for (c,) in rows] + [[comp("")]]
    spans = [(5, 20), (18, 30), (60, 64), (90, 99)]
    mask = spark.createDataFrame([("chr1", *s) for s in spans], "chrom string, start long, end long")
    for literal in (False, True):
        got = texts(B.mask_blocks(blocks_of(spark, *rows), mask, literal=literal))
        assert got == [[mask_brute(c[5], c[1], c[3], c[4], spans, literal)] for (c,) in rows]


def test_column_space_and_statistics(spark):
    space = C.column_space(spark, 2, wildcards=1).collect()
    assert len(space) == 36 - 1 - 1 and len({r.key for r in space}) == len(space)
    ss = C.sufficient_statistics(blocks_of(spark, [comp("AC")], [comp("AA"), comp("G-", "mm5.c")]), ["hg17", "mm5"])
    assert {(r.key, r["count"]) for r in ss.collect()} == {("A*", 1), ("C*", 1), ("AG", 1), ("A-", 1)}
    lines = [r.value for r in S.statistics_text(ss, ["hg17", "mm5"], 99).orderBy("ord").collect()]
    assert lines[1] == "LENGTH = 99" and lines[3] == "NTUPLES = 4" and len(lines) == 12


def test_densities(spark):
    d = B.block_cpg_density(blocks_of(spark, [comp("ACG-CG", size=5)], [comp("")])).orderBy("block_id").collect()
    assert [r.density for r in d] == [0.4, None]
    assert spark.range(1).select(W.density(F.lit(""), "CG")).first()[0] is None


def test_nearest_equals_brute_force(spark):
    rng = np.random.default_rng(1)
    x = rng.integers(0, 4, (60, 3)).astype(float)
    pts = spark.createDataFrame([(f"p{k}", x[k].tolist()) for k in range(40)], "label string, p array<double>")
    asks = spark.createDataFrame([(f"q{k}", x[k].tolist()) for k in range(40, 60)], "label string, p array<double>")
    got = {r.label: r.d2 for r in N.nearest(asks, pts).collect()}
    assert got == {f"q{k}": min(((x[k] - x[j]) ** 2).sum() for j in range(40)) for k in range(40, 60)}
    same = pts.unionByName(pts.limit(1))
    with pytest.raises(Exception, match="equal"):
        N.augment_mapping(spark.createDataFrame([("p0", "1")], "key string, symbol string"), same, asks).collect()


def test_similarity(spark):
    m = spark.createDataFrame([(i, j, w) for i, j, w in [(0, 0, 5.0), (0, 1, 1.0), (1, 0, 1.0), (1, 1, 5.0)]], "i int, j int, w double")
    assert {tuple(r) for r in Y.affinity_normalize(m).collect()} == {(0, 1, 1.0), (1, 0, 1.0)}
    e = spark.createDataFrame([(0, 1, 1.0), (0, 2, 2.0), (1, 2, 3.0)], "i int, j int, w double")
    labels = spark.createDataFrame([(0, "a"), (1, "a"), (2, "b")], "row_idx int, label string")
    got = sorted((r.name, r.w) for r in Y.edge_weights(e, labels).collect())
    assert got == sorted([("IN_a", 1.0), ("OUT_a", 2.0), ("OUT_b", 2.0), ("OUT", 2.0), ("OUT_a", 3.0), ("OUT_b", 3.0), ("OUT", 3.0)])


def test_pairs_without_a_common_key(spark, tmp_path):
    rows = spark.createDataFrame([(0, "a", 2.0), (1, "b", 3.0), (2, "a", 1.0), (2, "b", 1.0)], "seq_id int, kmer string, w double")
    for block in (512, 1):
        matrix = Y.complete(Y.sparse_dot(rows), rows, block=block)
        assert {(r.i, r.j): r.w for r in matrix.collect()} == {(0, 0): 4.0, (0, 1): 0.0, (0, 2): 2.0, (1, 1): 9.0, (1, 2): 3.0, (2, 2): 2.0}
    labels = spark.createDataFrame([(0, "x"), (1, "x"), (2, "y")], "row_idx int, label string")
    assert {(r.same, r["mean"], r.n) for r in Y.edge_means(matrix, labels).collect()} == {(True, 0.0, 1), (False, 2.5, 2)}
    assert ("IN_x", 0.0) in {tuple(r) for r in Y.edge_weights(matrix, labels).collect()}
    S.matrix_text(Y.mirrored(matrix)).orderBy("i").select("value").write.text(str(tmp_path / "m"))
    assert {tuple(r) for r in S.read_matrix(spark, str(tmp_path / "m"), labelled=True).collect()} == {tuple(r) for r in Y.mirrored(matrix).collect()}


def test_queries_fill_in_zeros(spark, tmp_path):
    from weftline.plans import QUERIES

    kinds = {7: "aaaa", 9: "bbbb", 50: "abab", 51: "a"}  # the first two share nothing, the last has no 3-mer
    events = [(f"2024-01-01 00:00:{k:02d}", 100 * u + k, u, e) for u, text in kinds.items() for k, e in enumerate(text)]
    df = spark.createDataFrame(events, "ts string, event_id long, user_id long, event_type string")
    df.withColumn("ts", F.col("ts").cast("timestamp_ntz")).write.parquet(str(tmp_path / "events.parquet"))
    means = QUERIES["sequence_edge_means"](spark, str(tmp_path)).collect()
    assert sum(r.n for r in means) == 6
    assert QUERIES["sequence_matrix_round_trip"](spark, str(tmp_path)).count() == 16
    assert QUERIES["profile_distances"](spark, str(tmp_path)).count() == 16
    assert QUERIES["hclust"](spark, str(tmp_path)).count() == 3
    assert sum(r.n for r in QUERIES["edge_weights_avg"](spark, str(tmp_path)).collect()) == 6


def test_hclust_cut_layout(spark):
    sims = spark.createDataFrame([("x", 0, 1, 0.9), ("x", 0, 2, 0.2), ("x", 1, 2, 0.4)], "problem string, i int, j int, w double")
    got = CL.hierarchical(sims).orderBy("stage").collect()
    assert [(r.n_clusters, r.left, r.right, round(r.sim, 9)) for r in got] == [(2, -1, -2, 0.9), (1, 1, -3, 0.3)]
    merges = spark.createDataFrame([(1, -1, -2, 0.9), (2, 1, -3, 0.2)], "stage int, left int, right int, sim double")
    cut = lambda level: {r.leaf: r.cluster for r in CL.cut_dendrogram(merges, level).collect()}
    assert cut(0.5) == {1: 0, 2: 0, 3: 1}
    assert cut(0.1) == {1: 0, 2: 0, 3: 0}
    assert cut(0.95) == {1: 0, 2: 1, 3: 2}
    assert CL.layout_dendrogram(merges).count() == 6


def test_linkage_equals_one_pair_at_a_time(spark):
    rng = np.random.default_rng(12)
    rows, want = [], {}
    for name, n in (("x", 2), ("y", 17), ("z", 40)):
        sim = np.triu(rng.random((n, n)).round(6), 1)
        rows += [(name, i, j, float(sim[i, j])) for i in range(n) for j in range(i + 1, n)]
        groups, merges = {k: ([k], -(k + 1)) for k in range(n)}, []
        for stage in range(1, n):
            mean = lambda a, b: np.mean([sim[min(i, j), max(i, j)] for i in groups[a][0] for j in groups[b][0]])  # noqa: B023, E731
            w, a, b = max((mean(a, b), a, b) for a in groups for b in groups if a < b)
            merges.append((stage, n - stage, groups[a][1], groups[b][1], round(float(w), 9)))
            groups[a] = (groups[a][0] + groups.pop(b)[0], stage)
        want[name] = merges
    got = {}
    for r in CL.hierarchical(spark.createDataFrame(rows, "problem string, i int, j int, w double")).collect():
        got.setdefault(r.problem, []).append((r.stage, r.n_clusters, r.left, r.right, round(r.sim, 9)))
    assert {k: sorted(v) for k, v in got.items()} == want
    flat = spark.createDataFrame([("t", i, j, 0.0) for i in range(60) for j in range(i)], "problem string, i int, j int, w double")
    tied = CL.hierarchical(flat).collect()
    assert sorted(r.stage for r in tied) == list(range(1, 60)) and all(max(r.left, r.right) < r.stage for r in tied)


def test_layout_equals_recursion(spark):
    rng = random.Random(3)
    for deep in (False, True):
        n, nodes, merges = 120, [-(k + 1) for k in range(120)], []
        for stage in range(1, n):
            a = nodes.pop() if deep else nodes.pop(rng.randrange(len(nodes)))
            b = nodes.pop(rng.randrange(len(nodes)))
            merges.append((stage, a, b, 1.0 - stage / 200))
            nodes.append(stage)
        at, leaves = {}, []

        def order(node):
            if node < 0:
                leaves.append(node)
            else:
                order(merges[node - 1][1])
                order(merges[node - 1][2])

        order(n - 1)
        at = {leaf: (float(k), 0.0) for k, leaf in enumerate(leaves)}
        want = set()
        for stage, a, b, sim in merges:
            y = 0.001 - sim
            at[stage] = ((at[a][0] + at[b][0]) / 2, y)
            (lx, ly), (rx, ry) = at[a], at[b]
            want |= {(stage, *(round(v, 9) for v in line)) for line in ((lx, ly, lx, y), (rx, ry, rx, y), (lx, y, rx, y))}
        got = CL.layout_dendrogram(spark.createDataFrame(merges, "stage int, left int, right int, sim double")).collect()
        assert {(r.stage, *(round(v, 9) for v in (r.x0, r.y0, r.x1, r.y1))) for r in got} == want


def test_agglomeration_without_a_matrix():
    rng = np.random.default_rng(5)
    for n in (7, 60):
        mass, points = rng.integers(1, 30, n).astype(float), rng.integers(0, 4, (n, 3)).astype(float)
        got = CL._agglomerate(mass, points, 3, 1_000)
        groups = [[[k], m, p] for k, (m, p) in enumerate(zip(mass / mass.sum(), points, strict=True))]
        for size, h, assign in got:
            far = lambda a, b: np.sqrt(((a[2] - b[2]) ** 2).sum())
            near = [min((far(a, b), j) for j, b in enumerate(groups) if j != i)[1] for i, a in enumerate(groups)]
            score = lambda parts: -sum(m * np.log(m) for m in parts)
            tried = {i: score([g[1] for k, g in enumerate(groups) if k not in (i, j)] + [groups[i][1] + groups[j][1]]) for i, j in enumerate(near) if i < j}
            assert h * np.log(size) == pytest.approx(max(tried.values()))
            new = [sorted(np.flatnonzero(np.array(assign) == c).tolist()) for c in range(size)]
            groups = [[g, sum(mass[k] for k in g) / mass.sum(), (points[g] * mass[g, None]).sum(0) / mass[g].sum()] for g in new]


def test_cut_of_a_deep_dendrogram(spark):
    n = 300
    merges = spark.createDataFrame([(1, -1, -2, 1.0)] + [(k, k - 1, -(k + 1), 1.0 / k) for k in range(2, n)], "stage int, left int, right int, sim double")
    got = {r.leaf: r.cluster for r in CL.cut_dendrogram(merges, 1 / 101).collect()}
    assert got == {leaf: max(0, leaf - 101) for leaf in range(1, n + 1)}


def test_profile_distances_of_all_sequences(spark):
    from oracle import DATA
    from weftline.plans import QUERIES, fixtures

    weights = {}
    for r in K.profile_weights(fixtures.sequences(spark, DATA), k=5, runs=100).where("w is not null").collect():
        weights.setdefault(r.seq_id, {})[r.kmer] = r.w
    want = {(i, j): sum(w * b[m] for m, w in a.items() if m in b) for i, a in weights.items() for j, b in weights.items()}
    got = {(r.i, r.j): r.w for r in QUERIES["profile_distances"](spark, DATA).collect()}
    assert {k: round(w, 9) for k, w in got.items() if w} == {k: round(w, 9) for k, w in want.items() if w}


def test_clustering_of_all_sequences(spark):
    from oracle import DATA
    from weftline.plans import QUERIES

    folder = DATA.replace("sf0.001", "sf0.01")  # more than 40 sequences
    n = spark.read.parquet(f"{folder}/events.parquet").select("user_id").distinct().count()
    assert n > 40 and QUERIES["hclust"](spark, folder).count() == n - 1
    assert QUERIES["cut_dendrogram"](spark, folder).count() == n


def test_entropy_merge(spark):
    rows = spark.createDataFrame([("x", 0, 1, [0.0]), ("x", 1, 1, [0.1]), ("x", 2, 2, [9.0])], "problem string, row_idx int, count long, p array<double>")
    got = CL.entropy_agglomeration(rows, stop=2).collect()
    assert [(r.n_clusters, round(r.h_norm * math.log(2), 4), list(r.assign)) for r in got] == [(2, 0.6931, [0, 0, 1])]


def test_agglomeration_of_all_species(spark):
    from collections import Counter

    from oracle import DATA
    from weftline.plans import QUERIES, fixtures

    counts = Counter()
    for r in fixtures.blocks(spark, DATA).collect():
        counts.update("".join(t).ljust(3, "*") for t in zip(*(c["text"].upper() for c in r.components), strict=True))
    counts = {k: n for k, n in counts.items() if set(k) <= set("ACGT-*") and k != "***"}
    often = sum(n >= 10 for n in counts.values())
    assert 35 < often < len(counts)
    got = QUERIES["entropy_agglomeration"](spark, DATA).collect()
    assert {len(r.assign) for r in got} == {often} and {r.n_clusters for r in got} == set(range(5, min(100, often)))
    assert {r.key for r in QUERIES["ancestral_dists_tree"](spark, DATA).collect()} == set(counts)


def test_ancestors_match_enumeration(spark):
    model = P.TreeModel("ACGT-", [0.3, 0.2, 0.2, 0.2, 0.1], [[-1.0 if i == j else 0.25 for j in range(5)] for i in range(5)], P.parse_newick("((a:0.1,b:0.2):0.3,c:0.4);"))
    steps = {t: P.expm(np.array(model.matrix) * t) for t in (0.1, 0.2, 0.3, 0.4)}
    cols = spark.createDataFrame([("ACG",), ("A*G",), ("***",), ("AXG",), ("NNC",)], "key string")
    got = {r.key: r.p for r in P.ancestral_distributions(cols, model, ["a", "b", "c"]).collect()}
    assert got["***"] is None and got["AXG"] is None
    at = "ACGT-".index
    for key in ("ACG", "A*G"):
        lik = np.zeros(5)
        for root in range(5):
            inner = sum(steps[0.3][root, m] * steps[0.1][m, at(key[0])] * (1 if key[1] == "*" else steps[0.2][m, at(key[1])]) for m in range(5))
            lik[root] = model.background[root] * inner * steps[0.4][root, at(key[2])]
        assert np.allclose(got[key], lik / lik.sum())
    assert P.all_columns(spark, model, ["a"]).count() == 4


def test_statistics(spark):
    rows = spark.createDataFrame([(1.0, 1.0, None), (2.0, 2.0, 1.0), (3.0, 5.0, 2.0), (4.0, 3.0, 9.0)], "y double, a double, b double")
    fit = T.ols_fit(rows, "y", ["a", "b"]).first()
    x = np.array([[1, 2, 1], [1, 5, 2], [1, 3, 9]], float)
    want = np.linalg.lstsq(x, np.array([2.0, 3, 4]), rcond=None)[0]
    assert np.allclose([fit.b0, fit.b1, fit.b2], want)
    assert [r.residual is None for r in T.ols_residuals(rows, "y", ["a", "b"]).orderBy("y").collect()] == [True, False, False, False]
    empty = rows.where("y > 9")
    assert T.ols_fit(empty, "y", ["a"]).first().n == 0
    assert T.roc_curve(empty, "y", F.lit(True), 4).where("tpr is not null").count() == 0


def test_text_formats(spark, tmp_path):
    maf = tmp_path / "x.maf"
    maf.write_text("##maf version=1\n\na score=3.5\ns hg17.chr1  4 2 + 100 A-C\ns mm5.chr2 0 3 - 50 ACG\n\n\na\ns hg17.chr1 9 1 + 100 A\n\n")
    got = S.read_maf(spark, str(maf)).orderBy("block_id").collect()
    assert [(r.score, [tuple(c) for c in r.components]) for r in got] == [(3.5, [("hg17.chr1", 4, 2, "+", 100, "A-C"), ("mm5.chr2", 0, 3, "-", 50, "ACG")]), (None, [("hg17.chr1", 9, 1, "+", 100, "A")])]
    bed = tmp_path / "x.bed"
    bed.write_text("chr1   5  9\nchr2\t1\t2\tlab\t-\n")
    assert [tuple(r) for r in S.read_intervals(spark, str(bed)).orderBy("row_idx").collect()] == [(0, "chr1", 5, 9, "", "+"), (1, "chr2", 1, 2, "lab", "-")]
    fa = tmp_path / "x.fa"
    fa.write_text(">one\nAC\nGT\n>two\nA\n")
    assert [(r.header, r.seq) for r in S.read_fasta(spark, str(fa)).orderBy("rec_no").collect()] == [("one", "ACGT"), ("two", "A")]
    mp = tmp_path / "m.txt"
    mp.write_text("A 1\nB 2\nA 3\n")
    assert {(r.key, r.symbol) for r in S.read_mapping(spark, str(mp)).collect()} == {("A", "3"), ("B", "2")}
    ad = tmp_path / "a.txt"
    ad.write_text("# x\nAC 5 0.25 0.75\nA* ? 1 0\n")
    assert [(r.label, r["count"], r.p) for r in S.read_distributions(spark, str(ad)).orderBy("row_idx").collect()] == [("AC", 5, [0.25, 0.75]), ("A*", None, [1.0, 0.0])]
    sc = tmp_path / "s.txt"
    sc.write_text("1.5\nNA\n")
    scores = S.read_scores(spark, str(sc))
    assert [r.score for r in scores.orderBy("row_idx").collect()] == [1.5, None]
    assert [r.value for r in S.wiggle_text(scores, "chr1").orderBy("ord").collect()] == ["fixedStep chrom=chr1 start=1 step=1", "1.5", "NA"]
    ints = tmp_path / "i.txt"
    ints.write_text("1 2 3\n\n-1\n")
    assert [r.ints for r in S.read_int_sequences(spark, str(ints)).orderBy("seq_id").collect()] == [[1, 2, 3], [], [-1]]
    parts = tmp_path / "p.txt"
    parts.write_text(f"P1 7 {bed}\n")
    assert [(r.name, r.start) for r in S.read_partitions(spark, str(parts)).orderBy("start").collect()] == [("P1", 1), ("P1", 5)]


def test_packed_sequences(spark, tmp_path):
    text = "ACGTNACGTAC"
    codes = ["TCAGN".index(c) for c in text] + [0]
    body = bytes(a << 4 | b for a, b in zip(codes[::2], codes[1::2], strict=True))
    (tmp_path / "chr1.nib").write_bytes((0x6BE93D3A).to_bytes(4, "little") + len(text).to_bytes(4, "little") + body)
    tiles = S.read_nib(spark, str(tmp_path), tile=4)
    iv = spark.createDataFrame([(0, "chr1", 2, 9), (1, "chr1", 3, 3)], "row_idx long, chrom string, start long, end long")
    got = {r.row_idx: r.seq for r in I.fetch_sequences(iv, tiles, 4).collect()}
    assert got == {0: text[2:9], 1: None}


def test_line_ends_and_fields(spark, tmp_path):
    """Alignment files with either kind of line ends and any number of empty lines; fields beyond the fifth."""
    text = "##maf version=1\n\n\na score=1\ns hg17.chr1 0 2 + 9 AC\ns mm5.chr1 0 1 - 9 A-\n\na\ns hg17.chr1 2 1 + 9 G\ns mm5.chr1 1 1 - 9 G\n"
    want = [(1.0, ["AC", "A-"]), (None, ["G", "G"])]
    for k, end in enumerate(("\n", "\r\n")):
        (tmp_path / f"{k}.maf").write_bytes(text.replace("\n", end).encode())
        got = S.read_maf(spark, str(tmp_path / f"{k}.maf")).orderBy("block_id").collect()
        assert [(r.score, [c.text for c in r.components]) for r in got] == want
        (tmp_path / f"{k}.fa").write_bytes(f">one{end}AC{end}GT{end}>two{end}A{end}".encode())
        assert [(r.header, r.seq) for r in S.read_fasta(spark, str(tmp_path / f"{k}.fa")).orderBy("rec_no").collect()] == [("one", "ACGT"), ("two", "A")]
    (tmp_path / "x.bed").write_text("chr1\t5\t9\nchr2\t1\t2\ta b\t-\tc\t\td\n")
    assert [(r.label, r.strand, r.rest) for r in S.read_intervals(spark, str(tmp_path / "x.bed"), tabs=True).orderBy("row_idx").collect()] == [("", "+", None), ("a b", "-", "a b\t-\tc\t\td")]


def test_matrix_with_zeros(spark, tmp_path):
    sparse = spark.createDataFrame([(0, 0, 1.0), (0, 2, 2.5), (2, 1, 3.0)], "i int, j int, w double")
    lines = [r.value for r in S.matrix_text(sparse).orderBy("i").collect()]
    assert [x.split("\t")[0] for x in lines] == ["V0", "V1", "V2"]
    cells = [[float(c) for c in x.split("\t")[1:]] for x in lines]
    assert cells == [[1.0, 0.0, 2.5], [0.0, 0.0, 0.0], [0.0, 3.0, 0.0]]
    S.matrix_text(sparse, labelled=False).orderBy("i").select("value").write.text(str(tmp_path / "m"))
    assert {(r.i, r.j): r.w for r in S.read_matrix(spark, str(tmp_path / "m")).collect()} == {(i, j): cells[i][j] for i in range(3) for j in range(3)}


def test_region_classes(spark):
    # fixed values: names of data sets, supports and their classes
    known = [("pos_enc_proms_tile", 4, 1), ("pos_enc_proms_tile", 5, 2), ("pos_enc_proms_tile", 14, 2), ("pos_enc_proms_tile", 15, 3), ("enc_distal_loose_2_tile", 1, 4), ("enc_distal_loose_2_tile", 2, 5)]
    known += [("enc_distal_loose_2_tile", 0, 0), ("enc_ar", 1, 6), ("wang_preCRMs_tile", 9, 7), ("put_enc_proms_tile", 1, 8), ("other", 3, 0), ("reg_tile", 3, 0)]
    rows = spark.createDataFrame([(d, s, c, 1.0, 2.0) for d, s, c in known] + [("enc_ar", 1, 6, None, 2.0)], "dataset string, support int, want int, x double, y double")
    got = T.classed_regions(rows, ("x", "y"), most=9).collect()
    assert len(got) == len(known) - 1 and all(r["class"] == r.want for r in got)
    assert T.classed_regions(rows, ("x", "y")).where("class > 5").count() == 0


def test_quantiles(spark):
    rng = np.random.default_rng(4)
    values = {"a": rng.normal(size=101), "b": rng.integers(0, 3, 40).astype(float), "c": np.array([7.0])}
    rows = spark.createDataFrame([(g, float(v)) for g, vs in values.items() for v in vs] + [("a", None), ("d", None)], "g string, v double")
    got = {(r.g, r.share): r.v for r in T.quantiles(rows, "v", [0.0, 0.1, 0.25, 0.9, 1.0], ["g"]).collect()}
    assert len(got) == 15 and all(v == pytest.approx(np.quantile(values[g], q)) for (g, q), v in got.items())
    assert T.quantiles(rows.where("g = 'd'"), "v", [0.5]).count() == 0


def test_score_vectors_and_lines(spark, tmp_path):
    for name, text in (("a", "1\nNA\n3\n"), ("b", "4\n5\n")):
        (tmp_path / name).write_text(text)
    both = S.zip_scores(a=S.read_scores(spark, str(tmp_path / "a")), b=S.read_scores(spark, str(tmp_path / "b"))).orderBy("row_idx").collect()
    assert [(r.a, r.b) for r in both] == [(1.0, 4.0), (None, 5.0)]
    (tmp_path / "l").write_text("pos 1.5\nneg NA\n")
    assert [(r.label, r.score) for r in S.read_labelled_scores(spark, str(tmp_path / "l")).orderBy("row_idx").collect()] == [("pos", 1.5), ("neg", None)]
    lines = spark.createDataFrame([("x 1",), ("NA 2",), ("y NANO",)], "value string")
    assert [r.value for r in S.prefix_lines(S.without_missing(lines), "hg17.").collect()] == ["hg17.x 1"]
    assert S.last_path(spark, str(tmp_path), "?").endswith("/l")
    curves = spark.createDataFrame([("m", 2.0, 1), ("m", 0.0, 0), ("m", 1.0, 0), ("p", 0.0, 0), ("p", 1.0, 1)], "source string, s double, y int")
    got = {(r.source, r.k): (r.tpr, r.fpr) for r in T.roc_curves(curves, "source", "s", F.col("y") == 1, 2, above_zero=("m",)).collect()}
    assert got == {("m", 0): (1.0, 1.0), ("m", 1): (1.0, 0.0), ("p", 0): (1.0, 1.0), ("p", 1): (1.0, 0.0)}


def test_blocks_for_intervals(spark):
    two = lambda s, a, b, strand="+": [comp(a, start=s, strand=strand), comp(b, "mm5.chr9", start=s + 100, strand=strand)]
    rows = blocks_of(spark, two(0, "AC", "GG"), two(2, "T", "A"), two(9, "CC", "-A"), two(40, "G", "G", "-"))
    asks = spark.createDataFrame([(0, "hg17.chr1", 0, 3), (1, "hg17.chr1", 1, 12), (2, "hg17.chr1", 20, 30), (3, "hg17.chr1", 40, 41), (4, "x", 0, 9)], "row_idx int, chrom string, start long, end long")
    got = {r.row_idx: [tuple(c) for c in r.components] for r in I.blocks_for_intervals(asks, rows, ["hg17", "mm5"], spacer=3).collect()}
    assert got[0] == [("hg17.chr1", 0, 3, "+", 1000, "ACT"), ("mm5.chr9", 100, 3, "+", 1000, "GGA")]
    assert got[1] == [("hg17.fake", 0, 5, "?", 5, "ACT---CC"), ("mm5.fake", 0, 4, "?", 4, "GGA----A")]
    assert got[2] == got[4] == [("hg17.fake", 0, 0, "?", 0, ""), ("mm5.fake", 0, 0, "?", 0, "")]
    assert got[3] == [("hg17.chr1", 40, 1, "-", 1000, "G"), ("mm5.chr9", 140, 1, "-", 1000, "G")]


def brute_nearest(queries, points):
    """``(label, nearest, d2)`` of ``(label, group, p)`` by comparing all."""
    out = {}
    for q, g, p in queries:
        fits = [(sum((a - b) ** 2 for a, b in zip(p, v)), v, l) for l, h, v in points if h == g and len(v) == len(p)]
        if fits:
            d2, _, l = min(fits)
            out[q] = (l, d2)
    return out


@pytest.mark.parametrize(("cell_rows", "most_cells"), [(10_000, 1), (40, 1024), (7, 5), (1, 1024)])
def test_nearest_by_cells_is_nearest(spark, cell_rows, most_cells):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(9, 4)) * 5
    points = [(k, "ab"[k % 2], np.round(centres[k % 9] + rng.normal(size=4), 2).tolist()) for k in range(300)]
    points += [(1000 + k, "a", points[4][2]) for k in range(5)] + [(2000, "a", [1.0, 2.0]), (2001, "b", [])]  # ties, other lengths
    queries = [(k, "abc"[k % 3], np.round(centres[k % 9] + 2 * rng.normal(size=4), 2).tolist()) for k in range(90)]
    queries += [(200, "a", points[4][2]), (201, "a", [1.0, 1.0]), (202, "b", []), (203, "a", [1.0, 2.0, 3.0])]
    schema = "label long, g string, p array<double>"
    q, p = spark.createDataFrame(queries, schema), spark.createDataFrame(points, schema)
    got = {r.label: (r.nearest, r.d2) for r in N.nearest(q, p, by="g", cell_rows=cell_rows, most_cells=most_cells).collect()}
    want = brute_nearest(queries, points)
    assert got.keys() == want.keys() and all(got[k][0] == want[k][0] and got[k][1] == pytest.approx(want[k][1]) for k in want)
    plain = {r.label: r.nearest for r in N.nearest(q, p, cell_rows=cell_rows, most_cells=most_cells).collect()}
    assert plain == {k: v[0] for k, v in brute_nearest([(a, "", c) for a, _, c in queries], [(a, "", c) for a, _, c in points]).items()}


def test_fewer_cells_are_looked_into_as_points_grow(spark):
    rng = np.random.default_rng(5)
    shares = []
    for n in (400, 4_000):
        points = spark.createDataFrame([(k, rng.normal(size=3).tolist()) for k in range(n)], "label long, p array<double>")
        seen = N.nearest(points.where("label < 50"), points, cell_rows=20, reported=True).collect()
        assert all(r.nearest == r.label and r.d2 == 0 for r in seen)
        shares.append(sum(r.cells for r in seen) / sum(r.all_cells for r in seen))
    assert shares[1] < shares[0] / 2 < 0.25


def test_infrequent_rows_are_absorbed_in_their_problem(spark):
    rows = [("x", "a", 10, [0.0]), ("x", "b", 20, [10.0]), ("x", "c", 1, [1.0]), ("y", "a", 10, [1.0]), ("y", "d", 2, [9.0]), ("z", "e", 1, [5.0]), ("z", "f", 2, [6.0])]
    df = spark.createDataFrame(rows, "problem string, label string, count long, p array<double>")
    got = sorted((r.problem, r.label, r["count"], round(r.p[0], 6)) for r in N.absorb_infrequent(df, 3, by="problem").collect())
    assert got == [("x", "a", 11, round(1 / 11, 6)), ("x", "b", 20, 10.0), ("y", "a", 12, round(28 / 12, 6)), ("z", "e", 1, 5.0), ("z", "f", 2, 6.0)]


@pytest.mark.parametrize("sent_keys", [500_000, 1])
def test_symbols_mean_the_same_at_every_size_of_the_mapping(spark, sent_keys):
    mapping = spark.createDataFrame([("A", "1"), ("A", "2"), ("C", ""), ("G", None), (None, "9"), ("T", "7")], "key string, symbol string")
    blocks = blocks_of(spark, [comp("aCGTA-")], [comp("")])
    got = B.to_symbols(blocks, mapping, sent_keys=sent_keys).collect()
    assert [tuple(r) for r in got] == [(0, "2 -1 -1 7 2 -1")]


def test_mappings_from_traces_and_lines(spark):
    names = spark.createDataFrame([(0, "AA"), (1, "AC"), (2, "AG")], "row_idx long, key string")
    trace = spark.createDataFrame([(3, [0, 1, 2]), (2, [0, 1, 0]), (2, [0, 0, 1])], "n_clusters int, assign array<int>")
    assert {r.key: r.symbol for r in M.from_clusters(names, trace.coalesce(1), 2).collect()} == {"AA": "0", "AC": "1", "AG": "0"}
    with pytest.raises(Exception, match="as many clusters"):
        M.from_clusters(names.where("row_idx < 2"), trace, 3).collect()
    lines = spark.createDataFrame([("a", "1", 0), ("b", "2", 1), ("a", "3", 2)], "key string, symbol string, line_no long")
    assert {r.key: r.symbol for r in M.last_wins(lines).collect()} == {"a": "3", "b": "2"}


# whole files and packed sequences


def files_in(folder):
    return {p.name: p.read_bytes() for p in pathlib.Path(folder).iterdir()} if pathlib.Path(folder).exists() else {}


def test_whole_files_are_there_or_not(spark, tmp_path):
    rows = spark.createDataFrame([("b", k, f"line {k}") for k in range(500)] + [("a", 1, None), ("a", 0, "one")], "file string, ord long, value string").repartition(4)
    folder = f"{tmp_path}/out"
    write_whole(rows, folder)
    assert files_in(folder) == {"a": b"one\n", "b": b"".join(b"line %d\n" % k for k in range(500))}
    write_whole(rows.where("file = 'a'").withColumn("value", F.lit(b"\x00raw")), folder)  # bytes as they are, in place of the file
    assert files_in(folder)["a"] == b"\x00raw\x00raw"
    for bad in (F.when(F.col("ord") == 499, F.raise_error(F.lit("no"))).otherwise(F.col("value")), F.col("value")):
        named = rows.withColumn("value", bad).withColumn("file", F.when(F.col("ord") == 400, "x/y").otherwise("c"))
        with pytest.raises(Exception, match=r"no|x/y"):
            write_whole(named, f"{tmp_path}/bad")
        assert files_in(f"{tmp_path}/bad") == {}
    write_whole(rows.where("false"), f"{tmp_path}/none")
    assert files_in(f"{tmp_path}/none") == {}


def test_a_failed_run_deletes_what_its_tasks_wrote(tmp_path):
    writer = FilesWriter(str(tmp_path))
    batch = pa.record_batch([["a", "a", "b"], [b"1", b"2", b"3"]], names=["file", "value"])
    told = [writer.write(iter([batch])), writer.write(iter([batch.slice(2)]))]
    assert len(files_in(tmp_path)) == 3 and all(n.startswith(".") for n in files_in(tmp_path))
    with pytest.raises(ValueError, match="two tasks"):
        writer.commit(told)
    assert files_in(tmp_path) == {}
    writer.commit([writer.write(iter([batch]))])
    assert files_in(tmp_path) == {"a": b"12", "b": b"3"}


def test_packed_sequences_are_read_by_ranges(spark, tmp_path):
    rng = random.Random(2)
    whole = {f"chr{k}": "".join(rng.choice("ACGTNacgtn-") for _ in range(n)) for k, n in enumerate((0, 1, 2, 4000, 4001))}
    rows = [(c, k, s[k * 100 : k * 100 + 100]) for c, s in whole.items() for k in range(max(1, -(-len(s) // 100)))]
    packed.write_packed(spark.createDataFrame(rows, "chrom string, tile_no long, seq string").repartition(3), str(tmp_path))
    plain = {c: s.upper().replace("-", "N") for c, s in whole.items()}
    for chrom, data in files_in(tmp_path).items():
        assert len(data) == 8 + (len(whole[chrom.removesuffix(".nib")]) + 1) // 2
    back: dict = {}
    for r in packed.read_packed(spark, str(tmp_path), tile=64, run=7).orderBy("chrom", "tile_no").collect():
        back[r.chrom] = back.get(r.chrom, "") + r.seq
    assert back == {c: s for c, s in plain.items() if s}
    asks = [(k, f"chr{rng.randrange(6)}", a := rng.randrange(-5, 4100), a + rng.randrange(-2, 60)) for k in range(300)] + [(900, None, 1, 2), (901, "chr3", None, 4)]
    got = {r.row_idx: r for r in packed.fetch_packed(spark.createDataFrame(asks, "row_idx long, chrom string, start long, end long"), str(tmp_path)).collect()}
    for k, chrom, start, end in asks:
        want = plain[chrom][max(0, start) : max(0, end)] if chrom in plain and start is not None else None
        assert got[k].seq == want and got[k].bytes <= 8 + len(want or "") // 2 + 2
    assert sum(r.bytes for r in got.values()) < sum(len(r.seq or "") for r in got.values()) / 2 + 2 * len(asks) + 8 * 5 * 8
    with pytest.raises(ValueError, match="odd number"):
        packed.write_packed(spark.createDataFrame([("c", 0, "ACG"), ("c", 1, "A")], "chrom string, tile_no long, seq string"), str(tmp_path))


def test_conditions_reach_packed_files(spark, tmp_path):
    packed.write_packed(spark.createDataFrame([(f"chr{c}", k, "ACGT" * 5) for c in range(3) for k in range(10)], "chrom string, tile_no long, seq string"), str(tmp_path))
    rows = packed.read_packed(spark, str(tmp_path), tile=20)
    assert sorted((r.chrom, r.tile_no) for r in rows.where("chrom in ('chr1', 'chr9') and tile_no >= 3 and tile_no < 5").collect()) == [("chr1", 3), ("chr1", 4)]
    reader = packed.PackedReader(str(tmp_path), 20, 64)
    left = list(reader.pushFilters([EqualTo(("chrom",), "chr2"), GreaterThan(("tile_no",), 7), StringContains(("seq",), "A")]))
    assert left == [StringContains(("seq",), "A")]
    assert [(p.chrom, p.first, p.last) for p in reader.partitions()] == [("chr2", 8, 10)]


@pytest.mark.parametrize(("bins", "sorted_rows"), [(4096, 65_536), (3, 4), (2, 1)])
def test_quantiles_by_narrowing(spark, bins, sorted_rows):
    rng = random.Random(bins)
    rows = [("a", float(rng.choice([1, 2, 2, 2, 5]))) for _ in range(60)] + [("b", rng.gauss(0, 1) * 10 ** rng.randrange(-8, 9)) for _ in range(101)] + [("c", 7.0), ("d", None), (None, 3.0), (None, 5.0)]
    rows += [("e", v) for v in (0.0, 5e-324, 1.7e308, -1.7e308, -0.0)]
    shares = [0.0, 0.1, 0.5, 0.9, 1.0]
    got = {(r.g, r.share): r.v for r in T.quantiles(spark.createDataFrame(rows, "g string, v double").repartition(3), "v", shares, ["g"], bins=bins, sorted_rows=sorted_rows).collect()}
    for g in {g for g, v in rows if v is not None}:
        values = sorted(v for h, v in rows if h == g and v is not None)
        for s in shares:
            at = s * (len(values) - 1)
            a, b = values[math.floor(at)], values[math.ceil(at)]
            assert got.pop((g, s)) == pytest.approx(a + (b - a) * (at - math.floor(at)) if a != b else a)
    assert not got
    inf = spark.createDataFrame([("x", v) for v in (1.0, float("inf"), float("nan"))], "g string, v double")
    assert [r.v for r in T.quantiles(inf, "v", [0.0, 0.5], ["g"]).orderBy("share").collect()] == [1.0, math.inf]
    assert [r.v for r in T.quantiles(spark.createDataFrame(rows[:60], "g string, v double"), "v", [0.5], bins=bins, sorted_rows=sorted_rows).collect()] == [2.0]


@pytest.mark.parametrize(("block", "keys"), [(512, 4096), (3, 2), (1, 1)])
def test_sparse_dot_by_tiles(spark, block, keys):
    rng = random.Random(block)
    rows = [(f"s{i}" if i % 2 else f"t{i}", f"k{k}", rng.choice([-1.0, 0.0, 0.5, 2.0])) for i in range(11) for k in range(9) if rng.random() < 0.5]
    rows += [("s1", "k0", 1.0), ("lone", "only", 3.0), ("x", None, 1.0), (None, "k1", 1.0), ("y", "k1", None)] + [(f"h{i}", "hot", 1.0) for i in range(12)]
    vectors: dict = {}
    for i, k, w in rows:
        if i is not None and k is not None and w is not None:
            vectors.setdefault(i, {}).setdefault(k, 0.0)
            vectors[i][k] += w
    want = {(i, j): sum(vectors[i][k] * vectors[j][k] for k in vectors[i].keys() & vectors[j].keys()) for i in vectors for j in vectors if i <= j and vectors[i].keys() & vectors[j].keys()}
    got = Y.sparse_dot(spark.createDataFrame(rows, "seq_id string, kmer string, w double").repartition(3), block=block, keys=keys).collect()
    assert len(got) == len(want) and {(r.i, r.j): round(r.w, 9) for r in got} == {k: round(v, 9) for k, v in want.items()}
    assert Y.sparse_dot(spark.createDataFrame([], "seq_id string, kmer string, w double")).count() == 0


def brute_likelihood(model, species, columns):
    """By summing over all states of all nodes."""
    steps, states = {}, range(len(model.alphabet))
    def below(node, state):
        if not node.children:
            c = key[species.index(node.label)]
            return 1.0 if c == "*" else float(model.alphabet[state] == c)
        out = 1.0
        for child in node.children:
            p = steps.setdefault(child.length, P.expm(np.array(model.matrix) * child.length))
            out *= sum(p[state, s] * below(child, s) for s in states)
        return out

    total = 0.0
    for key, n in columns:
        total += n * math.log(sum(model.background[s] * below(model.tree, s) for s in states))
    return total


def test_a_planted_model_is_found_again(spark):
    from itertools import product

    tree, species = P.parse_newick("((a:0.1,b:0.3):0.2,c:0.4);"), ["a", "b", "c"]
    pi = [0.3, 0.2, 0.25, 0.15, 0.1]
    true = P.TreeModel("ACGT-", pi, P.gap_rates(pi, 3.5, 0.4), P.scaled(tree, 1.7))
    assert P.TreeModel.parse(true.text()) == true
    assert -sum(p * r[i] for i, (p, r) in enumerate(zip(pi, true.matrix))) == pytest.approx(1) and np.abs(np.array(true.matrix).sum(axis=1)).max() < 1e-12
    keys = ["".join(k) for k in product("ACGT-", repeat=3)]
    share = [math.exp(brute_likelihood(true, species, [(k, 1)])) for k in keys]
    assert sum(share) == pytest.approx(1)
    columns = [(k, round(p * 10**7)) for k, p in zip(keys, share)]
    df = spark.createDataFrame(columns + [("A#C", 10**6), ("***", 10**6)], "key string, count long").where("count > 0").repartition(3)
    some = [true, P.TreeModel("ACGT-", pi, P.gap_rates(pi, 1.0, 1.0), tree)]
    assert P.log_likelihoods(df, some, species) == pytest.approx([brute_likelihood(m, species, columns) for m in some])
    fit = P.fit_model(df.where("key not like '%#%' and key <> '***'"), tree, species, tolerance=0.004)
    rises = [t[1] for t in fit.trace]
    assert rises == sorted(rises) and len(rises) > 3
    assert fit.trace[-1][2:] == pytest.approx((1.7, 3.5, 0.4), rel=0.01)
    assert fit.model.background == pytest.approx(pi, abs=1e-3)
    none = P.fit_model(df.where("count < 0"), tree, species)
    assert none.trace == [] and none.model.tree == tree


def t_tail(t, df, steps=20_000):
    """Both tails of the t distribution, by Simpson's rule over its density."""
    c = math.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / math.sqrt(df * math.pi)
    h = abs(t) / steps
    f = [c * (1 + (k * h) ** 2 / df) ** (-(df + 1) / 2) for k in range(steps + 1)]
    return 1 - 2 * h / 3 * (f[0] + f[-1] + 4 * sum(f[1:-1:2]) + 2 * sum(f[2:-1:2]))


def test_summary_of_four_regressors(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(60, 4))
    y = x @ [1.0, -0.5, 0.0, 0.1] + 2 + rng.normal(size=60)
    rows = [(*map(float, r), float(v)) for r, v in zip(x, y, strict=True)] + [(None, 1.0, 1.0, 1.0, 5.0), (1.0, 1.0, 1.0, 1.0, None)]
    got = {r.term: r for r in T.ols_summary(spark.createDataFrame(rows, "a double, b double, c double, d double, y double"), "y", ["a", "b", "c", "d"]).collect()}
    full = np.column_stack([x, np.ones(60)])
    inverse = np.linalg.inv(full.T @ full)
    beta = inverse @ full.T @ y
    rest = y - full @ beta
    error = np.sqrt(np.diag(inverse) * (rest @ rest) / 55)
    for k, term in enumerate(["a", "b", "c", "d", "(Intercept)"]):
        r = got[term]
        assert (r.estimate, r.std_error, r.t) == pytest.approx((beta[k], error[k], beta[k] / error[k]))
        assert r.p == pytest.approx(t_tail(beta[k] / error[k], 55), abs=1e-8) and r.r2 == pytest.approx(1 - rest @ rest / ((y - y.mean()) ** 2).sum())


@pytest.mark.parametrize(("block", "keys"), [(512, 4096), (3, 2), (1, 1)])
def test_sparse_dot_with_zeros_sends_no_matrix(spark, block, keys):
    rng = random.Random(block)
    rows = [(i, f"k{k}", rng.choice([-1.0, 0.5, 2.0])) for i in range(11) for k in range(9) if rng.random() < 0.3]
    df, items = spark.createDataFrame(rows, "seq_id int, kmer string, w double"), spark.createDataFrame([(i,) for i in range(14)], "seq_id int")
    plain = Y.complete(Y.sparse_dot(df, block=block, keys=keys), items, block=block)
    want = {(r.i, r.j): round(r.w, 9) for r in plain.collect()}
    assert len(want) == 14 * 15 // 2
    rows_of = lambda df: [(r.i, r.j, round(r.w, 9)) for r in df.collect()]
    assert sorted(rows_of(Y.sparse_dot(df, block=block, keys=keys, items=items))) == sorted((*k, v) for k, v in want.items())
    both = rows_of(Y.sparse_dot(df, block=block, keys=keys, items=items, both=True))
    assert sorted(both) == sorted((*k, v) for k, v in (want | {(j, i): v for (i, j), v in want.items()}).items())
    labels = spark.createDataFrame([(i, "ab"[i % 2]) for i in range(14)], "row_idx int, label string")
    # a matrix is sent to no task, however small its estimate: what is sent are labels
    for matrix, sent in ((plain, 0), (S.matrix_text(Y.mirrored(plain)), 0), (Y.edge_weights(plain, labels), 2)):
        assert matrix._jdf.queryExecution().sparkPlan().toString().count("BroadcastHashJoin") == sent


def test_shares_are_rounded_as_doubles(spark):
    from weftline.operators import intervals as I

    asked = spark.createDataFrame([(0, "chr1", 0, 160), (1, "chr1", 1000, 1064), (2, "chr1", 5000, 5060)], "row_idx int, chrom string, start long, end long")
    parts = spark.createDataFrame([(0, "a", "0", "chr1", 0, 3), (0, "a", "0", "chr1", 1000, 1002)], "ord int, name string, score string, chrom string, start long, end long")
    # 0.01875 is a double below the tie, 0.03125 is one
    assert {r.row_idx: r.frac_overlap for r in I.first_partition(asked, parts).collect()} == {0: "0.0187", 1: "0.0312", 2: "1.0000"}


@pytest.mark.parametrize("n", [1, 3, 64])
def test_closest_is_that_of_differences(n):
    """Ties, equal points, other points too far to be squared or not there: all as by differences."""
    draw = np.random.default_rng(n)
    xs, ys = (np.round(draw.normal(size=(k, n)), 1 if n < 4 else 9) for k in (60, 90))
    ys[40:60] = ys[:20]
    rank = np.arange(90)[::-1]
    for odd in (False, True):
        if odd:
            xs[3, 0], ys[5, 0], ys[7, 0] = np.inf, np.nan, 1e200
        want = []
        with np.errstate(over="ignore"):
            for k, x in enumerate(xs):
                far = ((x - ys) ** 2).sum(-1)
                there = np.flatnonzero(far == far).tolist()
                if there:
                    want.append((k, *min(((far[j], ys[j].tolist(), rank[j], j) for j in there))))
            got = list(zip(*(v.tolist() for v in N._closest(xs, ys, rank)), strict=True))
        assert got == [(w[0], w[4], w[1]) for w in want]


def test_distances_in_tiles(spark):
    """All pairs, in blocks of two: those with a null or another length are null, one label is no pair; tasks add up arrays, no expression does it pair by pair."""
    points = [(1, [0.0, 3.0]), (2, [4.0, 0.0]), (5, [1.0]), (7, [1.0, None]), (9, None), (11, [0.0, 3.0])]
    rows = Y.distances(spark.createDataFrame(points, "label long, p array<double>"), block=2)
    got = {(r.i, r.j): r.w for r in rows.collect()}
    assert got == {(i, j): (5.0 if (i, j) in ((1, 2), (2, 11)) else 0.0 if (i, j) == (1, 11) else None) for i, _ in points for j, _ in points if i < j}
    assert "FlatMapGroupsInArrow" in rows._jdf.queryExecution().executedPlan().toString()


def test_hierarchical_ends_in_a_task_as_it_goes_on_in_joins(spark):
    """Ties, pairs that are not given, two problems: rounds on few clusters in a task give the merges that rounds of joins give."""
    draw = random.Random(5)
    rows = [(p, i, j, float(draw.randint(0, 4))) for p, n in (("x", 30), ("y", 9)) for i in range(n) for j in range(i) if draw.random() < 0.7]
    table = spark.createDataFrame(rows, "problem string, i int, j int, w double")
    every = [sorted(tuple(r[:5]) + (round(r.sim, 9),) for r in CL.hierarchical(table, held=held).collect()) for held in (0, 12, 2_048)]
    assert every[0] == every[1] == every[2]


def test_row_sums_are_those_of_the_pairs(spark):
    """Sums of rows without the pairs: the matrix is gone through once."""
    rows = spark.createDataFrame([(1, "a", 2.0), (1, "b", 1.0), (2, "a", 3.0), (3, "b", 4.0), (3, "b", 1.0), (4, "c", 1.0), (5, None, 1.0)], "seq_id int, kmer string, w double")
    pairs = Y.sparse_dot(rows, both=True)
    want = {r.i: r.d for r in pairs.where("i <> j").groupBy("i").agg(F.sum("w").alias("d")).collect()}
    sums = Y.row_sums(rows)
    assert {r.i: r.d for r in sums.collect() if r.d} == want
    flat = [sorted(tuple(r) for r in Y.affinity_normalize(pairs, *known).collect()) for known in ((), (sums,))]
    assert flat[0] == flat[1] and flat[0]


def test_short_tiles_are_few_tasks(spark, tmp_path):
    """Tasks are as many as the bases ask for, not as the tiles."""
    text = "".join(random.Random(1).choice("ACGTN") for _ in range(5_001))
    packed.write_packed(spark.createDataFrame([("c", 0, text)], "chrom string, tile_no long, seq string"), str(tmp_path))
    reader = packed.PackedReader(str(tmp_path), 3, 4)
    assert len(reader.partitions()) == 1
    assert {(r.tile_no, r.seq) for r in packed.read_packed(spark, str(tmp_path), 3, 4).collect()} == {(k, text[3 * k : 3 * k + 3]) for k in range(1_667)}


def test_lines_are_not_shuffled_to_be_numbered(spark, tmp_path):
    """Of what numbers lines, and of what curves are laid on, only a row for each split or source is sent, whatever the planner takes it for."""
    folder = str(tmp_path / "lines")
    spark.range(100).selectExpr("concat('R ', id) AS value").write.text(folder)
    names = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    for n in names:
        spark.conf.set(n, "-1")
    try:
        rows = S.read_labelled_scores(spark, folder)
        places = S.numbered_rows(rows, ["score"])
        plans = [r._jdf.queryExecution().executedPlan().toString() for r in (rows, places)]
        assert not any("SortMergeJoin" in p for p in plans)
        assert sorted(r.row_idx for r in rows.collect()) == list(range(100))
        curves = T.roc_curves(rows.withColumn("source", F.lit("s")), "source", "score", F.col("label") == "R", 4)
        assert curves._jdf.queryExecution().executedPlan().toString().count("SortMergeJoin") == 1  # of the grid and its counts
        assert curves.count() == 4
    finally:
        for n in names:
            spark.conf.unset(n)


def test_linkage_of_vectors_is_that_of_their_products(spark):
    """Without a pair: ties, items without a key, rounds of blocks and the task that ends them; one item is no merge; weights that are not whole go by the pairs."""
    a, b = np.array([0, 1, 5, 2**31 - 1], np.int32), np.array([1, 9, 100_000, -(2**31)], np.int32)
    pairs = spark.createDataFrame(list(zip(a.tolist(), b.tolist(), strict=True)), "a int, b int")
    assert [r.h for r in pairs.select(F.xxhash64("a", "b").alias("h")).collect()] == CL._pair_hash(a, b).tolist()
    draw = random.Random(3)
    rows_of = lambda df: sorted((r.stage, r.n_clusters, r.left, r.right, round(r.sim, 9)) for r in df.collect())
    for n, part in ((1, 1.0), (40, 1.0), (12, 0.5)):
        rows = [(i, f"k{k}", part * draw.randint(0, 2)) for i in range(n) for k in range(6) if draw.random() < 0.6 and i != 5]
        df, items = spark.createDataFrame(rows, "seq_id int, kmer string, w double"), spark.createDataFrame([(i,) for i in range(n)], "seq_id int")
        want = rows_of(CL.hierarchical(Y.sparse_dot(df, items=items).select(F.lit("all").alias("problem"), "i", "j", "w")))
        assert len(want) == n - 1
        for held in (5, 16_384):
            assert rows_of(CL.hierarchical_of(df, items, held=held)) == want


def test_dendrograms_are_walked_as_they_are_joined(spark):
    draw, nodes, merges = random.Random(8), [-(k + 1) for k in range(50)], []
    for stage in range(1, 50):
        pair = [nodes.pop(draw.randrange(len(nodes))) for _ in "ab"]
        merges.append((stage, *pair, draw.randint(0, 9) / 4))
        nodes.append(stage)
    table = spark.createDataFrame(merges, "stage int, left int, right int, sim double").repartition(3)
    for level in (-1.0, 1.0, 3.0):
        cuts = [CL.cut_dendrogram(table, level, held=held) for held in (0, 49)]
        assert cuts[0].schema == cuts[1].schema or cuts[0].dtypes == cuts[1].dtypes
        assert sorted(map(tuple, cuts[0].collect())) == sorted(map(tuple, cuts[1].collect()))
    lines = [sorted(tuple(round(v, 9) for v in r) for r in CL.layout_dendrogram(table, held=held).collect()) for held in (0, 49)]
    assert lines[0] == lines[1] and len(lines[0]) == 147


def _labelled_vectors(spark):
    """Vectors of which some have no key, or none in common, a label for each, and their products."""
    draw = random.Random(6)
    rows = [(i, f"k{k}", draw.choice([0.5, 1.0, 2.0])) for i in range(13) for k in range(7) if draw.random() < 0.3 and i != 4]
    df = spark.createDataFrame(rows, "seq_id int, kmer string, w double")
    return df, spark.createDataFrame([(i, "abc"[i % 3]) for i in range(15)], "row_idx int, label string")


@pytest.mark.parametrize("block", [512, 2])
def test_blocks_of_vectors_are_fetched(spark, block):
    """A block is packed and written once, not once for each other one; zero weights and negative ones count as keys in common."""
    df, labels = _labelled_vectors(spark)
    df = df.unionByName(spark.createDataFrame([(20, "k1", 0.0), (21, "k1", -1.0), (21, "k2", 1.0)], df.schema))
    vectors: dict = {}
    for r in df.collect():
        vectors.setdefault(r.seq_id, {})[r.kmer] = r.w
    for both in (False, True):
        out = Y.sparse_dot(df, block=block, both=both)
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" in plan and "Generate" not in plan and "Broadcast" not in plan
        want = {(i, j): sum(a[k] * b[k] for k in a.keys() & b.keys()) for i, a in vectors.items() for j, b in vectors.items() if (both or i <= j) and a.keys() & b.keys()}
        got = out.collect()
        assert len(got) == len(want) and {(r.i, r.j): round(r.w, 9) for r in got} == {k: round(v, 9) for k, v in want.items()}


@pytest.mark.parametrize("block", [512, 2])
def test_affinity_is_scaled_where_it_is_made(spark, block):
    df, _ = _labelled_vectors(spark)
    rows_of = lambda m: {(r.i, r.j): round(r.w, 9) for r in m.collect()}
    want = rows_of(Y.affinity_normalize(Y.sparse_dot(df, both=True), Y.row_sums(df)))
    out = Y.affinity(df, block=block)
    assert want and rows_of(out) == want == rows_of(Y.affinity(df, block=block, keys=3))
    assert out._jdf.queryExecution().executedPlan().toString().split("CartesianProduct")[0].count("Join") == 0


def test_rounded_as_spark_does(spark):
    draw = np.random.default_rng(4)
    x = [*(draw.normal(size=500) * 10.0 ** draw.integers(-12, 20, 500)).tolist(), 0.5e-9, 1.5e-9, -2.5e-9, 0.0, math.inf, -math.inf, 1e300, 2.0000000005, 0.1234567885, 1e-320]
    want = [r.r for r in spark.createDataFrame([(v,) for v in x], "x double").select(F.round("x", 9).alias("r")).collect()]
    assert Y.rounded(np.array(x), 9).tolist() == want and math.isnan(Y.rounded(np.array([math.nan]), 9)[0])


@pytest.mark.parametrize("block", [512, 2])
def test_edges_have_their_labels_where_they_are_made(spark, block):
    df, labels = _labelled_vectors(spark)
    items = labels.select(F.col("row_idx").alias("seq_id"))
    rows_of = lambda m: sorted((r.name, round(r.w, 9)) for r in m.collect())
    want = rows_of(Y.edge_weights(Y.complete(Y.sparse_dot(df), items), labels))
    out = Y.edge_weights_of(df, labels, block=block)
    assert want and rows_of(out) == want == rows_of(Y.edge_weights_of(df, labels, block=block, keys=3))
    assert out._jdf.queryExecution().executedPlan().toString().split("CartesianProduct")[0].count("Join") == 0


def test_means_of_edges_without_edges(spark):
    df, labels = _labelled_vectors(spark)
    for some in (labels, labels.where("row_idx < 2"), labels.where("label = 'a'"), labels.where("row_idx = 3")):
        items = some.select(F.col("row_idx").alias("seq_id"))
        want = sorted((r.same, round(r["mean"], 9), r.n) for r in Y.edge_means(Y.complete(Y.sparse_dot(df.join(items, "seq_id")), items), some).collect())
        out = Y.edge_means_of(df, some)
        assert sorted((r.same, round(r["mean"], 9), r.n) for r in out.collect()) == want
    assert "InArrow" not in out._jdf.queryExecution().executedPlan().toString()


def test_blocks_of_points_are_fetched(spark):
    """A block is written once, not once for each other one; labels that repeat are no pair, points without coordinates are at one place."""
    points = [(1, [0.1, 3.0]), (2, [4.0, 0.0]), (5, []), (6, []), (2, [1.0, 1.0])]
    want = sorted([(1, 2, 4.92036584), (1, 2, 2.19317122), (1, 5, None), (1, 6, None), (5, 6, 0.0)] + [(2, x, None) for x in (5, 6)] * 2, key=str)
    for block in (1, 1_024):
        out = Y.distances(spark.createDataFrame(points, "label long, p array<double>"), block=block, digits=8)
        assert sorted(map(tuple, out.collect()), key=str) == want
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" in plan and "Generate" not in plan and "Broadcast" not in plan


def test_rows_of_text_are_made_whole(spark, tmp_path):
    """Each row is written by the task that has made all of it: no pair is shuffled; items that are not there are rows of zeros, numbers have nine decimals."""
    df, labels = _labelled_vectors(spark)
    df = df.where("seq_id <> 7").unionByName(spark.createDataFrame([(16, "k1", -0.3), (16, "k2", 2e6)], df.schema))
    items = labels.where("row_idx not in (7, 9)").select(F.col("row_idx").alias("seq_id"))
    want = [r.value for r in S.matrix_text(Y.sparse_dot(df, items=items, both=True)).orderBy("i").collect()]
    for cells, block in ((8_388_608, 8_192), (40, 3)):
        out = Y.dot_text(df, items, cells=cells, block=block)
        assert [r.value for r in out.collect()] == want
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" in plan and "rangepartitioning" not in plan.lower() and "collect_list" not in plan
    out.select("value").write.option("compression", "gzip").text(str(tmp_path / "m"))
    assert {(r.i, r.j): r.w for r in S.read_matrix(spark, str(tmp_path / "m"), labelled=True).collect()} == {(i, j): float(c) for i, line in enumerate(want) for j, c in enumerate(line.split("\t")[1:])}
