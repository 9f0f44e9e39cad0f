"""Scores in windows, Markov models of variable order, and blocks laid over intervals, against brute force."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from test_operators import blocks_of, comp
from weftline.operators import scoring as G
from weftline.operators import tiling as L


# windows


@pytest.mark.parametrize(("width", "step", "stretch"), [(1, 1, 16), (5, 1, 16), (5, 3, 16), (40, 1, 16), (7, 1, 65_536)])
def test_windows_over_ends_of_stretches(spark, monkeypatch, width, step, stretch):
    monkeypatch.setattr(G, "STRETCH", stretch)
    rng = random.Random(width)
    rows = {(c, p): rng.choice([None, 1.5, -2.0, 0.25]) for c in ("a", "b") for p in range(-30, 300) if rng.random() < 0.985}
    df = spark.createDataFrame([(*k, v) for k, v in rows.items()] + [("a", 5, None)] * 3, "chrom string, pos long, score double")
    got = {(r.chrom, r.start): (r.n, r.score) for r in G.window_scores(df, width, step, most_missing=2).collect()}
    want = {}
    for c, p in rows:
        if p % step == 0 and all((c, p + k) in rows for k in range(width)):
            some = [rows[c, p + k] for k in range(width) if rows[c, p + k] is not None]
            want[c, p] = (len(some), sum(some) / len(some) if some and width - len(some) <= 2 else None)
    assert got.keys() == want.keys() and len(want) > 3
    for k, (n, s) in want.items():
        assert got[k][0] == n and (got[k][1] == pytest.approx(s, abs=1e-9) if s is not None else got[k][1] is None)


def test_windows_of_nothing(spark):
    none = spark.createDataFrame([], "chrom string, pos long, score double")
    assert G.window_scores(none).count() == 0
    assert G.window_scores(spark.createDataFrame([("a", k, 1.0) for k in range(99)], none.schema)).count() == 0
    assert [tuple(r) for r in G.window_scores(spark.createDataFrame([("a", k, 1.0) for k in range(100)], none.schema)).collect()] == [("a", 0, 100, 1.0)]


# context trees


def brute_counts(sequences, order):
    out: dict = {}
    for ints in sequences:
        for i, x in enumerate(ints):
            for d in range(order + 1):
                before = ints[max(0, i - d) : i]
                if x >= 0 and len(before) == d and all(b >= 0 for b in before):
                    out.setdefault(tuple(before), Counter())[x] += 1
    return out


def brute_tree(counts, least, divergence):
    """Leaves that are not worth keeping are taken away, as long as there are any."""
    def worth(c):
        if not c:
            return True
        n, up = sum(counts[c].values()), counts[c[1:]]
        kl = sum(k / n * math.log(k / n / (up[s] / sum(up.values()))) for s, k in counts[c].items())
        return n >= least and kl >= divergence

    tree = set(counts)
    while True:
        leaves = [c for c in tree if not any(k[1:] == c and k != c for k in tree) and not worth(c)]
        if not leaves:
            return tree
        tree -= set(leaves)


def hard_sequences():
    """Symbols that follow one another by a rule of second order, missing ones, empty and short sequences."""
    rng = random.Random(9)
    out = [[], [-1], [2], [-1, -1, 0]]
    for _ in range(60):
        s = [0, 1]
        for _ in range(rng.randrange(40)):
            s.append((s[-1] + 2 * s[-2]) % 3 if rng.random() < 0.8 and s[-1] >= 0 and s[-2] >= 0 else rng.choice([0, 1, 2, -1]))
        out.append(s)
    return out


def context(c):
    return " ".join(map(str, c))


@pytest.mark.parametrize(("order", "least", "divergence"), [(3, 10, 0.01), (4, 5, 0.2), (0, 10, 0.01), (2, 10**6, 0.01)])
def test_context_tree(spark, order, least, divergence):
    sequences = hard_sequences()
    df = spark.createDataFrame(list(enumerate(sequences)), "seq_id long, ints array<int>")
    counts = G.context_counts(df, order)
    want = brute_counts(sequences, order)
    assert {(r.context, r.symbol): r["count"] for r in counts.collect()} == {(context(c), s): n for c, k in want.items() for s, n in k.items()}
    tree = {r.context: r for r in G.context_tree(counts, least, divergence).collect()}
    kept = brute_tree(want, least, divergence)
    assert set(tree) == {context(c) for c in kept}
    assert all(tree[context(c)].total == sum(want[c].values()) and tree[context(c)].depth == len(c) for c in kept)


def test_scores_by_the_longest_context(spark):
    sequences = hard_sequences()
    rows = [(k, k % 2 == 0, s) for k, s in enumerate(sequences)]
    df = spark.createDataFrame(rows, "seq_id long, good boolean, ints array<int>")
    counts = G.context_counts(df, 3, ("good",))
    tree = G.context_tree(counts, 10, 0.05, ("good",))
    table = G.log_odds(counts, tree, F.col("good"), pseudo=0.5)
    sides = [brute_counts([s for _, g, s in rows if g == side], 3) for side in (True, False)]
    kept = set().union(*(brute_tree(c, 10, 0.05) for c in sides))
    share = lambda c, ctx, s: (c.get(ctx, {}).get(s, 0) + 0.5) / (sum(c.get(ctx, {}).values()) + 1.5)
    want = {}
    for k, _, ints in rows:
        for i, x in enumerate(ints):
            ctx = max((tuple(ints[i - d : i]) for d in range(min(i, 3) + 1) if tuple(ints[i - d : i]) in kept and all(v >= 0 for v in ints[i - d : i])), key=len)
            want[k, i] = math.log(share(sides[0], ctx, x) / share(sides[1], ctx, x)) if x >= 0 else None
    places = G.position_scores(df, table, 3)
    got = {(r.seq_id, r.pos): r.score for r in places.collect()}
    assert got.keys() == want.keys() and all(got[k] is None if v is None else got[k] == pytest.approx(v) for k, v in want.items())
    means = {r.seq_id: r for r in G.sequence_scores(places, most_missing=1).collect()}
    for k, _, ints in rows:
        some = [want[k, i] for i in range(len(ints)) if want[k, i] is not None]
        if ints:
            ok = some and len(ints) - len(some) <= 1
            assert means[k].n == len(some) and (means[k].score == pytest.approx(sum(some) / len(some)) if ok else means[k].score is None)


# blocks over intervals


def pieces_of(spark, rows):
    return spark.createDataFrame(rows, "chrom string, start long, end long, score double, id long").repartition(3)


@pytest.mark.parametrize("cell", [7, 64, 65_536])
def test_best_cover(spark, cell):
    rng = random.Random(cell)
    rows = [(rng.choice("ab"), s := rng.randrange(200), s + rng.randrange(-1, 40), rng.choice([None, 1.0, 2.0, 3.0]), k) for k in range(120)]
    rows += [("a", 50, 90, 3.0, 1000 + k) for k in range(300)]  # very many over the same bases
    best: dict = {}
    for c, s, e, score, k in rows:
        for p in range(s, e):
            best[c, p] = min(best.get((c, p), (math.inf, math.inf, math.inf)), (-score if score is not None else math.inf, s, k))
    got, ends = {}, []
    for r in L.best_cover(pieces_of(spark, rows), cell=cell).collect():
        ends.append((r.chrom, r.start, r.end, r.id))
        for p in range(r.start, r.end):
            assert (r.chrom, p) not in got
            got[r.chrom, p] = r.id
    assert got == {k: v[2] for k, v in best.items()}
    assert not {(c, e, k) for c, _, e, k in ends} & {(c, s, k) for c, s, _, k in ends}  # stretches are maximal


def test_cells_are_laid_together(spark, monkeypatch):
    """Cells are many and have few pieces each: a task paints all that it has at hand at once, not one after the other; batches that end within a cell, too."""
    calls, paint = spark.sparkContext.accumulator(0), L._painted

    def counted(*args):
        calls.add(1)
        return paint(*args)

    monkeypatch.setattr(L, "_painted", counted)
    rows = [(f"c{k % 2}", k * 10, k * 10 + 25, float(k % 3), k) for k in range(3000)]
    got = [[tuple(r) for r in L.best_cover(pieces_of(spark, rows), cell=50).collect()]]
    assert 0 < calls.value < 200
    monkeypatch.setattr(L, "_painted", paint)
    monkeypatch.setattr(L, "ROWS", 7)
    got += [[tuple(r) for r in L.best_cover(pieces_of(spark, rows), cell=c).collect()] for c in (50, 65_536)]
    assert sorted(got[0]) == sorted(got[1]) == sorted(got[2]) and len(got[0]) > 2000


@pytest.mark.parametrize("cell", [5, 65_536])
def test_cover_depth(spark, cell):
    rng = random.Random(cell)
    rows = [(rng.choice("ab"), s := rng.randrange(300), s + rng.randrange(-2, 30)) for _ in range(60)] + [("b", 0, 1000), ("b", 0, 1000)]
    depth = Counter((c, p) for c, s, e in rows for p in range(s, e))
    got = L.cover_depth(spark.createDataFrame(rows, "chrom string, start long, end long"), cell=cell).collect()
    assert {(r.chrom, p): r.depth for r in got for p in range(r.start, r.end)} == dict(depth) and sum(r.end - r.start for r in got) == len(depth)
    assert not any(a.chrom == b.chrom and a.end == b.start and a.depth == b.depth for a in got for b in got)


def random_block(rng, k):
    n = rng.randrange(1, 25)
    texts = ["".join(rng.choice("ACGTacgt--*") for _ in range(n)) for _ in range(3)]
    parts = []
    for text, s in zip(texts, ("hg", "mm", "rn"), strict=True):
        size = len(text.replace("-", ""))
        parts.append(comp(text, f"{s}.chr1", rng.randrange(60) if s == "hg" else rng.randrange(500), size, rng.choice("+-") if s != "hg" or k % 2 else "+", 100 if s == "hg" else 600))
    return parts[: rng.choice([2, 3])]


def forward(c):
    return (c[4] - c[1] - c[2], c[4] - c[1]) if c[3] == "-" else (c[1], c[1] + c[2])


PAIRS = str.maketrans("ACGTacgt", "TGCAtgca")


def bases(c):
    """Place on the forward strand and the column of each base of a component."""
    low, high = forward((*c[:2], c[2], c[3], c[4]))
    columns = [i for i, ch in enumerate(c[5]) if ch != "-"]
    return {(high - 1 - n if c[3] == "-" else low + n): i for n, i in enumerate(columns)}


def places(c):
    return (c[0], c[1], c[2], c[3], c[4], c[5])


def test_ranges_are_cut_out_of_blocks_on_either_strand(spark):
    rng = random.Random(4)
    blocks = [random_block(rng, k) for k in range(60)]
    asks = [(k, "chr1", s := rng.randrange(100), s + rng.randrange(0, 25), rng.choice("+-")) for k in range(40)]
    intervals = spark.createDataFrame(asks, "row_idx long, chrom string, start long, end long, strand string")
    for by_strand in (False, True):
        got = {(r.row_idx, r.block_id): [tuple(c) for c in r.components] for r in L.extract_ranges(intervals, blocks_of(spark, *blocks), by_strand=by_strand).collect()}
        want = set()
        for row, _, start, end, strand in asks:
            for k, block in enumerate(blocks):
                hit = sorted(i for p, i in bases((block[0][0], block[0][1], block[0][2], block[0][3], block[0][4], block[0][5])).items() if start <= p < end)
                if not hit:
                    continue
                want.add((row, k))
                a, b = hit[0], hit[-1] + 1
                for c, cut in zip(block, got[row, k], strict=True):
                    src, s, size, side, src_size, text = c
                    part = text[a:b]
                    s, size = s + len(text[:a].replace("-", "")), len(part.replace("-", ""))
                    if by_strand and block[0][3] != strand:
                        s, side, part = src_size - s - size, "-" if side == "+" else "+", part[::-1].translate(PAIRS)
                    assert cut == (src, s, size, side, src_size, part)
        assert set(got) == want and len(want) > 50
    whole = L.extract_ranges(intervals, blocks_of(spark, *blocks), chop=False).collect()
    assert all([tuple(c) for c in r.components] == [tuple(c) for c in blocks[r.block_id]] for r in whole)


def test_pieces_of_chopped_blocks_follow_each_other(spark):
    rng = random.Random(6)
    blocks = [random_block(rng, k) for k in range(30)] + [[comp("")]]
    got: dict = {}
    for r in L.chop_blocks(blocks_of(spark, *blocks), 7).orderBy("block_id", "piece").collect():
        assert r.piece == len(got.setdefault(r.block_id, [])) and len(r.components[0].text) <= 7
        got[r.block_id].append(r.components)
    for k, block in enumerate(blocks):
        for i, c in enumerate(block):
            parts = [p[i] for p in got[k]]
            assert "".join(p.text for p in parts) == c[5]
            at = c[1]
            for p in parts:
                assert (p.src, p.start, p.size, p.strand) == (c[0], at, len(p.text.replace("-", "")), c[3])
                at += p.size


def test_tiles(spark):
    rng = random.Random(8)
    blocks = [random_block(rng, k) for k in range(40)]
    score = [rng.choice([None, 1.0, 2.0]) for _ in blocks]
    df = blocks_of(spark, *blocks).withColumn("score", F.element_at(F.array(*map(F.lit, score)), (F.col("block_id") + 1).cast("int")))
    asks = [(k, "chr1", s := rng.randrange(90), s + rng.randrange(0, 40), rng.choice("+-")) for k in range(25)] + [(100, "chr2", 5, 9, "-")]
    intervals = spark.createDataFrame(asks, "row_idx long, chrom string, start long, end long, strand string")
    own = [bases(places(b[0])) for b in blocks]
    best = {p: min((-score[k] if score[k] is not None else math.inf, forward(places(blocks[k][0]))[0], k) for k in range(len(blocks)) if p in own[k])[2] for p in set().union(*own)}
    got = {r.row_idx: r.components for r in L.tile_blocks(intervals, df, ["hg", "mm", "rn"], by_strand=True).collect()}
    assert set(got) == {a[0] for a in asks}
    for row, chrom, start, end, strand in asks:
        runs = []
        for p in range(start, end):
            k = best.get(p) if chrom == "chr1" else None
            if runs and runs[-1][0] == k:
                runs[-1][1].append(p)
            else:
                runs.append((k, [p]))
        texts = ["", "", ""]
        for k, at in runs:
            for i in range(3):
                if k is None:
                    texts[i] += "*" * len(at)
                    continue
                columns = sorted(own[k][p] for p in at)
                a, b = columns[0], columns[-1] + 1
                part = blocks[k][i][5][a:b] if i < len(blocks[k]) else "*" * (b - a)
                texts[i] += part[::-1].translate(PAIRS) if blocks[k][0][3] == "-" else part
        if strand == "-":
            texts = [t[::-1].translate(PAIRS) for t in texts]
        assert [c.text for c in got[row]] == texts
        assert (got[row][0].src, got[row][0].start, got[row][0].size, got[row][0].strand) == (f"hg.{chrom}", start, end - start, strand)


def test_blocks_that_no_interval_meets_are_not_laid(spark, monkeypatch):
    """Only blocks in bins of intervals are put over each other, each once; empty intervals ask for none and have empty texts."""
    laid, cover = [], L.best_cover

    def counted(pieces):
        laid.append(sorted(r.id for r in pieces.select("id").collect()))
        return cover(pieces)

    monkeypatch.setattr(L, "best_cover", counted)
    b = L.RANGE_BIN
    starts = [b - 3, 10, 12 * b, 40 * b, 3 * b]  # the first lies in two bins
    df = blocks_of(spark, *([comp("ACGTAC", "hg.chr1", s, 6, "+", 50 * b), comp("AAGGTT", "mm.chr2", 5, 6, "+", 900)] for s in starts))
    asks = [(0, "chr1", 8, b + 1), (1, "chr1", 3 * b + 2, 3 * b + 2), (2, "chr9", 12 * b, 12 * b + 9), (3, "chr1", 40 * b + 2, 40 * b + 4)]
    got = {r.row_idx: [c.text for c in r.components] for r in L.tile_blocks(spark.createDataFrame(asks, "row_idx long, chrom string, start long, end long"), df, ["hg", "mm"]).collect()}
    assert laid == [[0, 1, 3]]
    gap = "*" * (b - 3 - 16)
    assert got == {0: [f"**ACGTAC{gap}ACGT", f"**AAGGTT{gap}AAGG"], 1: ["", ""], 2: ["*" * 9] * 2, 3: ["GT", "GG"]}


def test_ranges_covered_by_enough_species(spark):
    rng = random.Random(3)
    blocks = [random_block(rng, k) for k in range(12)]
    at: dict = {}
    for b in blocks:
        for p in bases(places(b[0])):
            at.setdefault(p, set()).update(c[0].split(".")[0] for c in b)
    for least in (1, 3):
        got = L.covered_ranges(blocks_of(spark, *blocks), ["hg", "mm", "rn"], least).collect()
        assert sorted(p for r in got for p in range(r.start, r.end)) == sorted(p for p, s in at.items() if len(s) >= least)
        assert not {r.end for r in got} & {r.start for r in got}


@pytest.mark.parametrize("cell", [5, 65_536])
def test_covered_ranges_over_ends_of_cells(spark, monkeypatch, cell):
    """A block is a row where it starts and one where it ends, whatever its species: no row for each of them is written, and ranges go on over cells."""
    rng = random.Random(cell)
    wrote, save = [], L.saved
    keep = lambda df: wrote.append((out := save(df)).count()) or out
    monkeypatch.setattr(L, "saved", keep)
    monkeypatch.setattr("weftline.operators.intervals.saved", keep)
    blocks = []
    for k in range(150):
        n = rng.choice([0, 1, 4, 30])
        names = ["hg", *rng.sample(["mm", "rn", "xx", "mm"], rng.randrange(1, 4))]
        blocks.append([comp("A" * n, f"{s}.chr{1 + k % 2}", rng.randrange(900) if s == "hg" else 7, n, rng.choice("+-"), 1000) for s in names])
    at: dict = {}
    for b in blocks:
        for p in bases(places(b[0])):
            at.setdefault((b[0][0].split(".")[1], p), set()).update(c[0].split(".")[0] for c in b)
    for least in (1, 2, 3, 4):
        wrote.clear()
        got = L.covered_ranges(blocks_of(spark, *blocks), ["hg", "mm", "rn", "mm"], least, cell=cell).collect()
        want = {k for k, s in at.items() if len(s & {"hg", "mm", "rn"}) >= least}
        assert sorted((r.chrom, p) for r in got for p in range(r.start, r.end)) == sorted(want) and bool(want) == (least < 4)
        assert not {(r.chrom, r.end) for r in got} & {(r.chrom, r.start) for r in got}
        assert wrote[0] <= 2 * len(blocks) and len(wrote) == 2 and wrote[1] == 2 * len(got)


def test_ranges_are_cut_after_the_join(spark):
    """What is asked of the cut components is not worked out in the join's condition, for each pair in a bin."""
    from oracle import DATA
    from weftline.plans import QUERIES

    for name in ("extract_ranges", "extract_ranges_by_strand"):
        assert "Join" not in QUERIES[name](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()


def test_scores_of_runs_are_those_of_places(spark):
    """Places are added up in their rows, and windows made of runs; histories and symbols that no table has, gaps, rows without places and repeated places, too."""
    draw = random.Random(3)
    sequences = [(k, [draw.choice([-1, 0, 1, 2, 7]) for _ in range(draw.randint(0, 30))]) for k in range(40)]
    rows = spark.createDataFrame(sequences, "seq_id long, ints array<int>")
    table = spark.createDataFrame([(0, "", 0, 0.5), (0, "", 1, 0.25), (1, "0", 1, -1.0), (2, "1 0", 1, 3.0), (1, "7", 2, 9.0)], "depth int, context string, symbol int, score double")
    known = {(c, s): x for _, c, s, x in [tuple(r) for r in table.collect()]}
    want = {}
    for k, ints in sequences:
        for i, x in enumerate(ints):
            before = []
            for y in ints[max(0, i - 2) : i]:
                before = [] if y < 0 else [*before, str(y)]
            found = [known.get((" ".join(before[d:]), x)) for d in range(len(before) + 1)] if x >= 0 else []
            want[k, i] = next((f for f in found if f is not None), None)
    runs = G.scored(rows, table, 2)
    assert {(r.seq_id, i): x for r in runs.collect() for i, x in enumerate(r.scores)} == want
    places = G.position_scores(rows, table, 2)
    means = [{r.seq_id: (r.n, r.score and round(r.score, 9)) for r in m.collect()} for m in (G.sequence_scores(places, most_missing=9), G.run_scores(runs, most_missing=9))]
    assert means[0] == means[1]
    laid = runs.select(F.lit("c").alias("chrom"), (F.col("seq_id") * 11).alias("at"), "scores")
    flat = laid.select("chrom", "at", F.posexplode("scores").alias("pos", "score")).select("chrom", (F.col("at") + F.col("pos")).alias("pos"), "score")
    every = [sorted(map(tuple, w.collect())) for w in (G.run_windows(laid, 5, 2, most_missing=3), G.window_scores(flat, 5, 2, most_missing=3))]
    assert every[0] == every[1] and every[0]
