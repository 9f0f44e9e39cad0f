"""Hard negatives, whitening and chat formatting against brute force and round trips, with nulls, empty and
long values, ties, repeated rows, empty tables and clashing names."""

import hashlib
import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from weftline.llm import chat, hard_negatives, queries, whitening
from weftline.llm.common import read

VECTORS = "vec_id long, embedding array<double>, label int"
NAN, INF = float("nan"), float("inf")


def vectors_of(spark, rows):
    """With columns called as those used inside."""
    df = spark.createDataFrame(rows, VECTORS)
    for c in ("id", "v", "l", "r", "no", "n", "anchor", "row", "x", "copies", "_component", "score", "t", "pairs"):
        df = df.withColumn(c, F.lit("x"))
    return df


def hard_vectors(seed=0, n=240, dim=6):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(5, dim))
    rows = []
    for k in range(n):
        x = centres[k % 5] + 0.4 * rng.normal(size=dim)
        rows.append((k, [float(v) for v in x], int(rng.integers(4))))
    rows += [(300 + k, rows[10][1], k % 3) for k in range(12)]  # ties
    rows += [(3, rows[3][1], rows[3][2])] * 2  # repeated rows
    rows += [(400, None, 1), (401, rows[1][1], None), (None, rows[1][1], 1), (402, [1.0, None, 0.0, 0.0, 0.0, 0.0], 1), (403, [NAN] * dim, 1), (404, [INF] * dim, 2)]
    return [*rows, (500, [], 1), (510, [0.5, 0.25], 2), (520, [-0.0] * dim, 3)]


# hard negatives


def floors(v, dim, scale=256):
    return [math.floor(scale * x) for x in v] + [0] * (dim - len(v))


def brute_negatives(rows, step, positives=5, negatives=10):
    ok = {k: (v, label) for k, v, label in rows if k is not None and v is not None and label is not None and all(x is not None and math.isfinite(x) for x in v)}
    dim = max(len(v) for v, _ in ok.values())
    x = {k: floors(v, dim) for k, (v, _) in ok.items()}
    out = set()
    for a in ok:
        if a % step:
            continue
        ranked = sorted((-sum(p * q for p, q in zip(x[a], x[b])), b) for b in ok if b != a)
        for ps, p in [(-s, b) for s, b in ranked if ok[b][1] == ok[a][1]][:positives]:
            fit = [(-s, b) for s, b in ranked if ok[b][1] != ok[a][1] and 30 * ps <= -100 * s <= 90 * ps][:negatives]
            out |= {(a, p, r, b, ps, s) for r, (s, b) in enumerate(fit, 1)}
    return out


@pytest.mark.parametrize("sizes", [{}, {"tree_rows": 17, "query_rows": 3, "leaf": 4, "fan": 3}, {"tree_rows": 1, "query_rows": 1, "leaf": 1, "fan": 2}])
def test_hard_negatives(spark, sizes):
    rows = hard_vectors()
    got = hard_negatives.hard_negatives(vectors_of(spark, rows), F.col("vec_id") % 10 == 0, **sizes).collect()
    want = brute_negatives(rows, 10)
    assert len(got) == len(want) > 300 and {tuple(r) for r in got} == want


def test_hard_negatives_of_long_numbers(spark):
    rng = np.random.default_rng(4)
    rows = [(k, [float(v) for v in rng.integers(1, 2**20, 5)], int(k % 2)) for k in range(60)]  # products beyond 2^53
    got = hard_negatives.hard_negatives(vectors_of(spark, rows), F.col("vec_id") % 10 == 0, tree_rows=9, leaf=2, fan=2).collect()
    assert {tuple(r) for r in got} == brute_negatives(rows, 10)


def test_hard_negatives_of_few_rows(spark):
    ask = lambda rows: hard_negatives.hard_negatives(vectors_of(spark, rows), F.col("vec_id") % 10 == 0)
    assert ask([]).count() == 0
    assert ask([(10, None, 1)]).count() == 0
    assert ask([(10, [1.0], 1), (11, [1.0], 1)]).count() == 0
    assert [tuple(r) for r in ask([(10, [1.0], 1), (11, [1.0], 1), (12, [0.5], 2)]).collect()] == [(10, 11, 1, 12, 65536, 32768)]


def test_a_tree_bounds_its_rows_and_leaves_boxes_alone():
    rng = np.random.default_rng(1)
    x = np.floor(256 * rng.normal(size=(700, 3)))
    tree = hard_negatives.Tree.pack(np.arange(700), x, 8, 4)
    assert sorted(tree.ids.tolist()) == list(range(700)) and len(tree.low[-1]) == 1
    for level in range(len(tree.low)):
        step = 8 * 4**level
        for i, (a, b) in enumerate(zip(tree.low[level], tree.high[level], strict=True)):
            rows = tree.rows[i * step : (i + 1) * step]
            assert (rows.min(axis=0) == a).all() and (rows.max(axis=0) == b).all()
    seen = []

    class Counting(np.ndarray):
        def __getitem__(self, at):
            seen.append(at)
            return super().__getitem__(at)

    counted = tree._replace(rows=tree.rows.view(Counting))
    q = x[5]
    best = counted.search(q, [float("-inf")], [None], 3, 5)[0]
    score = x @ q
    assert best == [(int(score[k]), k) for k in sorted(set(range(700)) - {5}, key=lambda k: (-score[k], k))[:3]]
    assert len(seen) < len(tree.low[0]) / 4  # most leaves were never looked into


# whitening


def brute_whitening(rows, k=4):
    ok = [(key, v) for key, v, _ in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    dim = max(len(v) for _, v in ok)
    x = np.array([floors(v, dim) for _, v in ok])
    fit = np.unique(x, axis=0)
    n, sums, mean = len(fit), fit.sum(axis=0), fit.mean(axis=0)
    v = (fit - mean).T @ (fit - mean) / n
    e, w = np.linalg.eigh(v)
    e, w = e[::-1][:k], w[:, ::-1][:, :k]
    return [key for key, _ in ok], n, [int(sum(int(t) ** 2 for t in n * r - sums)) for r in x], (x - mean) @ w / np.sqrt(e), e / np.trace(v)


def check_whitening(spark, rows, **options):
    keys, n, deviation, z, share = brute_whitening(rows, **{"k": v for o, v in options.items() if o == "components"})
    got: dict = {}
    for r in whitening.whiten(vectors_of(spark, rows), **options).collect():
        assert r._n == n and r._identity_error <= 1e-8 and r.copies == "x"
        got.setdefault((r.vec_id, int(r._deviation)), []).append((r._component, r._whitened, r._explained))
    want: dict = {}
    for key, d, row in zip(keys, deviation, z, strict=True):
        want.setdefault((key, d), []).extend((c + 1, v, s) for c, (v, s) in enumerate(zip(row, share, strict=True)))
    assert got.keys() == want.keys()
    signs: dict = {}
    for at, mine in got.items():
        for (c, v, s), (c2, v2, s2) in zip(sorted(mine), sorted(want[at]), strict=True):
            assert c == c2 and abs(v) == pytest.approx(abs(v2), abs=1e-7) and s == pytest.approx(s2, rel=1e-9)
            if abs(v2) > 1e-3:
                signs.setdefault(c, set()).add(np.sign(v) * np.sign(v2))
    assert all(len(s) == 1 for s in signs.values())


def test_whitening(spark):
    check_whitening(spark, hard_vectors())
    check_whitening(spark, hard_vectors(3, n=90, dim=9)[:-3], components=9)


def test_whitening_of_given_rows(spark):
    folder = "/root/testdata/sf0.001"
    rows = [(r.vec_id, r.embedding, r.label) for r in read(spark, folder, "embeddings").collect()]
    check_whitening(spark, rows)
    got = queries.QUERIES["op12_whitening"](spark, folder)
    assert got.columns == ["vec_id", "component", "n", "whitened", "explained", "identity_error", "deviation"] and got.count() == 4 * len(rows)


def test_whitening_of_rows_without_variance(spark):
    made = lambda rows: whitening.whiten(vectors_of(spark, rows)).collect()
    assert made([]) == made([(1, None, 1)]) == made([(1, [], 1)]) == made([(1, [2.0, 3.0], 1)] * 5) == []
    line = made([(1, [1.0, 1.0], 1), (2, [2.0, 2.0], 1), (None, [2.0, 2.0], None)])  # one direction only
    assert sorted((str(r.vec_id), r._component, round(abs(r._whitened), 9), round(r._explained, 9)) for r in line) == [("1", 1, 1.0, 1.0), ("2", 1, 1.0, 1.0), ("None", 1, 1.0, 1.0)]


def test_equal_eigenvalues(spark):
    cube = [(k, [float(2 * (k >> j & 1)) for j in range(3)], 0) for k in range(8)]
    got = whitening.whiten(vectors_of(spark, cube), components=2).collect()
    assert len(got) == 16 and all(r._explained == pytest.approx(1 / 3) and r._identity_error < 1e-9 for r in got)


def test_whitening_of_long_numbers(spark):
    rows = [(1, [1e18, 3.0], 0), (2, [-1e18, 4.0], 0), (3, [5.0, 6.0], 0)]
    got = whitening.whiten(vectors_of(spark, rows), components=1).collect()
    x = [(min(max(math.floor(256 * v[0]), -(2**63)), 2**63 - 1), math.floor(256 * v[1])) for _, v, _ in rows]
    sums = [sum(c) for c in zip(*x)]
    want = [sum((3 * a - s) ** 2 for a, s in zip(r, sums)) for r in x]
    assert [r._deviation if r._deviation is None else int(r._deviation) for r in sorted(got, key=lambda r: r.vec_id)] == [w if w < 10**38 else None for w in want]


@pytest.mark.parametrize("spectrum", [[9, 8, 7, 6, 5, 1, 0.5], [5, 5, 5, 2, 1], [1, 1 - 1e-6, 1 - 2e-6, 1 - 3e-6, 1 - 4e-6, 0.1], [3, 0, 0, 0], list(range(1, 60))])
def test_contour_integration_finds_what_inertia_counts(spectrum):
    rng = np.random.default_rng(2)
    d = len(spectrum)
    turned, _ = np.linalg.qr(rng.normal(size=(d, d)))
    a = turned @ np.diag(np.array(spectrum, float)) @ turned.T
    a = (a + a.T) / 2
    diag, off = whitening.tridiagonal(a)
    for shift in rng.uniform(-1, 60, 20):
        assert whitening.count_above(diag, off, shift) == sum(e > shift for e in spectrum)
    for wanted in (1, 2, min(d, 20)):
        found = [whitening.feast(a, *cut) for cut in whitening.slices(a, wanted, width=3)]
        e = np.sort(np.concatenate([f[0] for f in found]))[::-1]
        w = np.concatenate([f[1] for f in found], axis=1)
        assert len(e) >= wanted and e == pytest.approx(sorted(spectrum, reverse=True)[: len(e)], abs=1e-10)
        assert np.abs(w.T @ w - np.eye(len(e))).max() < 1e-7


# chat


PARTS = ["\\", "#", "##", "###", "</turn>", "</turn", "\n", "\n</turn>\n", "### User: ", "### Assistant: ", "a", " ", "é", "\U0001f600", '"', ": ", "\\### ", ""]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.tuples(st.one_of(st.sampled_from(["user", "assistant", "system", "", "User", "a: b", "</turn>", '"###"']), st.text(max_size=4)), st.lists(st.one_of(st.sampled_from(PARTS), st.text(max_size=3)), max_size=8).map("".join)), max_size=4))
def test_formatted_turns_parse_to_what_they_were(turns):
    turns = [(role.encode(errors="ignore").decode(), text.encode(errors="ignore").decode()) for role, text in turns]
    pieces = [chat.render_turn(role, text) for role, text in turns]
    whole = "".join(p for p, _, _ in pieces)
    assert [(role, text) for role, text, _, _ in chat.parse_turns(whole)] == turns
    assert [chat.unescaped(p[a:b]) for p, a, b in pieces] == [text for _, text in turns]


@pytest.mark.parametrize("text", ["x", "### User: x", "### Nobody: x\n</turn>\n", "### User x\n</turn>\n", "### User: x</turn>\n", "### User: a ### b\n</turn>\n", "### User: x\n</turn>\n### "])
def test_what_the_grammar_does_not_know(text):
    with pytest.raises(ValueError):
        chat.parse_turns(text)


def test_texts_are_only_escaped_where_they_conflict():
    assert chat.render_turn("user", "a # b \\ c")[0] == "### User: a # b \\ c\n</turn>\n"
    assert chat.render_turn("user", "a ### b")[0] == "### User: a \\### b\n</turn>\n"


def conversations(spark, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    for c in ("conv", "part", "task", "whole", "loss", "formatted"):
        df = df.withColumn(c, F.lit("x"))
    return df


def hard_turns():
    rng = random.Random(7)
    rows = [(k, t, rng.choice(["user", "assistant", "system", "tool"]), "".join(rng.choice(PARTS) for _ in range(9))) for k in range(30) for t in range(rng.randrange(1, 6))]
    rows += [(99, t, "user" if t % 2 == 0 else "assistant", f"turn {t} ###") for t in range(400)]  # most of all rows
    rows += [(40, 0, None, None), (40, None, "assistant", "first"), (40, 1, "assistant", ""), (None, 0, "user", "no key"), (None, 1, "assistant", "nor here")]
    return rows + [(41, 0, "assistant", "twice")] * 2 + [(42, 0, "assistant", "long \\### " * 30_000)]


def brute_digests(rows):
    out, own = {}, {}
    for conv, turn, role, text in rows:
        own.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    for conv, turns in own.items():
        turns = sorted(turns, key=lambda t: (t[0], t[1], t[2].encode(), t[3].encode()))
        texts = [t[3] for t in turns if t[2] == "assistant"]
        out[conv] = (len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for _, _, r, t in turns).encode()).hexdigest(), sum(map(len, texts)), hashlib.sha256("".join(texts).encode()).hexdigest())
    return out


@pytest.mark.parametrize("part_chars", [1_000_000, 200])
def test_conversations(spark, part_chars):
    rows = hard_turns()
    formatted = chat.format_conversations(conversations(spark, rows).repartition(3), part_chars=part_chars)
    kept = formatted.collect()
    got = {r.conv_id: tuple(r)[1:5] for r in chat.conversation_digests(spark.createDataFrame(kept, formatted.schema)).collect()}
    assert got == brute_digests(rows)
    assert {k for k in got if sum(r.conv_id == k for r in kept) > 1} >= ({99} if part_chars == 200 else set())
    back = chat.read_conversations(spark.createDataFrame(kept, formatted.schema)).orderBy("task", "part", "turn").collect()
    assert [(r.role, r.text) for r in back if r.conv_id == 99] == [(r, t) for k, _, r, t in rows if k == 99]
    assert all(r.learned == (r.role == "assistant") for r in back) and len(back) == len(rows)


def test_no_conversations(spark):
    assert chat.conversation_digests(chat.format_conversations(conversations(spark, []))).count() == 0


# near-duplicate vectors over many lists


def test_near_duplicates_over_many_lists_are_all_found(spark):
    from weftline.llm import embeddings

    rng = np.random.default_rng(12)
    base = rng.normal(size=(500, 32))
    rows = []
    for k in range(2_500):
        x = base[k % 500] + 0.13 * rng.normal(size=32) * (k >= 500)
        rows.append((k, [float(v) for v in x], k % 500 % 3))
    x = np.array([r[1] for r in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    cosine, label = x @ x.T, np.array([r[2] for r in rows])
    near = (cosine >= 0.98) & (label[:, None] == label[None, :])
    want = near.sum(axis=1) - 1
    margin = np.abs(cosine - 0.98).min()
    df = spark.createDataFrame(rows, VECTORS)
    got = {r.vec_id: r._n_links for r in embeddings.near_duplicates(df, list_rows=60).collect()}  # 41 lists
    assert margin > 1e-9 and want.sum() > 1_000 and [got[k] for k in range(len(rows))] == want.tolist()
