"""The numbered queries and the pipeline on one set of the given tables."""

import sys
import zlib
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

sys.path[:0] = [str(Path(__file__).resolve().parent.parent), str(Path(__file__).resolve().parent)]
from oracle import DATA, compare  # noqa: E402

import corpus_pipeline  # noqa: E402
from weftline.llm import queries, tokens  # noqa: E402
from weftline.llm.common import read, saved  # noqa: E402


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_same_as_sql(spark, name):
    compare(spark, queries.QUERIES[name], queries.ORACLES[name])


def test_one_query_of_each_number():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))


def ids_of(spark, name, end):
    docs = read(spark, DATA, "documents").select("doc_id", "text").collect()
    tok = Tokenizer.from_file(tokens.tokenizer_path(name))
    return {r.doc_id: np.array([*tok.encode(r.text or "", add_special_tokens=False).ids, end], "<u4") for r in docs}


def test_packing(spark):
    want = ids_of(spark, "byte_bpe_50k.json", 0)
    rows = queries.QUERIES["op1_packing"](spark, DATA).collect()
    assert sum(r.length for r in rows) == sum(map(len, want.values()))
    for r in rows:
        assert r.doc_tokens == len(want[r.doc_id])
        assert r.ids_crc32 == zlib.crc32(want[r.doc_id][r.start : r.start + r.length].tobytes())


def test_token_files(spark):
    want, at = ids_of(spark, "word_bpe_49k.json", 1), 0
    rows = {r.doc_id: r for r in queries.QUERIES["op10_token_files"](spark, DATA).collect()}
    for k in sorted(want):
        assert (rows[k].start, rows[k].n_tokens, rows[k].ids_crc32) == (at, len(want[k]), zlib.crc32(want[k].tobytes()))
        at += len(want[k])


def test_models_on_held_out_rows(spark):
    folder = DATA.replace("sf0.001", "sf0.01")
    q = queries.QUERIES["op4_quality"](spark, folder).join(read(spark, folder, "labels"), "doc_id").where("held_out")
    assert q.where("quality = predicted").count() >= 0.95 * q.count()
    assert q.where("quality = 1 and predicted = 0").count() == 0
    lang = queries.QUERIES["op7_language_id"](spark, folder).join(read(spark, folder, "documents").select("doc_id", "lang"), "doc_id").where("held_out")
    assert lang.where("lang = lang_pred").count() >= 0.98 * lang.count()


def test_verdicts_without_a_rule(spark):
    rows = queries.QUERIES["op2_url_filter"](spark, DATA)
    assert rows.count() == read(spark, DATA, "pages").count()
    assert rows.where("rule = 'net/' and verdict <> 'block' or verdict not in ('allow', 'block')").count() == 0


def test_pipeline(spark):
    docs, kept = read(spark, DATA, "documents"), []
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, DATA)
        path = saved(docs)
        docs = path
        kept.append(docs)
    assert all(d.columns == read(spark, DATA, "documents").columns for d in kept[:-1])
    n = [d.count() for d in kept]
    assert 0 < n[1] <= n[0] and n[2] == n[1] and n[3] > 0 and n[4] > 0
    bad = read(spark, DATA, "labels").where("quality = 1").join(kept[0].select("doc_id"), "doc_id", "left_anti")
    assert bad.count() == 0
    assert kept[4].agg(F.countDistinct("doc_id")).first()[0] == kept[3].select("doc_id").distinct().count()


def test_pipeline_stages_by_brute_force(spark):
    """Each stage on all that the one before kept, against brute force; null keys and texts, empty and
    long texts, repeated rows and keys."""
    from test_llm_operators import brute_classes, brute_repeats, docs_of, hard_texts

    hard = hard_texts(1)
    docs = docs_of(spark, [*hard, hard[3], (None, None), (None, hard[5][1]), (None, hard[5][1])])
    scored = corpus_pipeline.quality(spark, docs, DATA)
    assert scored.columns == docs.columns and scored.where("doc_id is null").count() in (0, 1, 2, 3)
    from weftline.llm.quality import fit_quality, score_quality

    model = fit_quality(docs, read(spark, DATA, "labels"), F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0)
    good = sorted(str(r.doc_id) for r in score_quality(docs, model).where("_score >= 0.3").collect())
    assert sorted(str(r.doc_id) for r in scored.collect()) == good

    kept = corpus_pipeline.near_copies(spark, docs, DATA).collect()
    want = sorted(k for k, (_, c) in brute_classes(hard).items() if c == k)
    assert sorted(r.doc_id for r in kept if r.doc_id is not None) == want and sum(r.doc_id is None for r in kept) == 3

    some = [(r.doc_id, r.text) for r in kept]
    left = corpus_pipeline.repeated_passages(spark, docs_of(spark, some), DATA).collect()
    words = brute_repeats(some)
    assert len(left) == len(some)
    for r in left:
        if r.doc_id is not None:
            assert r.text == (None if r.doc_id not in words else words[r.doc_id][2]) and r.n_chars == (None if r.text is None else len(r.text))

    from weftline.llm.mixing import mix_sources

    before = docs_of(spark, [(r.doc_id, r.text) for r in left])
    copies = {(r.doc_id, r.text): r._copies for r in mix_sources(before).collect() if r.doc_id is not None}
    mix = corpus_pipeline.mixed_sources(spark, before, DATA)
    got: dict = {}
    for r in mix.collect():
        got[r.doc_id, r.text] = got.get((r.doc_id, r.text), 0) + 1
    assert {k: n for k, n in got.items() if k[0] is not None} == {k: n for k, n in copies.items() if n}

    plain = Tokenizer.from_file(tokens.tokenizer_path("byte_bpe_50k.json"))
    packed = corpus_pipeline.packed(spark, mix, DATA).collect()
    assert sum(r.length for r in packed) == sum(len(plain.encode(r.text or "", add_special_tokens=False).ids) + 1 for r in mix.collect())


def test_pipeline_of_an_empty_table(spark):
    docs = read(spark, DATA, "documents").where("doc_id < 0")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, DATA)
        assert out.count() == 0, name


def test_pipeline_keeps_columns_of_any_name(spark):
    """Columns called as those that the operators add come out of every stage as they went in."""
    from test_llm_operators import NAMES

    docs = read(spark, DATA, "documents").withColumns({c: F.lit(c) for c in [*NAMES, "column3"]})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, DATA)
        assert out.columns == docs.columns, name
        rows = out.limit(20).collect()
        assert rows and all(r[c] == c for r in rows for c in [*NAMES, "column3"]), name
    assert corpus_pipeline.packed(spark, docs, DATA).count() > 0


def test_pipeline_run_deletes_its_tables(spark):
    """Of all tables that a run saves only its result is left."""
    import pathlib

    from weftline.llm.common import shared_dir

    folder = pathlib.Path(shared_dir(spark).removeprefix("file:")).parent
    before = set(folder.iterdir()) if folder.exists() else set()
    out = corpus_pipeline.run(spark, DATA)
    assert out.count() > 0 and {str(p) for p in set(folder.iterdir()) - before} == {out.saved_at.removeprefix("file:")}
