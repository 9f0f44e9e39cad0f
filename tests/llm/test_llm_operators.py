"""The training-data operators against brute force, round trips and held-out rows, with nulls, empty and
long texts, ties, repeated rows, empty tables and clashing names."""

import hashlib
import math
import random
import pathlib
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from weftline.llm import common, components, embeddings, jaccard_join, language, mixing, packing, quality, substring_dedup, token_files, tokens, url_filter

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, texts, extra=False):
    rows = [(k, t, "en", f"s{(k or 0) % 3}" if (k or 0) % 7 else None, len(t or "")) for k, t in texts]
    df = spark.createDataFrame(rows, DOCS)
    if extra:  # names that clash with those used inside
        for c in ("doc", "th", "at", "n", "key", "a", "b", "start", "length", "ids", "size", "text2", "component", "node", "rep", "label2", "h", "score"):
            df = df.withColumn(c, F.lit("x"))
    return df


def hard_texts(seed=0):
    """Null keys and texts, empty and long texts, copies, near copies, shared passages."""
    rng = random.Random(seed)
    words = [f"{a}{b}" for a in "abcdefghij" for b in ("", "x", "Y.", "é,", "0", "!!", " q")]
    base = [" ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 3, 4, 5, 6, 19, 20, 21, 60, 150]))) for _ in range(24)]
    passage = " ".join(rng.choice(words) for _ in range(40))
    out = []
    for k in range(70):
        t = rng.choice(base)
        kind = rng.random()
        if kind < 0.3:
            w = t.split()
            for _ in range(rng.randint(1, 3)):
                if w:
                    w[rng.randrange(len(w))] = rng.choice(words)
            t = " ".join(w)
        elif kind < 0.5:
            t = t + "\n\n " + passage + " \t" + rng.choice(base)
        elif kind < 0.6:
            t = t.upper()
        out.append((k, t))
    out += [(70, None), (71, ""), (72, " \n\t "), (73, "same " * 3000), (74, "same " * 2999), (75, "日本語 のテキスト です 。 " * 8), (76, "<|endoftext|> x <|startoftext|>")]
    return out


@pytest.fixture(scope="module")
def hard(spark):
    return hard_texts()


# packing


def test_tokens_equal_the_library():
    rng = random.Random(2)
    texts = ["", None, " ", "a  b", "a   b", "x \n y", "a\n\n\nb", "\nx", "x\n", "x\n\n", "end.\n\nNext it's", "a\tb", "日本 é İ", "don't!'s", "<|endoftext|> x", "thnd*** a.. b!?", "<|startoftext|>a b<|endoftext|>", "a <|ENDOFTEXT|> b", "x<|endoftext|><|endoftext|>", "<| endoftext |>", "a" * 300 + " b"]
    texts.append("one more word of a text of over two million letters " * 45_000)
    texts += ["".join(rng.choice(" \n \t.*ab'sA0é!<|中ß") for _ in range(rng.randint(0, 16))) for _ in range(1500)]
    texts += [" ".join(rng.choice(["the", "The", "thnd***", "erinn,", "l'été", "x0y", "A.\nB"]) for _ in range(50)) for _ in range(50)]
    for name, kind in (("byte_bpe_50k.json", "byte"), ("word_bpe_49k.json", "word")):
        plain = Tokenizer.from_file(tokens.tokenizer_path(name))
        for limit in (600_000, 40):
            enc = tokens.Encoder(tokens.tokenizer_path(name), kind, limit)
            for at in range(0, len(texts), 100):
                some = texts[at : at + 100]
                want = [b"" if t is None else np.array(plain.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in some]
                assert enc.encode(some) == want


def test_tree_places_as_a_scan_does():
    rng = np.random.default_rng(0)
    for _ in range(30):
        sizes = rng.integers(1, 65, rng.integers(1, 80))
        room: list[int] = []
        want = np.zeros(len(sizes), int)
        for k in np.argsort(-sizes, kind="stable"):
            at = next((b for b, r in enumerate(room) if r >= sizes[k]), len(room))
            if at == len(room):
                room.append(64)
            room[at] -= sizes[k]
            want[k] = at
        assert (packing.first_fit_decreasing(sizes, 64) == want).all()
        pieces = packing.plan_group(sizes, 64)
        check_pieces([(i, s, n, b, o, int(sizes[i])) for i, s, n, b, o in pieces], {k: int(n) for k, n in enumerate(sizes)}, 64)


def check_pieces(rows, lengths, capacity):
    """Every id in one piece; sequences gapless, full or as long as a power of two."""
    by_doc, by_seq = {}, {}
    for doc, start, n, seq, offset, total in rows:
        assert n > 0 and total == lengths[doc]
        by_doc.setdefault(doc, []).append((start, n))
        by_seq.setdefault(seq, []).append((offset, n))
    for doc, n in lengths.items():
        at = 0
        for start, m in sorted(by_doc[doc]):
            assert start == at
            at += m
        assert at == n
    for parts in by_seq.values():
        at = 0
        for offset, m in sorted(parts):
            assert offset == at
            at += m
        assert at <= capacity and (at == capacity or at & (at - 1) == 0)


def test_packing(spark, hard):
    path = tokens.tokenizer_path("byte_bpe_50k.json")
    rows = packing.pack_documents(docs_of(spark, hard, extra=True), group_pieces=16).collect()
    plain = Tokenizer.from_file(path)
    ids = {k: np.array([*plain.encode(t or "", add_special_tokens=False).ids, 0], "<u4") for k, t in hard}
    check_pieces([(r.doc_id, r.start, r.length, r.sequence_id, r.offset, r.doc_tokens) for r in rows], {k: len(v) for k, v in ids.items()}, 1024)
    for r in rows:
        assert bytes(r.ids) == ids[r.doc_id][r.start : r.start + r.length].astype("<u4").tobytes()
    assert packing.pack_documents(docs_of(spark, [])).count() == 0
    twice = packing.pack_documents(docs_of(spark, [(None, "a b"), (None, "a b"), (1, "c"), (1, "c")])).collect()
    assert sum(r.length for r in twice) == 2 * 3 + 2 * 2


# token files


@pytest.mark.parametrize("kind", ["bit", "byte"])
def test_planes_round_trip(kind, tmp_path):
    rng = np.random.default_rng(1)
    for n in (0, 1, 7, 8, 1000):
        for top in (1, 2**16, 2**32):
            ids = rng.integers(0, top, n).astype("<u4")
            assert (token_files.from_planes(token_files.to_planes(ids, kind), n, kind) == ids).all()
    path = tmp_path / "x.planes"
    docs = [(k if k else None, rng.integers(0, 50_000, m).astype("<u4")) for k, m in enumerate([3, 64, 0, 200, 1, 63, 65, 500])]
    with path.open("wb") as out:
        to = token_files.PlaneWriter(out, kind, block_ids=64)
        for k, ids in docs:
            to.add(k, ids.tobytes())
        to.close()
    with path.open("rb") as f:
        index = token_files.read_index(f, path.stat().st_size)
        parts = [token_files.read_chunk(f, c, index["kind"]) for c in index["chunks"]]
    assert (np.concatenate([p[0] for p in parts]) == np.concatenate([i for _, i in docs])).all()
    assert [k for p in parts for k in p[1]] == [k for k, _ in docs]
    assert [n for p in parts for n in p[2].tolist()] == [len(i) for _, i in docs]
    path.write_bytes(path.read_bytes()[:-3])
    with path.open("rb") as f, pytest.raises(ValueError):
        token_files.read_index(f, path.stat().st_size)


def test_token_files(spark, hard, tmp_path):
    texts = [*hard, (None, "no key"), (3, "again")]
    folder = str(tmp_path / "a")
    token_files.write_token_files(docs_of(spark, texts, extra=True), folder, planes="bit", block_ids=100, files=3).collect()
    read = token_files.read_token_files(spark, folder)
    got = read.collect()
    files = len(list((tmp_path / "a").glob("*.planes")))
    assert files > 1 and read.where("length(ids) >= 0").select(F.spark_partition_id()).distinct().count() > 1
    plain = Tokenizer.from_file(tokens.tokenizer_path("word_bpe_49k.json"))
    want = sorted((-1 if k is None else k, np.array([*plain.encode(t or "", add_special_tokens=False).ids, 1], "<u4").tobytes()) for k, t in texts)
    assert sorted((-1 if r.doc_id is None else r.doc_id, bytes(r.ids)) for r in got) == want
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at and r.n_tokens == len(r.ids) // 4
        at += r.n_tokens
    keys = [-1 if r.doc_id is None else r.doc_id for r in sorted(got, key=lambda r: r.start)]
    assert keys == sorted(keys)
    token_files.write_token_files(docs_of(spark, []), str(tmp_path / "b")).collect()
    assert token_files.read_token_files(spark, str(tmp_path / "b")).count() == 0


# urls


def test_urls(spark):
    link = lambda kind, to: {"canonical": f'<link href="{to}" rel=canonical>', "refresh": f"<META http-equiv='refresh' content='0; url={to}'>", "og": f'<meta property="og:url" content="{to}">'}[kind]
    rows = [
        (1, "http://A.Net/x?y", ""), (2, "https://www.alias.org/p/", link("canonical", "http://bad.net/q")), (3, "http://alias.org/p#frag", None), (4, "http://chain.org/", link("refresh", "http://alias.org/p")),
        (5, "http://m.example.net/en/1", link("canonical", "http://bad.net/q2")), (6, "http://x.org/fr/1", ""), (7, "http://y.org/z", link("og", "http://x.org/fr/1")), (8, None, ""), (9, "no-scheme", link("canonical", "http://bad.net/q")),
        (10, "http://net", ""), (11, "http://free.org/", ""), (12, "http://y.org/z", link("canonical", "http://bad.net/other")), (12, "http://y.org/z", ""), (13, "http://example.com/de/?q", ""), (14, "http://xexample.com/de/", ""),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("a", F.lit(1)).withColumn("b", F.lit(2)).withColumn("component", F.lit(3))
    got = {r.page_id: (r._host, r._path, r._rule, r._verdict) for r in url_filter.judge_urls(pages, spellings=True).collect()}
    assert got[1] == ("a.net", "/x", "net/", "block")
    assert got[2][2:] == (None, "block") and got[3][2:] == (None, "block") and got[4][2:] == (None, "block")
    assert got[5][2:] == ("example.net/en/", "allow") and got[6][2:] == ("org/fr/", "allow")
    assert got[7][2:] == (None, "allow") and got[12][2:] == (None, "allow")  # an allowed alias goes before a blocked one
    assert got[8] == ("", "", None, "allow") and got[9] == ("", "", None, "allow")
    assert got[10] == ("net", "", None, "allow") and got[11][3] == "allow"
    assert got[13][2:] == ("example.com/de/", "block") and got[14][2:] == (None, "allow")
    plain = {r.page_id: r._verdict for r in url_filter.judge_urls(pages).collect()}  # no edge joins spellings
    assert (plain[2], plain[3], plain[4]) == ("block", "allow", "allow")
    assert url_filter.judge_urls(pages.where("page_id < 0")).count() == 0
    more = spark.createDataFrame([("http://free.org/", "http://bad.net/z"), (None, "x")], "a string, b string")
    assert {r.page_id: r._verdict for r in url_filter.judge_urls(pages, redirects=more).collect()}[11] == "block"


def test_relative_aliases(spark):
    from urllib.parse import urljoin

    targets = ["/de/x", "x.html", "?p=1", "//bad.net/x", "../up/y?z=/../q", "./", "..", "../../../a", "#f", "http://o.org/a", "a/./b/../c#d", "/a/../b"]
    bases = ["http://h.org/a/b/c.html?q=1#f", "https://h.org", "http://h.org/a/"]
    df = spark.createDataFrame([(b, t) for b in bases for t in targets], "base string, target string")
    for r in df.withColumn("got", url_filter.resolve_url(F.col("base"), F.col("target"))).collect():
        if (r.base, r.target) != ("https://h.org", "#f"):
            assert r.got.replace("h.org/?p", "h.org?p") == urljoin(r.base, r.target).replace("h.org/?p", "h.org?p"), r
    odd = spark.createDataFrame([("mailto:x@y",), ("javascript:void(0)",), ("",), (None,)], "target string")
    assert [r.got for r in odd.select(url_filter.resolve_url(F.lit("http://h.org/a"), F.col("target")).alias("got")).collect()] == [None] * 4
    rows = [
        (1, "http://example.com/p", '<link rel="canonical" href="/de/x">'), (2, "http://example.com/de", '<meta http-equiv=refresh content="0; url=de/y.html">'), (3, "https://free.org/", '<link rel=canonical href="//bad.net/x">'),
        (4, "http://a.org/1/2", '<base href="http://example.com/de/"><meta property="og:url" content="z">'), (5, "http://b.org/de/q", '<link rel=canonical href="?p=1">'), (6, "http://b.org/de/q?p=1", '<link rel=canonical href="//bad.net/q">'),
        (7, "http://c.org/x", '<link rel=canonical href="mailto:a@bad.net">'), (8, "http://d.org/", '<link rel=canonical href="/fr/1">'),
        (9, "http://d.org", '<link rel=canonical href="//bad.net/r">'), (10, "http://e.org/", '<link rel=canonical href="//bad.net/s">'),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r._verdict for r in url_filter.judge_urls(pages, spellings=True).collect()}
    assert got == {1: "block", 2: "block", 3: "block", 4: "block", 5: "block", 6: "block", 7: "allow", 8: "allow", 9: "allow", 10: "block"}


def test_components(spark):
    rng = random.Random(4)
    for n, m in ((30, 20), (200, 190), (50, 0)):
        edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)] + ([(k, k + 1) for k in range(300, 340)] if m else [])
        root = {x: x for e in edges for x in e}

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in edges:
            ra, rb = find(a), find(b)
            root[max(ra, rb)] = min(ra, rb)
        df = spark.createDataFrame([*edges, (None, 3), (5, None)], "a long, b long")
        got = {r.node: r.component for r in components.connected_components(df).collect()}
        assert got == {x: find(x) for e in edges for x in e}


@pytest.mark.parametrize("order", ["up", "down", "shuffled"])
def test_components_of_a_path(spark, monkeypatch, order):
    """A path of 1,000 nodes takes few rounds, whatever the order of its names."""
    names = list(range(1_000))
    if order == "shuffled":
        random.Random(1).shuffle(names)
    path = names if order != "down" else names[::-1]
    rounds = []
    monkeypatch.setattr(components, "saved", lambda df, f=components.saved: rounds.append(1) or f(df))
    got = components.connected_components(spark.createDataFrame(list(zip(path, path[1:], strict=False)), "a long, b long")).collect()
    assert len(got) == 1_000 and {r.component for r in got} == {0}
    assert len(rounds) < 40


# substring dedup


def brute_repeats(texts, window=20):
    seen, out = set(), {}
    for k, t in sorted((k, t) for k, t in texts if k is not None and t is not None):
        words = t.encode().split()
        gone = [False] * len(words)
        for s in range(len(words) - window + 1):
            g = tuple(words[s : s + window])
            if g in seen:
                gone[s : s + window] = [True] * window
            seen.add(g)
        out[k] = (len(words), sum(gone), b" ".join(w for w, x in zip(words, gone, strict=True) if not x).decode())
    return out


def test_substring_dedup(spark, hard):
    texts = [*hard, (None, "same " * 100), (None, "same " * 100)]
    got = substring_dedup.remove_repeats(docs_of(spark, texts, extra=True)).collect()
    want = brute_repeats(texts)
    assert len(got) == len(texts)
    for r in got:
        if r.doc_id is None:
            assert r._n_removed == 0 and r._n_words == 100
        elif r.text is None:
            assert (r._n_words, r._n_removed, r._kept) == (0, 0, "")
        else:
            assert (r._n_words, r._n_removed, r._kept) == want[r.doc_id]
    words = {k: (t or "").encode().split() for k, t in hard}
    for r in got:
        covered = set()
        for f in r._factors:
            assert f.n >= 20 and (f.src, f["from"]) < (r.doc_id, f.at)
            assert words[r.doc_id][f.at : f.at + f.n] == words[f.src][f["from"] : f["from"] + f.n]
            covered |= set(range(f.at, f.at + f.n))
        assert len(covered) == r._n_removed
    assert max(f.n for r in got for f in r._factors) > 32  # longer than a block
    assert substring_dedup.remove_repeats(docs_of(spark, [])).count() == 0
    long = " ".join(str(k % 97) for k in range(40))
    again = substring_dedup.remove_repeats(docs_of(spark, [(1, long), (1, long), (2, long), (2, "x " + long)])).collect()
    assert sorted((r.doc_id, r._n_removed) for r in again if not r.text.startswith("x")) == [(1, 0), (1, 0), (2, 40)]


def test_hot_anchors(spark):
    """A phrase in every text, with other words around it: its anchor is hot, and whichever anchors are
    taken for hot, the same words go."""
    rng = np.random.default_rng(8)
    words = lambda n: " ".join(f"w{k}" for k in rng.integers(0, 10**6, n))
    phrase, passage = words(14), words(30)
    texts = [(k, f"{words(15)} {phrase} {words(15)}" + (f" {passage}" if k % 9 == 0 else "")) for k in range(60)]
    docs = docs_of(spark, texts)
    judged = docs.select(F.col("doc_id").alias("doc"), F.hash("text").alias("th"), "text")
    hot = substring_dedup.hot_anchors(judged, len(texts))
    anchors = [substring_dedup.parse(common.word_hashes(t.encode().split()))[0] for _, t in texts]
    keys, n = np.unique(np.concatenate([np.unique(a) for a in anchors]), return_counts=True)
    assert len(hot) and hot.tolist() == keys[n > 10].tolist()
    assert substring_dedup.hot_anchors(judged.where("doc < 0"), 0).tolist() == []
    want = sorted((k, n, kept) for k, (_, n, kept) in brute_repeats(texts).items())
    assert sum(n for _, n, _ in want) == 6 * 30
    for chosen in (hot, keys, keys[:0]):
        spans = substring_dedup.repeated_spans(judged, hot=chosen).collect()
        gone = {r.doc: {p for s in r.spans for p in range(s.at, s.at + s.n)} for r in spans}
        assert {k: len(v) for k, v in gone.items()} == {k: n for k, n, _ in want if n}
    got = substring_dedup.remove_repeats(docs).collect()
    assert sorted((r.doc_id, r._n_removed, r._kept) for r in got) == want


def test_parse_covers_windows():
    rng = np.random.default_rng(3)
    for n in (0, 19, 20, 21, 33, 400):
        words = rng.integers(0, 5, n).astype(np.uint64)
        _, _, _, at, m = substring_dedup.parse(words)
        assert [p for a, k in zip(at, m, strict=True) for p in range(a, a + k)] == list(range(max(0, n - 19)))
    values = rng.integers(0, 9, 200).astype(np.uint64)
    for n in (1, 2, 5, 13):
        assert substring_dedup._smallest(values, n).tolist() == [k + int(np.argmin(values[k : k + n])) for k in range(200 - n + 1)]


# Jaccard join


def brute_classes(texts, percent=75):
    sets = {}
    for k, t in texts:
        w = (t or "").encode().lower().split()
        sets[k] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    root = {k: k for k in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                ra, rb = find(a), find(b)
                root[max(ra, rb)] = min(ra, rb)
    return {k: (len(sets[k]), find(k)) for k in keys}


@pytest.mark.parametrize("tile", [1, 2_048])
def test_jaccard_join(spark, hard, tile, monkeypatch):
    monkeypatch.setattr(jaccard_join.set_links, "__defaults__", (75, tile))
    got = jaccard_join.jaccard_classes(docs_of(spark, [*hard, (None, hard[0][1]), (None, None)], extra=True)).collect()
    assert len(got) == len(hard) + 2
    assert {r.doc_id: (r._size, r._component) for r in got if r.doc_id is not None} == brute_classes(hard)
    assert all(r._component is None for r in got if r.doc_id is None)


def test_jaccard_chains(spark):
    """A chain of neighbours that link while its ends don't."""
    words = [f"w{k}" for k in range(500)]
    texts = [(k, " ".join(words[2 * k : 2 * k + 60])) for k in range(40)] + [(100 + k, " ".join(words[300:360])) for k in range(10)]
    got = jaccard_join.jaccard_classes(docs_of(spark, texts)).collect()
    assert {r.doc_id: (r._size, r._component) for r in got} == brute_classes(texts)
    assert jaccard_join.jaccard_classes(docs_of(spark, [])).count() == 0


def test_jaccard_long_words(spark):
    """Words that differ only in places far from their start, or in the order of long stretches."""
    a, b = "a" * 256, "b" * 256
    texts = [(1, a + b), (2, b + a), (3, a + b), (4, " ".join([a + b + str(k) for k in range(30)])), (5, " ".join([b + a + str(k) for k in range(30)])), (6, "x" * 300 + "é"), (7, "X" * 300 + "é"), (8, "x" * 300 + "É")]
    got = {r.doc_id: r._component for r in jaccard_join.jaccard_classes(docs_of(spark, texts)).collect()}
    assert got == {1: 1, 2: 2, 3: 1, 4: 4, 5: 5, 6: 6, 7: 6, 8: 8}


def test_jaccard_repeated_keys(spark):
    """A key's texts are one document; a text without words links nothing."""
    x, y, z = (" ".join(f"{c}{k}" for k in range(30)) for c in "xyz")
    texts = [(1, x), (2, y), (3, x), (3, y), (4, z), (4, z), (5, z), (6, ""), (6, x + " q"), (7, ""), (8, " ")]
    got = {(r.doc_id, r.text): (r._size, r._component) for r in jaccard_join.jaccard_classes(docs_of(spark, texts)).collect()}
    assert {k: c for (k, _), (_, c) in got.items()} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 1, 7: 7, 8: 8}
    assert got[6, ""] == (0, 1) and got[6, x + " q"] == (27, 1)


def test_jaccard_large_group_without_links(spark):
    """5,000 documents that share a passage (more than half of each) and, in twos or more, all their other
    stretches, of which no two link; two chains of copies hide among them."""
    rng = random.Random(5)
    core = " ".join(f"c{k}" for k in range(60))
    stretches = [" ".join(f"s{j}x{k}" for k in range(12)) for j in range(2_000)]
    texts = [(k, " ".join([core, *rng.sample(stretches, 4)])) for k in range(5_000)]
    texts += [(6_000 + k, texts[7][1] + f" end{k}") for k in range(5)] + [(7_000 + k, texts[9][1] + f" end{k % 2}") for k in range(5)]
    got = {r.doc_id: r._component for r in jaccard_join.jaccard_classes(docs_of(spark, texts)).collect()}
    want = {k: k for k in range(5_000)} | {6_000 + k: 7 for k in range(5)} | {7_000 + k: 9 for k in range(5)}
    assert got == want


def test_segments_find_every_pair():
    """Sets at the very limit meet in a key that the smaller one indexes, whatever differs and whichever
    segments cost least."""
    rng = np.random.default_rng(6)
    scheme = jaccard_join.Scheme(75)
    for s in [*range(1, 60), 100, 333, 1000]:
        for _ in range(6):
            l_ = int(rng.integers(s, s * 4 // 3 + 1))
            most = 25 * (s + l_) // 175
            most -= (most - (l_ - s)) % 2  # what sets of these sizes can differ in
            if most < l_ - s:
                continue
            extra = (most - (l_ - s)) // 2
            pool = rng.integers(0, 2**63, s + most + 9).astype(np.uint64)
            a = np.unique(pool[:s])
            b = np.unique(np.concatenate([pool[: s - extra], pool[s : s + l_ - s + extra]]))
            both = np.intersect1d(a, b)
            if 100 * len(both) < 75 * (len(a) + len(b) - len(both)):
                continue
            odd = (np.array(jaccard_join.parities(a)) ^ np.array(jaccard_join.parities(b))).tolist()
            assert sum((o & (2**64 - 1)).bit_count() for o in odd) <= len(a) + len(b) - 2 * len(both)
            # of what only one of them has, some is in no other text
            for share in (0, 0.5, 1):
                x, y = (np.unique(np.concatenate([both, (own := np.setdiff1d(c, both))[rng.random(len(own)) >= share]])) for c in (a, b))
                assert jaccard_join.may_link(len(a), len(b), len(x), len(y), 75)
                counts = rng.choice([2.0, 3.0, 1e5], len(x)), rng.choice([2.0, 1e6], len(y))
                keys, roles = scheme.keys(len(a), x, counts[0])
                asked, roles_b = scheme.keys(len(b), y, counts[1])
                assert len(np.intersect1d(keys[roles != jaccard_join.ASKS], asked[roles_b != jaccard_join.INDEXES]))


# mixing


def dealt_targets(sizes, weights=(3, 1, 2), share=1.5, most=2.0):
    """By dealing out again and again."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    w = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    target, open_, left = {}, set(names), share * sum(sizes.values())
    while open_:
        level = left / sum(w[s] for s in open_)
        over = {s for s in open_ if w[s] * level > most * sizes[s]}
        if not over:
            return target | {s: w[s] * level for s in open_}
        for s in over:
            target[s] = most * sizes[s]
            left -= target[s]
        open_ -= over
    return target


def test_targets(spark):
    rng = random.Random(8)
    for _ in range(4):
        sizes = {f"s{k}": rng.choice([1, 5, 100, 3000]) for k in range(9)} | {None: 50}
        df = spark.createDataFrame([(s, n, 1) for s, n in sizes.items()], "source string, source_size long, source_docs long")
        got = {r.source: r.target for r in mixing.source_targets(df).collect()}
        assert got == pytest.approx(dealt_targets(sizes))


def test_mixing(spark, hard):
    texts = [*hard, (None, "a b c"), (None, None), (5, "again and again")]
    df = docs_of(spark, texts, extra=True)
    rows = mixing.mix_sources(df).collect()
    assert len(rows) == len(texts)
    sizes: dict = {}
    for r in rows:
        assert r._size == len((r.text or "").encode().split()) and 0 <= r._copies <= 2
        sizes[r.source] = sizes.get(r.source, 0) + r._size
    targets = dealt_targets(sizes)
    longest = max(r._size for r in rows)
    for s, n in sizes.items():
        mine = [r for r in rows if r.source == s]
        assert mine[0]._source_size == n and mine[0]._target == pytest.approx(targets[s])
        assert abs(sum(r._copies * r._size for r in mine) - targets[s]) <= longest
    assert sorted((str(r.doc_id), r._copies) for r in rows) == sorted((str(r.doc_id), r._copies) for r in mixing.mix_sources(df).collect())
    spread = mixing.mix_sources(df, buckets=3).groupBy("source", "_target").agg(F.sum(F.col("_copies") * F.col("_size")).alias("taken"), F.max("_copies").alias("most")).collect()
    assert all(r.most <= 2 and abs(r.taken - r._target) <= longest for r in spread)
    mixed = mixing.mixed_documents(df)
    assert mixed.columns == df.columns and mixed.count() == sum(r._copies for r in rows)
    assert mixing.mix_sources(docs_of(spark, [])).count() == 0
    assert mixing.mix_sources(docs_of(spark, [(1, None), (2, "")])).where("_copies <> 0").count() == 0


def drawn_in_order(rows, buckets, share=1.5):
    """Copies by (source, key) from one sorted list for each source; ``rows`` are (key, text, source)."""
    h32 = lambda t: int(hashlib.md5(t.encode()).hexdigest()[:8], 16)
    own: dict = {}
    for key, text, source in rows:
        size = len((text or "").split())
        h = h32(f"0|{key if key is not None else hashlib.md5((text or '').encode()).hexdigest()}")
        digits = max(1, size.bit_length())
        own.setdefault(source, []).append((digits * 32 + ((size << 5) >> (digits - 1)), h % buckets, size, h, str(key) if key is not None else ""))
    targets = dealt_targets({s: sum(r[2] for r in mine) for s, mine in own.items()}, share=share)
    out: dict = {}
    for s, mine in own.items():
        rate, offset = targets[s] / max(1, sum(r[2] for r in mine)), h32(f"0:0|{s or ''}") / 2**32
        for place, r in enumerate(sorted(mine), 1):
            n = min(2, math.floor(place * rate + offset) - math.floor((place - 1) * rate + offset))
            out[s, r[4], r[2]] = out.get((s, r[4], r[2]), 0) + n
    return out


@pytest.mark.parametrize("buckets", [1, 3, 256])
def test_mixing_draws_by_the_order_of_its_buckets(spark, buckets):
    rng = random.Random(11)
    rows = [(k, " ".join(["w"] * rng.choice([0, 1, 7, 40, 41, 300])), f"s{k % 3}" if k % 10 else None) for k in range(300)]
    rows += [(7, "the same row again", "s1")] * 90 + [(None, "no key at all", "s2")] * 90  # groups of a fifth of all rows each
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    got: dict = {}
    for r in mixing.mix_sources(df, buckets=buckets).collect():
        at = (r.source, "" if r.doc_id is None else str(r.doc_id), r._size)
        got[at] = got.get(at, 0) + r._copies
    assert got == drawn_in_order(rows, buckets)


# models


def test_quality(spark):
    rng = random.Random(9)
    good = lambda: " ".join(rng.choice(["the", "house", "of", "rain", "walks", "home."]) for _ in range(30))
    bad = lambda: " ".join(rng.choice(["the***", "HOUSE!!", "of$$$", "rain###"]) for _ in range(30))
    texts = [(k, good() if k % 3 else bad()) for k in range(200)] + [(200, None), (201, ""), (202, "same " * 5000), (None, good())]
    docs = docs_of(spark, texts, extra=True)
    labels = spark.createDataFrame([(k, int(k % 3 > 0), 0) for k in range(150)] + [(None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    held = common.crc_text("doc_id") % 5 == 0
    model = quality.fit_quality(docs, labels, ~held, bits=14)
    rows = quality.score_quality(docs, model).collect()
    assert len(rows) == len(texts) and all(0 <= r._score <= 1 and r._predicted == int(r._score >= 0.3) for r in rows)
    assert all(r._predicted == int(r.doc_id % 3 > 0) for r in rows if r.doc_id is not None and r.doc_id < 200)
    again = quality.fit_quality(docs, labels, ~held, bits=14)
    assert (again.weights == model.weights).all() and again.slope == model.slope
    none = quality.fit_quality(docs, labels.where("doc_id < 0"), ~held, bits=10)
    assert {r._score for r in quality.score_quality(docs, none).collect()} == {0.5}
    one = quality.fit_quality(docs, labels.where("quality = 1"), ~held, bits=10)
    assert all(r._predicted == 1 for r in quality.score_quality(docs, one).collect())
    assert quality.score_quality(docs.limit(0), model).count() == 0


def test_hinge_reaches_the_optimum():
    rng = np.random.default_rng(0)
    rows = [np.unique(rng.integers(0, 30, 6)) for _ in range(60)]
    y = np.where([3 in r or 7 in r for r in rows], 1, -1)
    ratios = rng.normal(size=30)
    w, bias = quality.fit_hinge(rows, y, ratios, epochs=400)

    def loss(w, b):
        m = np.array([w[r] @ (ratios[r] / np.sqrt(len(r))) for r in rows]) + b
        share = np.where(y > 0, (y > 0).mean(), (y < 0).mean())
        return 0.5 * (w @ w + b * b) + (0.5 / share * np.maximum(0, 1 - y * m)).sum()

    best = loss(w, bias)
    assert all(loss(w + d, bias + e) >= best - 1e-2 for d, e in ((rng.normal(size=30) * s, rng.normal() * s) for s in (0.001, 0.01, 0.1, 1.0) for _ in range(50)))


def test_language(spark):
    rng = random.Random(10)
    kinds = {"aa": ["the", "thing", "with", "other"], "bb": ["für", "über", "straße", "möchte"], "cc": ["été", "garçon", "déjà", "où"]}
    texts = [(k, " ".join(rng.choice(kinds[lang]) for _ in range(25)), lang) for k, lang in enumerate(rng.choice(list(kinds)) for _ in range(120))]
    texts += [(200, None, "aa"), (201, "123 --- \n", "aa"), (202, "the " * 6000, None), (None, "über", "bb")]
    docs = spark.createDataFrame(texts, "doc_id long, text string, lang string").withColumn("l", F.lit(1)).withColumn("t", F.lit(2))
    held = F.coalesce(common.crc_text("doc_id") % 4 == 2, F.lit(False))
    profiles = language.fit_languages(docs, ~held)
    rows = {r.doc_id: (r._lang, r._cosine) for r in language.identify_language(docs, profiles).collect()}
    assert all(rows[k][0] == lang for k, _, lang in texts[:120])
    assert rows[200] == ("und", 0.0) and rows[201] == ("und", 0.0) and rows[202][0] == "aa" and rows[None][0] == "bb"
    assert all(0 <= c <= 1 for _, c in rows.values())
    empty = language.fit_languages(docs.where("doc_id < 0"), ~held)
    assert {r._lang for r in language.identify_language(docs, empty).collect()} == {"und"}
    space = language.Space(dim=256)
    one = space.letter(ord("a")), space.letter(ord("b")), space.letter(ord(" "))
    want = np.roll(one[2], 2) * np.roll(one[0], 1) * one[1] + np.roll(one[0], 2) * np.roll(one[1], 1) * one[2]
    assert np.allclose(space.bundle(["Ab!"])[0], want / np.sqrt((want.astype(float) ** 2).sum()))


def grams_of(text):
    """The n-grams of the quality classifier, one by one."""
    import re
    import xxhash

    mask, u64 = 2**64 - 1, lambda x: x & (2**64 - 1)

    def mix(x):
        x ^= x >> 32
        x = x * 0x9E3779B97F4A7C15 & mask
        return x ^ x >> 29

    join = lambda a, b, seed: mix(u64(a * (0xD6E8FEB86659FD93 + 2 * seed) + mix(u64(b + 0x2545F4914F6CDD1D + seed))))
    kind = lambda b: "A" if 65 <= b <= 90 else "a" if 97 <= b <= 122 or b >= 128 else "0" if 48 <= b <= 57 else chr(b)
    words = text.encode().split()
    w = [xxhash.xxh32_intdigest(x.lower()) for x in words]
    s = [xxhash.xxh32_intdigest(re.sub(r"(.)\1+", r"\1", "".join(map(kind, x)), flags=re.S).encode("latin-1")) for x in words]
    two = [join(a, b, 2) for a, b in zip(s, s[1:], strict=False)]
    return {*map(mix, w), *(join(a, b, 1) for a, b in zip(w, w[1:], strict=False)), *(mix(x + (1 << 40)) for x in s), *two, *(join(a, b, 3) for a, b in zip(two, s[2:], strict=False))}


def test_quality_by_brute_force(spark, hard):
    """Counts, ratios, weights and scores again from each text alone; ties at the threshold are label 1."""
    bits = 10
    docs = docs_of(spark, [*hard, (3, hard[3][1]), (None, "x y")])
    labels = {k: k % 2 for k, _ in hard if k % 5}
    table = spark.createDataFrame([*labels.items()], "doc_id long, quality int")
    model = quality.fit_quality(docs, table, F.col("doc_id") % 7 != 0, bits=bits)
    found = {k: {g >> 64 - bits for g in grams_of(t or "")} for k, t in hard}
    train = [(k, y) for k, y in labels.items() if k % 7]
    train += [(3, labels[3])]
    counts = np.zeros((2, 1 << bits))
    for k, y in train:
        counts[y, list(found[k])] += 1
    share = [(c + 1) / (c + 1).sum() for c in counts]
    ratios = np.log(share[1] / share[0])
    assert np.allclose(quality.log_ratios(counts), ratios)
    assert not model.weights[ratios == 0].any() and model.weights.any()
    rows = quality.score_quality(docs, model).collect()
    for r in rows:
        if r.doc_id is not None:
            own = sorted(found[r.doc_id])
            margin = model.bias + (model.weights[own].sum() / len(own) ** 0.5 if own else 0)
            assert r._score == pytest.approx(1 / (1 + np.exp(-model.slope * margin - model.shift)))
    assert len({r._score for r in rows if r.doc_id == 3}) == 1
    tie = quality.Model(bits, np.zeros(1 << bits), 0.0, 1.0, float(np.log(0.3 / 0.7)))
    score = quality.score_quality(docs, tie, threshold=float(tie.scores([b""])[0])).select("_predicted").distinct().collect()
    assert [r._predicted for r in score] == [1]


def test_language_by_brute_force(spark, hard):
    """Vectors, prototypes and predictions again, letter by letter; of equal languages the first by name."""
    space = language.Space(dim=64)
    texts = [(k, t, "bcda"[k % 4] if k % 9 else None) for k, t in hard if k != 74] + [(5, hard[5][1], "b"), (80, "x" * 70_000, None)]
    docs = spark.createDataFrame(texts, "doc_id long, text string, lang string")
    profiles = language.fit_languages(docs, F.col("doc_id") % 3 != 0, space=space)

    def vector(text):
        letters = "".join(c if c.isalpha() else " " for c in text or "")
        if not letters.strip():
            return None
        line = " " + " ".join(letters.split()) + " "
        line = [ord(c.lower()) if len(c.lower()) == 1 else ord(c) for c in line]
        known = {p: space.letter(p).astype(int) for p in set(line)}
        grams = {}
        for g in zip(line, line[1:], line[2:], strict=False):
            grams[g] = grams.get(g, 0) + 1
        total = sum(n * np.roll(known[a], 2) * np.roll(known[b], 1) * known[c] for (a, b, c), n in grams.items())
        return total / np.sqrt((total**2.0).sum())

    sums = {}
    for k, t, lang in texts:
        if k % 3 and lang and (v := vector(t)) is not None:
            sums[lang] = sums.get(lang, 0) + v
    want = {lang: v / np.sqrt((v**2).sum()) for lang, v in sums.items()}
    assert profiles.names == sorted(want) and np.allclose(profiles.vectors, [want[x] for x in profiles.names], atol=1e-4)
    for r in language.identify_language(docs, profiles).collect():
        v = vector(r.text)
        if v is None:
            assert (r._lang, r._cosine) == ("und", 0.0)
            continue
        near = {x: float(v @ w) for x, w in want.items()}
        assert r._cosine == pytest.approx(max(0, *near.values()), abs=1e-4) and near[r._lang] == pytest.approx(max(near.values()), abs=1e-4)
    tied = language.Profiles(space, ["aa", "bb"], np.stack([want["b"], want["b"]]))
    assert {r._lang for r in language.identify_language(docs, tied).collect()} == {"aa", "und"}


# vectors


def vectors_of(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("rep", F.lit(1)).withColumn("n", F.lit(1)).withColumn("id", F.lit(7)).withColumn("list", F.lit(7))


def hard_vectors():
    rng = np.random.default_rng(11)
    base = rng.normal(size=(30, 8))
    rows = [(k, (base[k % 30] + rng.normal(size=8) * 0.07 * (k % 4)).tolist(), int(k % 3) if k % 17 else None) for k in range(240)]
    rows += [(300 + k, base[0].tolist(), 0) for k in range(25)]
    rows += [(400, None, 0), (401, [], 0), (402, [0.0] * 8, 0), (403, [1.0, None] + [0.0] * 6, 0), (404, [float("nan")] * 8, 1), (405, [float("inf")] * 8, 1), (406, base[1].tolist(), None), (450, [1e30] * 8, 2), (500, [2e30] * 8, 2)]
    return rows


def test_near_duplicate_vectors(spark):
    rows = hard_vectors()
    good = {}
    for k, v, label in rows:
        x = np.array([np.nan if c is None else np.float32(c) for c in v or []], float)
        if label is not None and len(x) and np.isfinite(x).all() and x.any():
            x = x / np.abs(x).max()
            good[k] = (label, x / np.sqrt(x @ x))
    links = {k: {j for j, (l2, y) in good.items() if j != k and l2 == label and x @ y >= 0.98} for k, (label, x) in good.items()}
    for options in ({}, {"list_rows": 8, "block": 16}):
        got = {r.vec_id: (r._n_links, r._component) for r in embeddings.near_duplicates(vectors_of(spark, rows), **options).collect()}
        assert len(got) == len(rows)
        for k, _, _ in rows:
            seen, front = {k}, [k]
            while front:
                front = [j for x in front for j in links.get(x, ()) if j not in seen and not seen.add(j)]
            assert got[k] == (len(links.get(k, ())), min(seen)), k
    assert embeddings.near_duplicates(vectors_of(spark, [])).count() == 0
    assert {r._n_links for r in embeddings.near_duplicates(vectors_of(spark, [(1, None, 1), (2, [0.0], 1)])).collect()} == {0}


def test_top_k_sends_no_matrix(spark):
    """Blocks and shards are fetched by the tasks, however small the planner takes them to be; vectors whose products ask for doubles or more are as exact as short ones."""
    rows = [(k, [float((k * j) % 7) - 3 for j in range(1, 5)], 0) for k in range(60)]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1g")
    try:
        out = embeddings.top_k(vectors_of(spark, rows), F.col("vec_id") % 10 == 0, shard_rows=16, query_rows=2)
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" in plan and "Broadcast" not in plan
        for by in (1.0, 1e3, 1e9):  # as two bytes, four bytes and doubles
            some = vectors_of(spark, [(k, [x * by for x in v], c) for k, v, c in rows])
            got = [(r.query_id, r["rank"], r.vec_id, r.score) for r in embeddings.top_k(some, F.col("vec_id") % 10 == 0, shard_rows=16, query_rows=2).collect()]
            whole = {k: [int(256 * x * by) for x in v] for k, v, _ in rows}
            want = []
            for q in range(0, 60, 10):
                score = lambda k: max(-(2**63) + 1, min(2**63 - 1, sum(a * b for a, b in zip(whole[q], whole[k], strict=True))))  # noqa: B023, E731
                best = sorted((-score(k), k) for k in whole if k != q)[:5]
                want += [(q, n, k, -s) for n, (s, k) in enumerate(best, 1)]
            assert sorted(got) == want
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_top_k(spark):
    rows = [*hard_vectors(), (350, [0.5] * 8, 1), (None, [1.0] * 8, 1)]
    good = {}
    for k, v, _ in rows:
        if k is not None and v is not None and all(c is not None and np.isfinite(c) for c in v):
            good[k] = [int(np.floor(256 * float(np.float32(c)))) for c in v]
    clip = lambda s: max(-(2**63) + 1, min(2**63 - 1, s))
    want = set()
    for q in (k for k in good if k % 50 == 0):
        scored = sorted((-clip(sum(a * b for a, b in zip(good[q], v, strict=False))), k) for k, v in good.items() if k != q)
        want |= {(q, n, k, -s) for n, (s, k) in enumerate(scored[:5], 1)}
    for options in ({}, {"shard_rows": 20, "query_rows": 2, "fan_in": 3}):
        got = embeddings.top_k(vectors_of(spark, rows), F.col("vec_id") % 50 == 0, **options)
        assert {(r.query_id, r.rank, r.vec_id, r.score) for r in got.collect()} == want
    few = embeddings.top_k(vectors_of(spark, rows[:3]), F.col("vec_id") % 50 == 0).collect()
    assert sorted(r.rank for r in few) == [1, 2]
    assert embeddings.top_k(vectors_of(spark, []), F.col("vec_id") % 50 == 0).count() == 0


NAMES = """row doc th at n key a b start length ids size text2 component node rep label2 h score cut url_ host path rule own part said u v l i j bucket class rank before rate s source_
    class_ target source_size source_docs copies buckets id shared elements codes odd role tile tiles asks held counts lo hi z doc_ th_ k t _doc _th _at _n _size _doc2 _part _key _source
    _class _h _s _u _target _said _c _l2 _n_links _own _node _v1 _h1 _r _i _p _k _y _t _g _component _copies _source_size _kept _n_words _n_removed _host _path _rule _verdict _score
    _predicted _lang _cosine""".split()


@pytest.fixture(scope="module")
def clashing(spark):
    """Twelve documents with extra columns called as those inside; each holds its own name."""
    text = " ".join(f"word{k} is" for k in range(30))
    df = docs_of(spark, [(k, text if k < 3 else f"{text} {k}" if k < 6 else f"alone {k} " * 9) for k in range(12)])
    return df.withColumns({c: F.lit(c) for c in NAMES})


@pytest.mark.parametrize(
    ("run", "added"),
    [
        (jaccard_join.jaccard_classes, ["_size", "_component"]),
        (substring_dedup.remove_repeats, ["_kept", "_n_words", "_n_removed", "_factors"]),
        (mixing.mix_sources, ["_size", "_source_size", "_target", "_copies"]),
        (mixing.mixed_documents, []),
        (lambda d: url_filter.judge_urls(d.withColumns({"url": F.concat(F.lit("http://a.net/"), "doc_id"), "html": F.lit("<link rel=canonical href=/x>")})), ["_host", "_path", "_rule", "_verdict"]),
        (lambda d: embeddings.near_duplicates(d.withColumns({"vec_id": F.col("doc_id"), "embedding": F.array(F.lit(1.0), F.col("doc_id") + 0.5), "label": F.lit(1)})), ["_n_links", "_component"]),
        (lambda d: quality.score_quality(d, quality.fit_quality(d, d.select("doc_id", (F.col("doc_id") % 2).alias("quality")), F.col("doc_id") > 1, bits=10)), ["_score", "_predicted"]),
        (lambda d: language.identify_language(d, language.fit_languages(d, F.col("doc_id") > 1)), ["_lang", "_cosine"]),
    ],
)
def test_clashing_names(clashing, run, added):
    rows = run(clashing).collect()
    assert rows and len({r.doc_id for r in rows}) >= 6
    for r in rows:
        assert len(set(r.__fields__)) == len(r.__fields__)
        assert all(r[c] == c for c in NAMES if c not in added)
        assert all(r[c] != c for c in added)


@pytest.mark.parametrize("run", [packing.pack_documents, lambda d: embeddings.top_k(d.withColumns({"vec_id": F.col("doc_id"), "embedding": F.array(F.lit(1.0), F.col("doc_id") + 0.5)}), F.col("vec_id") % 2 == 0)])
def test_clashing_names_of_other_rows(clashing, run):
    assert run(clashing).count() >= 6


def test_crc(spark):
    assert spark.range(3).select(common.crc_text("id").alias("c")).collect()[2].c == zlib.crc32(b"2")


def test_settled(spark):
    """The result stays, tables on the way go."""
    inner = []

    def make():
        inner.append(common.saved(spark.range(9)))
        return inner[0].where("id > 3")

    exists = lambda t: pathlib.Path(t.saved_at.removeprefix("file:")).exists()
    out = common.settled(make)
    assert out.count() == 5 and exists(out) and not exists(inner[0])
    common.dropped(out)
    assert not exists(out)


def test_copies_of_a_page_are_packed_in_many_groups(spark):
    text = " ".join(f"word{k}" for k in range(900))
    df = spark.createDataFrame([(k, text) for k in range(300)], "doc_id long, text string").repartition(4)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = packing.pack_documents(df).where("length = 1024").collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    sizes = list(Counter(r.sequence_id >> 40 for r in rows).values())
    assert len(sizes) == 4 and max(sizes) < 2 * min(sizes)


def test_a_phrase_in_every_text_is_no_bucket_of_its_own(spark, monkeypatch):
    rng = random.Random(3)
    phrase = "this very common phrase stands in each and every text there is"
    texts = [(k, f"{phrase} " + " ".join(f"w{rng.randrange(10**6)}" for _ in range(rng.choice([0, 3, 30])))) for k in range(200)]
    texts += [(200 + k, f"{t} end") for k, t in texts[:40] if len(t.split()) > 30] + [(400 + k, texts[0][1]) for k in range(5)]
    frequent = jaccard_join.frequent_elements(docs_of(spark, texts).select(F.xxhash64("text").alias("th"), "text"), 5, len(texts))
    assert len(frequent[0]) >= 8 and (frequent[1] >= 8).all()
    want = brute_classes(texts)
    for share in (1e-3, 0.2, 2.0):  # many, some and no elements are taken for frequent
        plain = jaccard_join.frequent_elements
        monkeypatch.setattr(jaccard_join, "frequent_elements", lambda t, n, total, share=share: plain(t, n, total, share=share) if share < 1 else (np.empty(0, np.uint64), np.empty(0, np.uint8)))
        got = {r.doc_id: (r._size, r._component) for r in jaccard_join.jaccard_classes(docs_of(spark, texts).select("doc_id", "text").repartition(3)).collect()}
        monkeypatch.setattr(jaccard_join, "frequent_elements", plain)
        assert got == want


def test_texts_with_one_hash_are_two_texts(spark, monkeypatch):
    class Few:
        """Functions whose first hash of a text has two values only."""

        def __getattr__(self, name):
            return getattr(F, name)

        def xxhash64(self, *columns):
            return F.pmod(F.xxhash64(*columns), F.lit(2)) if len(columns) == 1 else F.xxhash64(*columns)

    texts = [(k, f"word{k} " * 9) for k in range(8)] + [(20, "word3 " * 9), (30, None), (40, "")]
    monkeypatch.setattr(jaccard_join, "F", Few())
    got = {r.doc_id: (r._size, r._component) for r in jaccard_join.jaccard_classes(docs_of(spark, texts).select("doc_id", "text")).collect()}
    assert got == brute_classes(texts)


def test_planted_links_between_the_given_pages(spark):
    """Canonical links, refreshes and addresses, absolute and relative, and redirects, planted in the given pages; verdicts
    against components by union-find over urls resolved by the standard library."""
    from urllib.parse import urljoin

    rng = random.Random(6)
    pages = [(r.page_id, r.url, r.html or "") for r in common.read(spark, "/root/testdata/sf0.01", "pages").select("page_id", "url", "html").collect()]
    urls = [u for _, u, _ in pages if u and "://" in u]
    rows, links = [], []
    for k, url, html in pages:
        if url and "://" in url and rng.random() < 0.7:
            to = rng.choice([rng.choice(urls), rng.choice(urls[:5]), "/fr/moved", "//sub.example.com/de/x", "next.html", "http://quiet.example/"])
            html += rng.choice(['<link rel="canonical" href="%s">', '<meta http-equiv="refresh" content="5; URL=%s">', '<meta property="og:url" content="%s">']) % to.replace("&", "&amp;")
            links.append((url, urljoin(url, to)))
        rows.append((k, url, html))
    redirects = [(rng.choice(urls), rng.choice(urls)) for _ in range(20)]
    root: dict = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links + redirects:
        root[find(a)] = find(b)
    rule = lambda u: url_rule(u)
    said: dict = {}
    for u in list(root):
        if rule(u):
            said.setdefault(find(u), set()).add(rule(u))
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r._verdict for r in url_filter.judge_urls(df, redirects=spark.createDataFrame(redirects, "a string, b string")).collect()}
    for k, url, _ in rows:
        kinds = said.get(find(url), set()) if url else set()
        want = (rule(url) if url else None) or ("allow" if "allow" in kinds or not kinds else "block")
        assert got[k] == want, (k, url)
    assert sum(v == "block" for v in got.values()) > 5 and sum(not rule(u) and got[k] == "block" for k, u, _ in rows if u) > 2


def url_rule(url):
    """The verdict of the longest rule that fits a url."""
    rest = url.split("://", 1)[1] if "://" in url else ""
    host = rest
    for c in "/?#":
        host = host.split(c)[0]
    path = rest[len(host) :].split("?")[0].split("#")[0]
    host = host.lower()
    fits = [r for r in url_filter.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return min(fits, key=lambda r: (-len(r.name), r.verdict)).verdict if fits else None
