"""Operators against brute force and on odd rows: nulls, empty and long texts, ties, repeats, empty tables, clashing columns."""

import base64
import hashlib
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.llm import brute
from tidemark.llm import bpe, components, decontaminate, line_dedup, ngram_join, ordinal, repeats, secrets, topk, toxicity, url_rules
from tidemark.llm import words as W

VOCABULARY, PATTERN = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN


def texts_of(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


# Words and hashes


def test_words_match_the_pattern(corpus):
    texts = [t for _, t in texts_of(corpus)]
    for inside, lower, plain in ((W.ALNUM, True, brute.alnum_words), (W.NON_SPACE, False, brute.space_words)):
        got = []
        for _, data, offsets in W.chunks(pa.array(texts)):
            w = W.split_words(data, offsets, inside, lower)
            for d in range(len(offsets) - 1):
                got.append([w.data[s:e].tobytes().decode() for s, e in zip(w.start[w.doc == d], w.end[w.doc == d])])
        assert got == [plain(t) for t in texts]


def test_equal_ngrams_have_equal_hashes_wherever_they_are():
    a, b = "x y z one two three", "one two three"
    (_, data, offsets), = W.chunks(pa.array([a, None, b, "one two"]))
    at, g = W.ngrams(W.split_words(data, offsets, W.ALNUM, True), 3)
    assert at.tolist() == [0, 1, 2, 3, 6] and g[3] == g[4] and len(set(g.tolist())) == 4


def test_sliding_argmin_takes_the_last_least():
    x = np.array([3, 1, 1, 5, 0, 7, 7, 7])
    for w in (1, 2, 3, 5, 8):
        want = [max(i for i in range(p, p + w) if x[i] == x[p : p + w].min()) for p in range(len(x) - w + 1)]
        assert W.sliding_argmin(x, w).tolist() == want
    assert not len(W.sliding_argmin(x[:2], 3))


# Decontamination


def test_contamination_matches_brute_force(spark, corpus, prose):
    long = prose(99, 80)
    items = [(1, " ".join(long.split()[10:40])), (2, "One two"), (3, ""), (4, None), (5, prose(0, 40)), (5, prose(1, 47)), (None, prose(2, 54)), (7, prose(12345, 30)), (8, " ".join(long.split()[30:42]))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.contamination(corpus, bench).collect()
    want = brute.contamination(texts_of(corpus), items)
    assert {r["doc_id"]: (r["n_words"], r["n_hit"], r["items"]) for r in got} == want
    assert sum(h > 0 for _, h, _ in want.values()) >= 8
    assert all(r["contaminated"] == (r["n_hit"] > 0 and 20 * r["n_hit"] >= r["n_words"]) for r in got)


def test_contamination_on_odd_tables(spark, prose):
    docs = spark.createDataFrame([(None, prose(1, 30)), (4, prose(1, 30)), (4, prose(1, 30)), (4, prose(2, 30)), (5, None)], "doc_id long, text string")
    bench = spark.createDataFrame([(1, prose(1, 20))], "item_id long, text string")
    got = sorted((str(r["doc_id"]), r["n_words"] and r["n_hit"]) for r in decontaminate.contamination(docs, bench).collect())
    assert [x[0] for x in got] == ["4", "4", "4", "5", "None"]
    assert [x[1] > 0 for x in got] == [False, True, True, False, True]
    assert not decontaminate.contamination(docs, bench.limit(0)).where("contaminated").count()
    assert not decontaminate.contamination(docs.limit(0), bench).count()


# Secrets


def entropy_spans(text):
    found = []
    for c, (_, chars, bits) in enumerate(secrets.CLASSES):
        for m in re.finditer(f"{chars}{{{secrets.WINDOW},}}", text):
            s = m.group()
            if not (re.search("[0-9]", s) and re.search("[A-Za-z]", s)) or re.search("|".join(secrets.ALLOW), s):
                continue
            high = []
            for p in range(len(s) - secrets.WINDOW + 1):
                w = s[p : p + secrets.WINDOW]
                h = -sum(n / len(w) * math.log2(n / len(w)) for n in (w.count(x) for x in set(w)))
                high += [p] if h >= bits - 1e-7 else []
            if high:
                found.append((m.start() + high[0], c + len(secrets.BASE), m.start() + high[-1] + secrets.WINDOW))
    return found


def test_secrets_match_brute_force(spark):
    r = random.Random(3)
    some = lambda n, a="abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/": "".join(r.choice(a) for _ in range(n))
    texts = [f"é😀 pass {some(n)} and {some(n, '0123456789abcdef')} end" for n in range(15, 60, 3)]
    texts += [
        'PassWord = "hunter2hunter2" token=secret:abcdefghij api-key: no apikey:\'Zz9_zz.zz\'',
        f"AKIA{'Q7' * 8} AKIA123 {'ab' * 16} {'aaaa1' * 9} x{'0123456789abcdef' * 3}",
        "id 123e4567-e89b-12d3-a456-426614174000 key=" + "A" * 40,
        "token=" + some(300) * 3, None, "", "password=short token:\n=x",
    ]
    docs = spark.createDataFrame(list(enumerate(texts)) + [(len(texts), texts[0]), (0, texts[0]), (0, texts[1])], "doc_id long, text string")
    got = secrets.scan(docs).collect()
    assert len(got) == len(texts) + 3
    seen = {}
    for x in got:
        seen.setdefault(x["doc_id"], []).append(x)
    for i, t in enumerate(texts[2:], 2):
        t = t or ""
        base = []
        for rank, (kind, pattern, least, group) in enumerate(secrets.BASE):
            base += [(m.start(), rank, kind, m.end()) for m in re.finditer(pattern, t) if len(m.group(group)) >= least]
        assert [tuple(b) for b in seen[i][0]["base"]] == sorted(base), t
        assert [(e["s"], e["r"], e["e"]) for e in seen[i][0]["entropy"]] == sorted(entropy_spans(t)), t
    assert sum(len(x["entropy"]) > 0 for x in got) > 8
    assert not secrets.scan(docs.limit(0)).count()


# Top-k


@pytest.mark.parametrize("tile,block", [(4096, 512), (16, 3)])
def test_top_k_is_exact(spark, monkeypatch, tile, block):
    monkeypatch.setattr(topk, "TILE_ROWS", tile)
    monkeypatch.setattr(topk, "BLOCK_QUERIES", block)
    r = np.random.default_rng(5)
    v = {i: r.normal(size=7).tolist() for i in range(120)}
    for i in range(60, 100):
        v[i] = v[60]  # ties
    rows = [(i, x, "a") for i, x in v.items()] + [(7, v[7], "b"), (200, None, "x"), (201, [1.0, None] + [0.0] * 5, "x"), (202, [float("nan")] * 7, "x"), (203, [float("inf")] * 7, "x"), (204, [1.0], "x"), (None, v[0], "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank string").repartition(4)
    got = {}
    for x in topk.top_k(df, F.col("_id") % 20 == 0, k=5).collect():
        got.setdefault(x["query_id"], []).append((x["rank"], x["vec_id"], x["score"]))
    whole = {i: np.floor(64 * np.array(x, np.float32).astype(float)) for i, x in v.items()}
    for q in range(0, 120, 20):
        want = sorted((-int(whole[q] @ whole[i]), i) for i in whole if i != q)[:5]
        assert sorted(got[q]) == [(n + 1, i, -s) for n, (s, i) in enumerate(want)]
    assert set(got) == set(range(0, 120, 20))


def test_top_k_of_few_rows(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0]), (1, [1.0, 1.0])], "vec_id long, embedding array<double>")
    assert [tuple(r) for r in topk.top_k(df, F.col("_id") % 20 == 0).collect()] == [(0, 1, 1, 64 * 64 * 3)]
    assert not topk.top_k(df.limit(0), F.col("_id") % 20 == 0).count()


def test_top_k_meets_rows_of_the_same_length(spark):
    r = random.Random(6)
    rows = [(i, [r.uniform(-1, 1) for _ in range(3 if i % 4 == 0 else 5)]) for i in range(90)] + [(100, [1.0])]
    got = {}
    for x in topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("_id") % 10 == 0, k=4).collect():
        got.setdefault(x["query_id"], []).append((x["score"], x["vec_id"]))
    whole = {i: [math.floor(64 * float(np.float32(x))) for x in v] for i, v in rows}
    want = {
        q: sorted(((sum(a * b for a, b in zip(whole[q], v)), i) for i, v in whole.items() if i != q and len(v) == len(whole[q])), key=lambda x: (-x[0], x[1]))[:4]
        for q in whole if q % 10 == 0 and q < 100
    }
    assert got == want


# URLs


def test_url_parts_and_rules(spark):
    urls = ["http://A.B.example.net/en/1", "http://example.net/fr/1", "https://x.example.com/de/2?q#f", "http://y.org/fr/", "ftp://y.org", "no url", None, "", "http://", "x://h?a=1&b=2&a=3#z", "http://notexample.com/de/1", "http://e.com/a://b"]
    pages = spark.createDataFrame([(i, u, "mine") for i, u in enumerate(urls)], "page_id long, url string, host string")
    got = {r["page_id"]: r for r in url_rules.judge(pages, pages.select("url", F.lit(True).alias("bad")).limit(0)).collect()}
    assert [(got[i]["host"], got[i]["path"], got[i]["rule"], got[i]["verdict"]) for i in range(len(urls))] == [
        ("a.b.example.net", "/en/1", "example.net/en/", "allow"), ("example.net", "/fr/1", "net/", "block"), ("x.example.com", "/de/2", "example.com/de/", "block"),
        ("y.org", "/fr/", "org/fr/", "allow"), ("y.org", "", None, "allow"), ("", "", None, "allow"), ("", "", None, "allow"), ("", "", None, "allow"), ("", "", None, "allow"),
        ("h", "", None, "allow"), ("notexample.com", "/de/1", None, "allow"), ("e.com", "/a://b", None, "allow"),
    ]


def test_mined_rules_block(spark):
    rows = [(f"http://{'bad' if i % 3 == 0 else 'ok'}.site.com/{'x' if i % 2 else 'y'}/{i}", i % 3 == 0 and i % 2 == 1) for i in range(120)] + [(None, True), ("http://bad.site.com/x/1", None)]
    labelled = spark.createDataFrame(rows, "url string, bad boolean")
    rules = [r["tokens"] for r in url_rules.mine(labelled, "url", "bad").collect()]
    assert all(any(t.endswith("=bad") or "bad.site" in t for t in r) and "first=x" in r for r in rules) and rules
    pages = spark.createDataFrame([(1, "http://bad.site.com/x/777"), (2, "http://bad.site.com/y/777"), (3, "http://ok.site.com/x/7"), (1, "http://bad.site.com/x/777")], "page_id long, url string")
    assert sorted((r["page_id"], r["verdict"]) for r in url_rules.judge(pages, labelled).collect()) == [(1, "block"), (1, "block"), (2, "allow"), (3, "allow")]
    assert not url_rules.judge(pages.limit(0), labelled).count()


# Similarity join


def test_near_copies_match_brute_force(corpus):
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in ngram_join.near_copies(corpus).collect()}
    want = brute.near_copies(texts_of(corpus))
    assert got == want
    assert sum(l > 0 for _, l in want.values()) > 8


def test_large_group_of_different_texts(spark, monkeypatch, prose):
    monkeypatch.setattr(ngram_join, "TILE", 8)
    w = prose(1, 200).split()
    rows = [(i, " ".join(w[:i] + [f"new{i}"] + w[i + 1 :])) for i in range(60)]
    got = ngram_join.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = brute.near_copies(rows)
    assert {r["doc_id"]: (r["class_id"], r["n_links"]) for r in got} == want and want[5] == (0, 59)


def test_near_copies_of_odd_rows(spark, prose):
    t = prose(1, 60)
    rows = [(5, t, 1), (5, t, 1), (3, t, 2), (None, t, 3), (9, None, 4), (9, "", 5), (10, prose(2, 60), 6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, class_id long")
    got = sorted(map(str, (tuple(r) for r in ngram_join.near_copies(df).collect())))
    assert got == sorted(map(str, [(5, 3, 2), (5, 3, 2), (3, 3, 2), (None, None, 0), (9, 9, 0), (9, 9, 0), (10, 10, 0)]))
    assert not ngram_join.near_copies(df.limit(0)).count()


def test_banding_reaches_the_recall():
    for s, recall in ((0.8, 0.9999), (0.5, 0.9), (0.95, 0.999)):
        b, r = ngram_join.banding(s, recall)
        assert 1 - (1 - s**r) ** b >= recall and b * r <= ngram_join.HASHES


def test_intersections_by_both_ways(monkeypatch):
    r = np.random.default_rng(1)
    sets = [np.unique(r.integers(0, 60, 30)) for _ in range(25)] + [np.zeros(0, np.int64)]
    doc, gram = np.repeat(np.arange(len(sets)), [len(s) for s in sets]), np.concatenate(sets)
    want = np.array([[len(np.intersect1d(a, b)) if i != j else 0 for j, b in enumerate(sets)] for i, a in enumerate(sets)])
    for rare, columns in ((16, 2048), (2, 7), (64, 16)):
        monkeypatch.setattr(ngram_join, "RARE", rare)
        monkeypatch.setattr(ngram_join, "COLUMNS", columns)
        assert (ngram_join.intersections(doc, gram, len(sets)) == want).all()


def test_components_of_paths_and_stars(spark):
    path = [(i, i + 1) for i in range(40)]
    star = [(100, 100 + i) for i in range(1, 30)]
    e = spark.createDataFrame(path[::-1] + star + [(7, 7), (300, 200), (200, 300)], "a long, b long")
    got = {r["node"]: r["root"] for r in components.components(e).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, **{100 + i: 100 for i in range(1, 30)}, 300: 200}
    assert not components.components(e.limit(0)).count()


# Lines


def test_boilerplate_lines_go(spark):
    rows = [(i, f"Menu\nmy own line {i}\nMenu\n\nrare {i % 7}", "big" if i < 60 else "small") for i in range(63)] + [(90, None, "big"), (91, "", None), (92, "Menu", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("n_lines", F.lit("old"))
    got = {r["doc_id"]: r for r in line_dedup.drop_boilerplate(df).collect()}
    assert (got[0]["n_lines"], got[0]["n_dropped"]) == (5, 3) and got[0]["text"] == "my own line 0\n"
    assert got[61]["text"] == rows[61][1] and got[61]["n_dropped"] == 0  # a host of three pages
    assert got[90]["text"] is None and got[90]["n_lines"] == 0
    assert got[91]["text"] == "" and got[92]["text"] == "Menu"
    assert not line_dedup.drop_boilerplate(df.limit(0)).count()


# Repeats


def test_repeats_match_brute_force(corpus, monkeypatch):
    for group, chunk in ((repeats.GROUP, W.CHUNK_BYTES), (50, 3000)):
        monkeypatch.setattr(repeats, "GROUP", group)
        monkeypatch.setattr(W, "CHUNK_BYTES", chunk)
        got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept"] or "", r["kept_sha256"]) for r in repeats.remove_repeats(corpus).collect()}
        want = brute.repeats(texts_of(corpus))
        assert {d: x[:3] for d, x in got.items()} == want
        assert all(hashlib.sha256(x[2].encode()).hexdigest() == x[3] for x in got.values())
        assert sum(n > 0 for _, n, _ in want.values()) >= 9


def test_settled_marks_of_chunks_that_begin_alike_are_spread(prose, monkeypatch):
    monkeypatch.setattr(repeats, "PIECE", 40, raising=False)
    same = prose(5, 60)
    chunks = [pa.RecordBatch.from_pydict({"_id": [2 * i, 2 * i + 1], "_t": [same, same]}) for i in range(64)]
    packed = pa.Table.from_batches(repeats._anchors(16, 50, 25)(iter(chunks)))
    settled = packed.filter(packed["done"])
    _, doc, _, at = repeats._unpack(settled, "<u4")
    assert sorted(zip(doc.tolist(), at.tolist())) == [(d, p) for d in range(128) for p in range(36)]
    count = {}
    for p, runs in zip(settled["p"].to_pylist(), settled["runs"].to_pylist()):
        count[p] = count.get(p, 0) + sum(runs)
    assert len(count) == 16 and max(count.values()) <= 2 * 128 * 36 / 16

    text, keys = pa.array([same, same]), pa.array([0, 0])
    marks = pa.array([list(range(36))] * 2, pa.list_(pa.int32()))
    marked = [pa.RecordBatch.from_arrays([pa.array([2 * i, 2 * i + 1]), text, keys, marks], names=["_id", "_t", "_key", "marks"]) for i in range(64)]
    packed = pa.Table.from_batches(repeats._extend(16, 50, 25)(iter(marked)))
    assert len(set(packed.filter(packed["done"])["p"].to_pylist())) == 16


def test_repeats_of_odd_rows(spark, prose):
    t = prose(1, 70)
    rows = [(2, t), (2, t), (2, prose(3, 60)), (1, prose(3, 60)), (None, t), (7, "w " * 200), (8, "w " * 120)]
    got = sorted((str(r["doc_id"]), r["n_words"], r["n_removed"]) for r in repeats.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [("1", 60, 0), ("2", 60, 60), ("2", 70, 0), ("2", 70, 0), ("7", 200, 0), ("8", 120, 120), ("None", 70, 0)]


# Tokens


def test_tokens_equal_the_rank_file(corpus):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
    plain = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = {r["doc_id"]: r for r in bpe.encode(corpus, VOCABULARY, PATTERN).collect()}
    for d, t in texts_of(corpus):
        assert got[d]["ids"] == plain.encode_ordinary(t or "")
        assert got[d]["offsets"] == np.cumsum([0] + [len(plain.decode_single_token_bytes(i)) for i in got[d]["ids"]])[:-1].tolist()
    back = bpe.decode(bpe.encode(corpus, VOCABULARY, PATTERN), VOCABULARY, PATTERN)
    assert all(r["decoded_text"] == (r["text"] or "") for r in back.collect())


def test_odd_texts_and_split_characters(monkeypatch):
    import tiktoken

    monkeypatch.setattr(bpe, "KEPT", 40)
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
    plain = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    coder, r = bpe.Coder(VOCABULARY, PATTERN), random.Random(1)
    parts = [" ", "  ", "\n", "\t", "a", "bc", "'s", "don't", "1", "٣", "é", "\x1c", "\x85", "\xa0", "　", ".", "!!", "<|endoftext|>", "😀", "the", " of\n", "x​"]
    for _ in range(4000):
        s = "".join(r.choice(parts) for _ in range(r.randint(0, 14)))
        ids = coder.encode(s)
        assert np.frombuffer(ids, "<u4").tolist() == plain.encode_ordinary(s) and coder.decode(ids) == s.encode()
    ids = np.frombuffer(coder.encode("😀𝒳é😀"), "<u4").tolist()
    other = bpe.Coder(VOCABULARY, r"\w+ \w+|\s|\S")
    for text in ("one two three four", "a b c", " x  y z"):
        assert other.encode(text) == other._of_pieces(text)
    stream = bpe.Stream(coder)
    assert "".join(stream.feed([i]) for i in ids) + stream.feed([], True) == "😀𝒳é😀"
    assert bpe.Stream(coder).feed(ids[:1], True) == "\ufffd"


# Models


def rated(prose, n):
    rows = []
    for i in range(n):
        w = prose(1000 + i, 60).split(" ")
        y = i % 3
        for j in range(3 * y):
            w.insert(5 * j, "vilething" + random.Random(i + j).choice(["", "s", "ly"]))
        rows.append((i, " ".join(w), y))
    return rows


def test_toxicity_on_the_held_out_fold(spark, prose):
    rows = [(i, t, int(y > 0)) for i, t, y in rated(prose, 400)]
    df = spark.createDataFrame(rows + [(900, None, None), (901, "", None), (902, "!!", 1)], "doc_id long, text string, toxic int").withColumn("score", F.lit("x"))
    model = toxicity.train(df, df.select("doc_id", "toxic"))
    got = {r["doc_id"]: r["score"] for r in toxicity.score(df, model).collect()}
    held = [(got[i] >= 0.5) == (y == 1) for i, _, y in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert len(held) > 50 and sum(held) >= 0.95 * len(held)
    assert got[900] == got[901] < 0.5 and all(0 <= s <= 1 for s in got.values())
    assert len(model.toxic) and model.toxic != model.ordinary


def test_toxicity_without_a_class(spark):
    df = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    one = spark.createDataFrame([(1, 1), (1, None), (None, 0)], "doc_id long, toxic int")
    assert {r["score"] for r in toxicity.score(df, toxicity.train(df, one)).collect()} == {1.0}
    assert {r["score"] for r in toxicity.score(df, toxicity.train(df, one.limit(0))).collect()} == {0.0}
    assert not toxicity.score(df.limit(0), toxicity.train(df, one)).count()


def test_grades_are_ordered_and_learned(spark, prose):
    rows = rated(prose, 450)
    df = spark.createDataFrame(rows + [(900, None, None), (901, "", 7)], "doc_id long, text string, grade int").withColumn("selected", F.lit("x"))
    model = ordinal.train(df.where("doc_id % 5 > 0"), df.select("doc_id", "grade"), 3)
    assert (np.diff(model.thresholds) > 0).all()
    got = {r["doc_id"]: r for r in ordinal.score(df, model).collect()}
    held = [(y, got[i]["expected_grade"]) for i, _, y in rows if i % 5 == 0]
    assert sum(round(e) == y for y, e in held) >= 0.9 * len(held)
    assert all(r["selected"] == (r["top_probability"] >= 0.5) and 0 <= r["expected_grade"] <= 2 for r in got.values())
    assert got[900]["value"] == got[901]["value"] == 0
    none = ordinal.train(df, df.select("doc_id", "grade").limit(0), 3)
    assert abs(ordinal.score(df.limit(1), none).first()["expected_grade"] - 1) < 0.35


def test_line_dedup_passes_clashing_columns_through(spark):
    """Columns named like the operator's own keep their values, and lines go as without them."""
    rows = [(i, f"menu\nown {i}", "h", "mine", [i], "k", "h2") for i in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, _host string, _keys array<int>, _kept string, _host_ string")
    got = line_dedup.drop_boilerplate(docs)
    assert set(docs.columns) < set(got.columns)
    want = {(i, f"own {i}", "h", "mine", (i,), "k", "h2", 1) for i in range(6)}
    assert {(r["doc_id"], r["text"], r["source"], r["_host"], tuple(r["_keys"]), r["_kept"], r["_host_"], r["n_dropped"]) for r in got.collect()} == want
