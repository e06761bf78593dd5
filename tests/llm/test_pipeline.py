"""Stages on a small corpus, held against brute force, and the registered queries."""

import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipe
from tests.llm import brute
from tidemark.llm import queries
from tidemark.llm.shared import stage

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def tables(spark, corpus, prose, tmp_path_factory):
    """A folder of documents, labels and benchmark; toxic documents and an item's passage are planted."""
    at = str(tmp_path_factory.mktemp("sf"))
    bad = [" ".join(prose(500 + i, 40).split(" ") + ["vilething", "vilethings", "vilethingly"] * 2) for i in range(60)]
    good = [prose(700 + i, 50) for i in range(60)]
    item = prose(900, 25)
    more = [(1000 + i, t, "en", "src0", len(t)) for i, t in enumerate(bad + good)]
    more += [(2000 + i, f"menu of the site\n{prose(950 + i, 30)}\n{item if i < 2 else ''}", "en", "src7", 9) for i in range(8)]
    docs = corpus.union(spark.createDataFrame(more, corpus.schema))
    docs.write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(1000 + i, 1, int(i < 60)) for i in range(120)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return at


def test_each_stage_takes_effect(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    rows = lambda df: {r["doc_id"]: r for r in df.collect()}
    before = rows(docs)
    held = [1000 + i for i in range(120) if zlib.crc32(str(1000 + i).encode()) % 5 == 0]

    docs = stage(pipe.STAGES[0][1](spark, docs, tables), "t")
    after = rows(docs)
    assert docs.columns == COLUMNS
    assert all((i in after) == (i >= 1060) for i in held) and all(i in after for i in before if i < 1000 or i >= 1060)

    before, docs = after, stage(pipe.STAGES[1][1](spark, docs, tables), "t")
    after = rows(docs)
    assert docs.columns == COLUMNS and set(after) == set(before)
    changed = {i for i in after if after[i]["text"] != before[i]["text"]}
    assert {2000 + i for i in range(8)} <= changed
    assert all("menu of" not in after[i]["text"] and after[i]["n_chars"] == len(after[i]["text"]) for i in changed if i >= 2000)

    before, docs = after, stage(pipe.STAGES[2][1](spark, docs, tables), "t")
    after = rows(docs)
    classes = brute.near_copies([(i, r["text"]) for i, r in before.items()])
    assert docs.columns == COLUMNS and set(after) == {i for i, (c, _) in classes.items() if c == i} and len(after) < len(before)

    before, docs = after, stage(pipe.STAGES[3][1](spark, docs, tables), "t")
    after = rows(docs)
    found = brute.contamination([(i, r["text"]) for i, r in before.items()], [(1, r["text"]) for r in spark.read.parquet(f"{tables}/benchmark.parquet").collect()])
    assert docs.columns == COLUMNS and set(after) == {i for i, (n, hit, _) in found.items() if not (hit and 20 * hit >= n)}
    assert set(before) - set(after) == {2000, 2001}

    last = rows(pipe.STAGES[4][1](spark, docs, tables))
    assert set(last) == set(after)
    for i, r in last.items():
        assert r["decoded_sha256"] == hashlib.sha256((after[i]["text"] or "").encode()).hexdigest()
        assert len(r["ids"]) == r["n_tokens"] and hashlib.sha256(np.array(r["ids"], "<u4").tobytes()).hexdigest() == r["ids_sha256"]


def test_run_ends_like_the_stages(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    for name, apply in pipe.STAGES:
        docs = stage(apply(spark, docs, tables), name)
    key = lambda df: sorted((r["doc_id"], r["ids_sha256"]) for r in df.collect())
    assert key(pipe.run(spark, tables)) == key(docs)


def test_stages_on_odd_rows(spark, tables):
    rows = [(None, "a b c d e f", None, None, None), (1, None, None, None, None), (1, "", "en", "s", 0), (5, "same words in this text", "en", "s", 1), (5, "same words in this text", "en", "s", 1), (5, "other words", "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name, apply in pipe.STAGES:
        docs = stage(apply(spark, docs, tables), name)
    assert sorted(str(r["doc_id"]) for r in docs.collect()) == ["1", "1", "5", "5", "None"]
    none = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for name, apply in pipe.STAGES:
        none = stage(apply(spark, none, tables), name)
    assert not none.count()


def test_texts_that_share_an_id_are_told_apart(spark):
    """Only the copy goes; another text of its id, and its near copies, keep their own class."""
    a, b, c, d = ("one two three four five six", "other words of a second text here", "a third text that is alone", "fourth text of some more words")
    long = " ".join(f"w{i}" for i in range(60))
    rows = [(1, a), (5, a), (5, b), (7, c), (5, b), (9, d), (9, long), (11, long + " tail"), (1, d)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    got = pipe.drop_near_copies(spark, docs, "")
    assert sorted((r["doc_id"], r["text"]) for r in got.collect()) == sorted([(1, a), (5, b), (7, c), (9, long), (1, d)])
    near = {(r["doc_id"], r["text_key"]): (r["class_id"], r["n_links"]) for r in pipe.ngram_join.marked_copies(docs).collect()}
    key = {r["text"]: r["k"] for r in docs.select("text", pipe.decontaminate.text_key(F.col("text")).alias("k")).collect()}
    assert near[5, key[a]] == (1, 1) and near[5, key[b]] == (5, 1) and near[9, key[d]] == (1, 1) and near[9, key[long]] == (9, 1) and near[11, key[long + " tail"]] == (9, 1)


def test_queries_are_all_there():
    names = {f"op{n}_" for n in range(1, 14)}
    assert {n[: n.index("_") + 1] for n in queries.QUERIES} == names and len(queries.QUERIES) == 13
    assert set(queries.ORACLE) < set(queries.QUERIES)
    assert [n for n, _ in pipe.STAGES] == ["toxicity", "line_dedup", "ngram_join", "decontamination", "byte_bpe"]


SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_equals_its_sql(spark, name):
    from tests.compare import duck, rows_of

    got, want = queries.QUERIES[name](spark, SF).toPandas(), duck(SF).execute(queries.ORACLE[name]).df()
    assert rows_of(got) == rows_of(want) and len(want)


def test_toxicity_query_separates_the_held_out_fold(spark):
    sf = "/root/testdata/sf0.1"
    got = queries.QUERIES["op10_compression_toxicity"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "toxic"), "doc_id")
    n = got.where("held_out").groupBy("toxic", "predicted").count().collect()
    n = {(r["toxic"], r["predicted"]): r["count"] for r in n}
    # Measured 83 of 97: 350 toxic texts to learn from, and five of the missed are copies of one text without a toxic word.
    assert n[1, 1] >= 0.8 * (n[1, 1] + n.get((1, 0), 0)) and n.get((0, 1), 0) <= 0.02 * n[0, 0]
    assert got.where((F.col("predicted") == 1) != (F.col("score") >= 0.5)).count() == 0
