import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from scriptorium.llm.mixing import mix
from scriptorium.llm.shared import drop_written, fresh_path, shared_dir, unused, written


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    counts = [docs.count()]
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        after = written(stage(spark, docs, sf_dir), "test")
        if n < 4:
            assert after.columns == docs.columns, name
        counts.append(after.count())
        if n == 0:
            rejected = docs.join(after, "doc_id", "left_anti").join(spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id")
            assert rejected.where("quality = 1").count() <= 2
        if n == 1:
            assert after.select("doc_id").distinct().count() == after.count()
        if n == 2:
            assert after.count() == docs.count() and after.where("n_chars <> length(text)").isEmpty()
        if n == 3:
            wanted = {r.doc_id: r.copies for r in mix(docs).collect() if r.copies}
            assert {r.doc_id: r["count"] for r in after.groupBy("doc_id").count().collect()} == wanted
        if n == 4:
            assert after.groupBy("sequence_id").agg({"length": "sum"}).where("`sum(length)` > 2048").isEmpty()
            assert after.where("piece = 0").count() == docs.count()
        docs = after
    assert counts[0] >= counts[1] > counts[2] == counts[3]


def test_passages_of_over_50_words_go(spark):
    """Planted in documents that are otherwise their own: of 51 to 60 words, in two or more; clean documents stay as they are."""
    draw = random.Random(6)
    syllables = ["th", "er", "on", "an", "re", "in", "ed", "ou", "ti", "st"]
    prose = lambda n: " ".join("".join(draw.choice(syllables) for _ in range(draw.randint(1, 4))) for _ in range(n))
    passages = [prose(n) for n in range(51, 61)]
    rows = [(i, f"{prose(80)} {passages[i % 10]} {prose(80)}" if i < 40 else prose(200), "en", "s", 0) for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r.doc_id: r.text for r in corpus_pipeline.drop_repeated_passages(spark, docs, "").collect()}
    assert len(kept) == 120 and all(kept[i] == t for i, t, *_ in rows[40:])
    assert not any(passages[i % 10] in kept[i] for i in range(40))
    assert all(t.startswith(kept[i][:200]) and t.endswith(kept[i][-200:]) for i, t, *_ in rows[:40])


def test_odd_rows_in_every_stage(spark, odd, sf_dir):
    """Null and repeated keys, null, empty, equal and long texts, and columns named as operators' own."""
    names = {"row": "x", "runs": [1], "rid": 5, "hash": 7, "copies": 2, "kept": True, "root": 3}
    docs = odd.drop("size", "score").withColumns({"lang": F.lit(None).cast("string"), "n_chars": F.length("text").cast("long")} | {n: F.array(F.lit(1)) if n == "runs" else F.lit(v) for n, v in names.items()})
    for name, stage in corpus_pipeline.STAGES:
        found = stage(spark, docs, sf_dir)
        rows = found.collect()
        assert stage(spark, docs.limit(0), sf_dir).isEmpty(), name
        if name != corpus_pipeline.STAGES[-1][0]:
            assert found.columns == docs.columns and all(r.rid == 5 and r.runs == [1] for r in rows), name
        if name == "MinHash near-dedup":
            assert sorted((r.doc_id or 0) for r in rows if r.text == "one two three four five six") == [1]
            assert {r.doc_id for r in rows} == {1, 2, 3, None, 5, 6, 7}
        if name == "suffix-array dedup":
            assert len(rows) == odd.count()  # equal texts here are shorter than what counts as a repeat
        if name == "best-fit packing":
            assert sum(r.piece == 0 for r in rows) == odd.count()


def test_run(spark, sf_dir):
    assert len(corpus_pipeline.STAGES) == 5 and corpus_pipeline.run(spark, sf_dir).count() > 0


def test_shared_folder(spark):
    frame = written(spark.range(5), "test")
    assert shared_dir(spark).startswith("file:/") and fresh_path(spark, "x") != fresh_path(spark, "x")
    drop_written(frame)
    with pytest.raises(Exception, match="(?i)does not exist|path_not_found|FILE_NOT_EXIST"):
        spark.read.schema("id long").parquet(frame.inputFiles()[0]).count()
    assert unused("a", spark.createDataFrame([(1, 2)], "A int, _a int")) == "__a"


def test_components(spark):
    from scriptorium.llm.graph import components

    draw = np.random.default_rng(5)
    edges = [tuple(map(int, e)) for e in draw.integers(0, 120, (70, 2))] + [(i, i + 1) for i in range(200, 240)] + [(300, i) for i in range(301, 340)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    found = {r.id: r.root for r in components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert found == {x: find(x) for x in root}
    assert components(spark.createDataFrame([], "a long, b long"), "a", "b").isEmpty()
