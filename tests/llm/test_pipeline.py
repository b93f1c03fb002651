"""The pipeline's stages on the smallest tables: filters keep columns, one near copy stays, packing keeps every token."""

from collections import Counter

import corpus_pipeline as cp
from pyspark.sql import functions as F

DATA = "/root/testdata/sf0.001"


def test_near_copies_keep_one_row_of_each_group(spark):
    words = " ".join(f"w{i}" for i in range(60))
    rows = [(3, words, "a"), (1, words, "b"), (1, words, "c"), (2, words + " x", "d"), (4, "other words that stand alone here", "e"), (5, "", "f"), (5, "", "g"), (None, None, "h")]
    out = cp.drop_near_copies(spark, spark.createDataFrame(rows, "doc_id long, text string, n_links string"), DATA)
    assert out.columns == ["doc_id", "text", "n_links"]
    assert Counter(r["doc_id"] for r in out.collect()) == {1: 1, 4: 1, 5: 2, None: 1}


def test_whole_pipeline(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    kept = docs
    for name, stage in cp.STAGES[:-1]:
        after = stage(spark, kept, DATA)
        after.write.mode("overwrite").parquet(str(tmp_path / name))
        after = spark.read.parquet(str(tmp_path / name))
        assert after.columns == docs.columns
        assert after.count() <= kept.count()
        kept = after
    assert kept.count() > 0.4 * docs.count()
    packed = cp.pack(spark, kept, DATA)
    rows = packed.collect()
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for pieces in by.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 2048
    assert {r["doc_id"] for r in rows} == {r["doc_id"] for r in kept.select("doc_id").collect()}
    assert not kept.where(F.col("text").rlike(r"[a-z0-9.]+@[a-z0-9]+\.[a-z]+")).count()


ODD = "doc_id long, text string, score double, _score string, spans string, length int"


def test_stages_on_odd_tables(spark):
    words = " ".join(f"w{i}" for i in range(60))
    rows = [(1, words, 0.5, "a", "b", 7), (1, words, 0.5, "a", "b", 7), (2, None, None, None, None, None), (3, "", 1.0, "", "", 0), (None, "a@b.co 1.2.3.4", 2.0, "x", "y", 1), (4, "long " * 50_000, 0.0, "z", "z", 2)]
    docs = spark.createDataFrame(rows, ODD)
    for name, stage in cp.STAGES[:-1]:
        out = stage(spark, docs, DATA)
        assert out.columns == docs.columns, name
        got = Counter(map(tuple, out.collect()))
        if name == "near_copies":
            assert sum(got.values()) == 5 and got[rows[0]] == 1
        elif name == "personal_data":
            assert got[(None, "[email] [ip]", 2.0, "x", "y", 1)] == 1 and sum(got.values()) == 6
        else:
            assert not got - Counter(rows), name
        assert stage(spark, docs.limit(0), DATA).count() == 0, name
    packed = cp.pack(spark, docs, DATA)
    assert Counter(r["doc_id"] for r in packed.collect())[1] == 2
    assert cp.pack(spark, docs.limit(0), DATA).count() == 0


def test_equal_rows_give_the_least(spark):
    words = " ".join(f"w{i}" for i in range(60))
    docs = spark.createDataFrame([(1, words, c) for c in "cab"], "doc_id long, text string, mark string")
    assert [tuple(r) for r in cp.drop_near_copies(spark, docs, DATA).collect()] == [(1, words, "a")]
