from __future__ import annotations

import random
import re
import zlib

import pyarrow as pa
from pyspark.sql import functions as F

from rankmesh.llm import common as C


def test_sampled_ids_are_those_with_the_smallest_hashes(spark):
    ids = spark.range(5000).select(F.col("id").alias("doc_id"))
    want = [r.doc_id for r in ids.orderBy(F.xxhash64("doc_id")).limit(200).collect()]
    for rows in (ids, ids.repartition(7), ids.limit(4000).unionByName(ids.filter("doc_id >= 4000"))):
        assert [r.doc_id for r in C.sample_ids(rows, 200).collect()] == want
    assert C.sample_ids(ids, 10_000).count() == 5000 and C.sample_ids(ids.limit(0), 5).count() == 0


def test_repeated_ids_make_no_sample_smaller(spark):
    for n, rows in ((4000, 25_000), (9, 30_000), (1, 120_000), (6000, 60_000)):
        ids = spark.range(rows).select((F.col("id") % n).alias("doc_id"))
        assert sorted(r.doc_id for r in C.sample_ids(ids, 5000).collect()) == sorted(r.doc_id for r in spark.range(n).selectExpr("id doc_id").orderBy(F.xxhash64("doc_id")).limit(5000).collect())


def test_free_names_and_columns(spark):
    df = spark.range(1).selectExpr("id as `a.b`", "id as x", "id as X_")
    assert C.free(df, "x", "y", "x") == ["x__", "y", "x___"] and df.select(*C.columns(df)).columns == df.columns


def test_words():
    text = "A\x1cB É\x85x\xa0y z\x0b\x0c\r\n\t w"
    assert [w.decode() for w in C.words_of(text)] == re.findall(C.WORD_PATTERN, re.sub("[A-Z]", lambda m: m[0].lower(), text))


def test_folds_are_crc32_of_the_written_id(spark):
    got = spark.range(-3, 40).select("id", C.fold("id", 4).alias("f")).collect()
    assert all(r.f == zlib.crc32(str(r.id).encode()) % 4 for r in got)


def test_chunks_keep_rows_and_order():
    rng = random.Random(1)
    texts = [rng.choice([None, "", "x" * rng.randint(1, 300)]) for _ in range(200)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(200)), pa.array(texts)], ["n", "text"])
    parts = list(C.chunks([batch, batch.slice(0, 0)], "text", 400))
    assert [x for p in parts for x in p.column(0).to_pylist()] == list(range(200))
    assert all(p.num_rows == 1 or sum(len(t or "") for t in p.column(1).to_pylist()) <= 400 for p in parts)


def test_written_rows_come_back(spark):
    df = spark.range(10).withColumn("x", F.array(F.lit(1)))
    again = C.written(df, "t")
    assert again.dtypes == df.dtypes and again.count() == 10 and C.shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")


def test_scratch_is_deleted_and_what_is_to_be_kept_is_not(spark):
    import os

    top = C.shared_dir(spark).removeprefix("file:")
    df = spark.range(3).withColumn("x", F.lit(1))
    before = set(os.listdir(top))
    with C.scratch(spark):
        C.written(df, "gone")
        with C.scratch(spark):
            kept = C.written(C.written(df, "gone"), "stays", keep=True)
        assert kept.count() == 3
    assert [x.split("-")[0] for x in set(os.listdir(top)) - before] == ["stays"] and kept.count() == 3


def test_operators_leave_little_behind(spark):
    import os

    from tests_llm_tools import prose, table

    from rankmesh.llm import nearcopies, quality, simhash, toxicity

    top = C.shared_dir(spark).removeprefix("file:")
    docs = table(spark, [(i, prose(i % 20, 60) + (" vilewort" if i % 9 == 0 else ""), "a") for i in range(200)])
    labels = spark.createDataFrame([(i, 1, int(i % 9 == 0)) for i in range(200)], "doc_id long, quality int, toxic int")
    for work, left in ((lambda: toxicity.reject(docs, labels), 0), (lambda: quality.reject(docs), 0), (lambda: nearcopies.one_of_each(docs), 2), (lambda: simhash.one_of_each(docs), 2)):
        before = set(os.listdir(top))
        out = work()
        assert len(set(os.listdir(top)) - before) <= left and out.count() > 0
