from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F
from tests_llm_tools import prose

corpus_pipeline = pytest.importorskip("corpus_pipeline")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(1)
    docs, labels = [], []
    for i in range(600):
        text, toxic = prose(i, rng.randint(30, 90)), i % 10 == 3
        if toxic:
            text += " vilewort" + rng.choice(["", " vilewort"]) + " and on"
        if i % 12 == 5:
            text = " ".join(w.upper() + "!!" for w in text.split())
        if i >= 550:
            text = docs[i - 550][1]  # exact copies
        docs.append((i, text, "en", f"s{i % 4}", len(text)))
        if i % 3:
            labels.append((i, int(i % 12 != 5), int(toxic)))
    path = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path), docs


def test_stages(spark, folder, tmp_path):
    path, docs = folder
    df, kept = spark.read.parquet(f"{path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, df, path)
        if name != "tokens":
            assert out.columns == df.columns
        out.write.parquet(str(tmp_path / name))
        df = spark.read.parquet(str(tmp_path / name))
        kept[name] = sorted(r.doc_id for r in df.collect())
    assert not any(i % 10 == 3 and i < 550 for i in kept["toxicity"]) and len(kept["toxicity"]) >= 0.89 * len(docs)
    assert not any(i % 12 == 5 and i < 550 for i in kept["quality"])
    text = {d[0]: d[1] for d in docs}
    rest = [i for i in kept["quality"]]
    assert len({text[i] for i in kept["near_copies"]}) == len(kept["near_copies"]) and {text[i] for i in kept["near_copies"]} == {text[i] for i in rest}
    assert set(kept["mix"]) <= set(kept["near_copies"])
    words = sum(len(re.findall(r"\S+", text[i])) for i in kept["near_copies"])
    assert abs(sum(len(re.findall(r"\S+", text[i])) for i in kept["mix"]) - words) < 0.05 * words
    assert kept["tokens"] == kept["mix"] and df.filter("not round_trip or n_ids = 0").count() == 0


def test_run_and_registration(spark, folder):
    import __spark_entry__ as entry

    queries, sql = entry.queries(), entry.oracle_sql()
    names = [f"op{n}_" for n in range(1, 11)]
    assert all(sum(q.startswith(n) for q in queries) == 1 for n in names) and "pipeline" in queries
    assert set(sql) <= set(queries) and [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "quality", "near_copies", "mix", "tokens"]
    assert corpus_pipeline.run(spark, folder[0]).filter("round_trip").count() > 300


def test_odd_rows_through_every_stage(spark, folder, odd, tmp_path):
    """Nulls, empty and very long texts, repeats, ties and clashing names: nothing but whole rows comes out, values as they were."""
    names = dict(zip(("fp", "key", "row", "ids", "size", "part", "component"), ("toxicity", "_key", "_text", "_n", "_copies", "pattern", "id"), strict=True))
    df = odd
    for a, b in names.items():
        df = df.withColumnRenamed(a, b)
    df = df.withColumn("_id", F.monotonically_increasing_id().cast("string")).cache()
    rows = {r["_id"]: str(r) for r in df.collect()}
    assert df.count() == len(rows)
    left = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, df, folder[0])
        out.write.parquet(str(tmp_path / name))
        df = spark.read.parquet(str(tmp_path / name))
        left[name] = df.collect()
        if name != "tokens":
            assert out.columns == odd_columns(odd, names) and all(str(r) == rows[r["_id"]] for r in left[name])
    ids = [r["_id"] for r in left["near_copies"]]
    assert len(set(ids)) == len(ids) and sum(not (r.text or "").strip() for r in left["near_copies"]) == 1
    assert set(r["_id"] for r in left["mix"]) <= set(ids) and len(left["tokens"]) == len(left["mix"])
    assert all((r.ids is None and r.n_ids is None and r.round_trip is None) or (len(r.ids) == r.n_ids and r.round_trip) for r in left["tokens"])
    alone = corpus_pipeline.STAGES[-1][1](spark, odd, folder[0]).collect()  # with the null texts that an earlier stage drops
    assert len(alone) == len(rows) and sum(r.ids is None for r in alone) == 2


def odd_columns(odd, names):
    return [names.get(c, c) for c in odd.columns]


def test_no_documents(spark, folder):
    df = spark.read.parquet(f"{folder[0]}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        df = stage(spark, df, folder[0])
        assert df.count() == 0
