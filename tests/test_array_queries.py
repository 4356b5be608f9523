"""The array queries against their SQL where vectors don't divide among the ranks."""

from __future__ import annotations

import duckdb
import numpy as np
import pytest

from rankmesh import queries as Q
from rankmesh.model import Comm
from rankmesh.operators import arrays


@pytest.fixture(scope="module")
def vectors(spark, tmp_path_factory) -> str:
    """33 vectors for 5 ranks: the last idx has arrays on three of them."""
    folder = tmp_path_factory.mktemp("vectors")
    v = np.random.default_rng(4).normal(0, 1, (33, 64)).astype("float32").tolist()
    spark.createDataFrame(list(enumerate(v)), "vec_id bigint, embedding array<float>").coalesce(1).write.parquet(f"{folder}/embeddings.parquet")
    return str(folder)


def same(spark, folder: str, name: str) -> int:
    """The number of rows, which are those of the SQL."""
    with duckdb.connect() as db:
        db.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{folder}/embeddings.parquet/*.parquet')")
        want = db.execute(Q.SQL[name]).fetchall()
    got = [tuple(r) for r in Q.QUERIES[name](spark, folder).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    return len(got)


def test_max_passes_over_ranks_without_an_array(spark, vectors):
    assert same(spark, vectors, "embedding_all_reduce_max") == 7 * 5 * 64


def test_sums_with_ranks_without_an_array_are_null(spark, vectors):
    assert same(spark, vectors, "embedding_all_reduce_sum") == 7 * 5 * 64


@pytest.mark.parametrize("ranks", [3, 70])
def test_a_missing_array_counts_as_nulls(spark, ranks):
    """With a column for each rank, and with an array of all; sums in either order."""
    rows = [(r, i, [float(r), -float(r)] if (r, i) != (1, 2) else None) for r in range(ranks) for i in range(3) if (r, i) != (0, 1)] + [(1, 3, None)]
    x = spark.createDataFrame(rows, "rank int, idx bigint, vals array<double>")
    total, last = ranks * (ranks - 1) / 2, ranks - 1.0
    for strict in (True, False):
        got = {r.idx: r.vals for r in arrays.all_reduce(x, Comm(ranks), strict=strict).filter("rank = 1").collect()}
        assert got == {0: [total, -total], 1: [None, None], 2: [None, None], 3: None}
    most = {r.idx: r.vals for r in arrays.all_reduce(x, Comm(ranks), "max").filter("rank = 1").collect()}
    assert most == {0: [last, 0.0], 1: [last, -1.0], 2: [last, 0.0], 3: None}


def test_blocks_of_reduced_vectors_that_do_not_divide(spark, vectors):
    assert same(spark, vectors, "embedding_reduce_scatter_sum") == 7 * 64


@pytest.mark.parametrize("name", [n for n in Q.QUERIES if n.startswith("embedding_")])
def test_null_and_short_vectors_are_filled_up_with_nulls(spark, tmp_path, name):
    v = np.random.default_rng(5).normal(0, 1, (27, 64)).astype("float32").tolist()
    rows = [(i, None if i in (3, 8, 26) else x[:0] if i == 12 else x[:60] if i == 14 else x) for i, x in enumerate(v)]
    spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    assert same(spark, str(tmp_path), name)
