"""Helpers that the corpus operators share: table access, shared storage, Arrow batching."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Words are maximal runs of anything but the six ASCII white-space characters.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"

#: Rows and bytes in one Arrow batch: small, as a text may be megabytes long.
BATCH_ROWS, BATCH_BYTES = 512, 16 << 20


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Table ``name`` of the folder; the session's Arrow batches are kept small from here on, as results are lazy."""
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches by rows and, where Spark knows the setting, by bytes."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Where that is unset a folder of our own is made, which is right in local mode only.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="rankmesh-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


#: Folders of the work at hand that nothing reads once it is done; the innermost work last.
_SCRATCH: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """What is written in here is deleted at the end, but for what is to be kept: for work whose result holds no plan over it."""
    _SCRATCH.append([])
    try:
        yield
    finally:
        for path in _SCRATCH.pop():
            discard(spark, path)


def discard(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def new_folder(spark: SparkSession, name: str, keep: bool = False) -> str:
    """A path in the shared folder that nothing has; deleted after the work at hand unless it is to be kept."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if _SCRATCH and not keep:
        _SCRATCH[-1].append(path)
    return path


def written(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """Cut the lineage: write ``df`` to the shared folder and read it again.

    A lost executor then costs only its own tasks, and a row that depends on the
    order of rows (an assigned number, a random draw) stays as it was written.
    ``keep``: see ``scratch``.
    """
    spark = df.sparkSession
    path = new_folder(spark, name, keep)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def plus(df: DataFrame, *new: tuple[str, str]) -> T.StructType:
    """The schema of ``df`` with further columns (name, type)."""
    return T.StructType([*df.schema.fields, *(T.StructField(n, T._parse_datatype_string(t)) for n, t in new)])


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def fold(name: str, parts: int) -> Column:
    """crc32 of the id written as text, modulo ``parts``; null where the id is null."""
    return F.crc32(F.col(name).cast("string").cast("binary")) % parts


def sample_ids(rows: DataFrame, most: int) -> DataFrame:
    """Rows (doc_id): the ``most`` different ids with the smallest hashes, or all if there are fewer, however rows are partitioned.

    Where there are many more, ids with large hashes go first, so that the final
    sort is over about twice as many as it keeps, whatever the table's size. How
    large follows the number of different ids, not of rows, and is doubled until
    enough are there. A null id is an id like any other.
    """
    mark, ids = F.xxhash64("doc_id"), rows.select("doc_id")
    share = 2 * most / max(ids.agg(F.approx_count_distinct("doc_id")).first()[0], 1)
    while share < 1:
        few = written(ids.filter(mark < int((share - 0.5) * 2**64)).distinct(), "sample-ids")
        if few.count() >= most:
            return few.orderBy(mark, "doc_id").limit(most)
        share *= 2
    return ids.distinct().orderBy(mark, "doc_id").limit(most)


def free(docs: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores after it as make it none of the columns of ``docs``."""
    taken, out = {c.lower() for c in docs.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def columns(docs: DataFrame) -> list[Column]:
    """The columns of ``docs``, whatever their names hold."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in docs.columns]


def partitions(spark: SparkSession, size: int, rows: int = 0) -> int:
    """How many partitions to deal ``size`` bytes out to: the session's number, or more where each would get over 64 MB or 2 million rows."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // (64 << 20)), -(-rows // 2_000_000))


def words_of(text: str) -> list[bytes]:
    """Words as UTF-8 with A-Z in lower case.

    ``bytes.split`` splits at just the six ASCII white-space characters and
    ``bytes.lower`` changes A-Z alone, as the word definition asks.
    """
    return text.encode().lower().split()


def chunks(batches: Iterable[pa.RecordBatch], text: str, most: int) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each holds about ``most`` bytes of text, or one longer row."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        col = batch.column(batch.schema.get_field_index(text))
        sizes = pc.fill_null(pc.binary_length(col), 0).to_pylist()
        begin, held = 0, 0
        for i, size in enumerate(sizes):
            if held and held + size > most:
                yield batch.slice(begin, i - begin)
                begin, held = i, 0
            held += size
        yield batch.slice(begin)
