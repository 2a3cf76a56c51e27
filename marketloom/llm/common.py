"""What the operators of this subpackage share: word rules, scratch tables, Arrow batches, rows carried whole."""

from __future__ import annotations

import atexit
import contextlib
import re
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of bytes other than the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"

_own_root: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def word_count(text: Column) -> Column:
    """Number of words as long; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def n_bytes(text: Column) -> Column:
    """UTF-8 bytes as long; 0 for null."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir; a temporary one where that is unset and all runs in one process."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return f"{shared.rstrip('/')}/{spark.sparkContext.applicationId}"
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not _own_root:
        _own_root.append(tempfile.mkdtemp(prefix="spark-"))
    return f"file://{_own_root[0]}"


#: Rows and bytes of the pieces of an Arrow batch that a function gets at once, so that what it makes of them stays small.
BATCH_ROWS, BATCH_BYTES = 1_000, 8 << 20


@contextlib.contextmanager
def _small_batches(spark: SparkSession) -> Iterator[None]:
    """While a table is written, Arrow batches have BATCH_ROWS rows and BATCH_BYTES bytes at most; the session's own limits come back."""
    names = {"spark.sql.execution.arrow.maxRecordsPerBatch": str(BATCH_ROWS), "spark.sql.execution.arrow.maxBytesPerBatch": str(BATCH_BYTES)}
    own = {k: spark.conf.get(k) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in own.items():
            spark.conf.set(k, v)


_written: dict[str, SparkSession] = {}


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts the lineage and survives lost executors.

    The files stay until release() or the end of the application, as the result of a query still reads them.
    """
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"
    with _small_batches(spark):
        df.write.parquet(path)
    _written[path] = spark
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def _delete(path: str) -> None:
    spark = _written.pop(path)
    try:
        place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
    except Exception:  # the session has ended first, or the folder is gone; what is left is the cluster's to clear
        pass


def release(*tables: DataFrame) -> None:
    """Delete tables of materialize() that nothing reads any more: what was made of them has been written itself."""
    for t in tables:
        _delete(t._written_to)


@atexit.register
def drop_scratch() -> None:
    """Delete every table that is left; called when the driver ends."""
    for path in list(_written):
        _delete(path)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        parts = max(1, -(-batch.num_rows // BATCH_ROWS), -(-batch.nbytes // BATCH_BYTES))
        step = max(1, -(-batch.num_rows // parts))
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)


def _returned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches; then what Arrow keeps for later goes back to the system, as an idle worker stays beside the next stages."""
    yield from batches
    pa.default_memory_pool().release_unused()


def map_arrow(df: DataFrame, each, schema) -> DataFrame:
    """mapInArrow() over small pieces of the session's batches."""
    return df.mapInArrow(lambda batches: _returned(each(_cut(batches))), schema)


def packed(docs: DataFrame, **more: Column) -> DataFrame:
    """All columns of docs in one, `row`, so that none of their names can meet one of ours, and more columns."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *[v.alias(k) for k, v in more.items()])


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
