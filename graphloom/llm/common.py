"""Helpers that several training-data operators share."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"

#: Byte tables for the two word rules of the contracts. A byte above 0x7F is always part of a word.
_SPACES = b" \t\n\x0b\x0c\r"
ALNUM_WORDS = bytes(
    (b + 32 if 0x41 <= b <= 0x5A else b) if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256)
)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only a local session, where driver and executors are one process, may go without that setting; it then gets a
    temporary folder of its own.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    path = "file://" + tempfile.mkdtemp(prefix="graphloom-")
    spark.conf.set("spark.checkpoint.dir", path)
    return path


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` under the shared folder and read it again: lineage ends there, and a lost executor costs nothing.

    The table lives until the driver's Python ends, since the frame that comes back is lazy.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    cleanup = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    old = spark.conf.get(cleanup, "false")
    spark.conf.set(cleanup, "true")  # the plan runs once, so its shuffle files go as soon as it ends
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(cleanup, old)
    atexit.register(_remove, spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def discard(df: DataFrame) -> None:
    """Delete a table that ``materialise`` wrote and that nothing will read again."""
    _remove(df.sparkSession, df._written_at)


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(conf).delete(target, True)
    except Exception:  # noqa: BLE001 - the session may be gone; the folder is temporary anyway
        return


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once a row, although ``body`` uses it often or inside lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def add_columns(df: DataFrame, fields, make) -> DataFrame:
    """``df`` and the columns that ``make(record_batch)`` returns, in Arrow batches, without a shuffle.

    A column of ``df`` that has the name of a new one is replaced by it.
    """
    import pyarrow as pa
    from pyspark.sql import types as T

    new = T.StructType.fromDDL(fields) if isinstance(fields, str) else fields
    names = {f.name.lower() for f in new}
    kept = df.select([f"`{c}`" for c in df.columns if c.lower() not in names])
    schema = T.StructType(kept.schema.fields + new.fields)
    out_names = schema.names

    def run(batches):
        for whole in batches:
            for batch in slices(whole):
                yield pa.RecordBatch.from_arrays([*batch.columns, *make(batch)], names=out_names)

    return kept.mapInArrow(trimmed(run), schema)


def packed(df: DataFrame, *names: str) -> DataFrame:
    """The whole row of ``df`` as ``_docs``, and the named columns: operators cannot clash with its other columns."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_docs"), *[F.col(f"`{n}`") for n in names])


def unpacked(df: DataFrame, columns: list[str], changed: Column) -> DataFrame:
    """The rows that ``packed`` took, with the text of ``df``; ``n_chars`` is counted anew where the text changed."""
    out = []
    for c in columns:
        old = F.col("_docs")[c]
        new = F.col("text") if c == "text" else F.when(changed, F.length("text").cast("long")).otherwise(old) if c == "n_chars" else old
        out.append(new.alias(c))
    return df.select(*out)


def trimmed(run):
    """``run`` over batches, after which the worker gives back memory that it no longer uses: workers live on from stage
    to stage, and allocators keep what a stage took."""

    def whole(batches):
        import ctypes

        import pyarrow as pa

        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # not every C library can trim
                ctypes.CDLL(None).malloc_trim(0)

    return whole


def free_name(df: DataFrame, name: str) -> str:
    """A column name like ``name`` that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name = f"_{name}"
    return name


def slices(batch, rows: int = 512):
    """``batch`` in parts, so that few texts at a time are held as Python values."""
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def utf8(batch, name: str) -> list:
    """The texts of a batch as bytes, null as empty."""
    import pyarrow as pa

    return [x or b"" for x in batch.column(name).cast(pa.binary()).to_pylist()]
