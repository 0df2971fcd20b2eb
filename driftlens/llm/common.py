"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import gc
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftlens.session import cut_lineage

#: A word is a maximal run without ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new folder beside the checkpoints, visible to every executor."""
    base = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getCheckpointDir()
    if not base:
        cut_lineage(spark.range(1))
        base = spark.sparkContext.getCheckpointDir()
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back: cuts lineage, survives lost executors.

    The shuffle files of the step are dropped once its rows are safe.
    """
    spark = df.sparkSession
    path, before = shared_path(spark, name), spark.conf.get(CLEAN, "false")
    spark.conf.set(CLEAN, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEAN, before)
    gc.collect()
    return spark.read.schema(df.schema).parquet(path)


HELD: dict = {}


def held(key, build):
    """The one model a Python worker keeps: another one takes its place, so what the stages of an application load does not add up."""
    if key not in HELD:
        HELD.clear()
        HELD[key] = build()
    return HELD[key]


def crc_class(column: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; NULL ids count as empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")), F.lit(modulus))


def raw(array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and n + 1 offsets of an Arrow string or binary column; NULL is empty."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
        if isinstance(array, pa.ChunkedArray):
            array = array.chunk(0) if array.num_chunks else pa.array([], array.type)
    array = array.cast(pa.large_binary())
    if array.null_count:
        array = array.fill_null(b"")
    _, offsets, data = array.buffers()
    if not len(array) or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, np.int64, len(array) + 1, array.offset * 8)
    every = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return every[at[0]: at[-1]], at - at[0]


def slices(batches, column: str, most: int = 4 << 20):
    """Cut record batches into pieces of about ``most`` bytes of ``column``; one row is never cut."""
    for batch in batches:
        _, at = raw(batch.column(batch.schema.get_field_index(column)))
        first = 0
        while first < batch.num_rows:
            last = max(first + 1, int(np.searchsorted(at, at[first] + most, "right")) - 1)
            yield batch.slice(first, last - first)
            first = last


def arrow_schema(df: DataFrame, ddl: str):
    """Spark schema string and the Arrow schema the Python side returns."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return ddl, to_arrow_schema(StructType.fromDDL(ddl))
