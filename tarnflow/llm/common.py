"""Helpers shared by the corpus operators: table access and tables in the shared folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Bytes of a batch that goes to a Python worker; a longer row goes alone.
BATCH_BYTES = 1 << 22
BATCHES = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Bits of the filter by which :func:`apart` lets rows pass unshuffled; they do not change what it finds.
PASS_BITS = 1 << 23


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data folder, as a lazily read DataFrame."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    Only where the session names none and all runs on one machine (unit tests) a temporary
    folder is made; on a cluster its executors would not share it, so that is an error.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", "")
    if not named:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="tarnflow-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def materialize(df: DataFrame, label: str, compression: str = "zstd") -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    This cuts the lineage with a table that outlives any executor and lets
    several consumers share one computation.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    written = spark.read.schema(df.schema).parquet(path)
    written.written_to = path
    return written


def discard(*tables: DataFrame) -> None:
    """Delete tables that :func:`materialize` wrote, once nothing lazy reads them any more."""
    for df in tables:
        context = df.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(df.written_to)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def map_batches(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterable[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """``mapInArrow`` with batches bounded by bytes, so that memory does not follow the length of texts."""
    df.sparkSession.conf.set(BATCHES, str(BATCH_BYTES))
    return df.mapInArrow(run, schema)


def unused(name: str, taken: Iterable[str]) -> str:
    """``name``, with underscores before it until no column has it."""
    held = {t.lower() for t in taken}
    while name.lower() in held:
        name = f"_{name}"
    return name


def _hits(rows: DataFrame, key: str, some: DataFrame, seed: int) -> tuple[DataFrame, DataFrame]:
    """Rows whose ``key`` is not in ``some`` for certain, and those whose bit is set in a bitmap of fixed size over ``some``."""
    word, bits = unused("_word", rows.columns), unused("_bits", rows.columns)
    slot = F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(PASS_BITS))
    place = F.pmod(slot, F.lit(64)).cast("int")
    packed = some.select(F.shiftright(slot, 6).alias(word), F.call_function("shiftleft", F.lit(1).cast("long"), place).alias(bits)).groupBy(word).agg(F.bit_or(bits).alias(bits))
    marked = rows.withColumn(word, F.shiftright(slot, 6)).join(F.broadcast(packed), word, "left")
    hit = F.coalesce(F.getbit(F.col(bits), place), F.lit(0)) == 1
    passed, met = (marked.where(c).select(*rows.columns) for c in (~hit, hit))
    return passed, met


def apart(rows: DataFrame, key: str, some: DataFrame, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """Rows whose ``key`` is not in ``some`` (a table with that column), and those whose is; a null key is in none.

    A bitmap of fixed size lets most of the former pass as they lie; only rows whose bit is set are
    shuffled, and the joins with these are exact, however full the bitmap is.
    """
    passed, met = _hits(rows, key, some, seed)
    return passed.unionByName(met.join(some, key, "left_anti")), met.join(some, key, "left_semi")


def without(rows: DataFrame, key: str, some: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The first part of :func:`apart`, and a table that it reads.

    Keys that share a bit with others are found first, without the rest of their rows, and rows that
    go are told from them by a second bitmap: they are not shuffled to be dropped.
    """
    passed, met = _hits(rows, key, some, 0)
    spared = materialize(met.select(key).where(F.col(key).isNotNull()).distinct().join(some, key, "left_anti"), "apart-spared")
    nulls = met.where(F.col(key).isNull())
    return passed.unionByName(nulls).unionByName(apart(met, key, spared, seed=1)[1]), spared
