"""Helpers that the operators of this package share."""

import atexit
import ctypes
import functools
import gc
import re
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, as a character class of a Java or Python pattern; all else is part of a word.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def lean(run):
    """A function over Arrow batches that gives back what this worker no longer uses, before it begins and after it ends: workers live on from stage to stage."""

    @functools.wraps(run)
    def out(batches):
        freed()
        try:
            yield from run(batches)
        finally:
            freed()

    return out


def lean_group(run):
    """lean() for a function from a group's table to a table."""

    @functools.wraps(run)
    def out(group):
        try:
            return run(group)
        finally:
            freed()

    return out


#: What lets go of tables that modules hold in a worker; freed() calls each.
LET_GO: list = []


def freed() -> None:
    for let_go in LET_GO:
        let_go()
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only the GNU library has it
    if trim:
        trim(0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_count(text: Column) -> Column:
    """Number of words as a long; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def words(text: Column) -> Column:
    """The words in order; empty for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE + "+"), "")


def shared_dir(spark: SparkSession) -> str:
    """A fresh path in the folder that driver and executors share (spark.checkpoint.dir).

    Where that is unset a local session gets a temporary folder, as in tests; on a cluster RuntimeError is raised, since executors would write to disks
    that others don't see.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="quarrykit-")
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base.rstrip('/')}/quarrykit-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def _remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    if jvm is None or spark.sparkContext._jsc is None:
        return
    try:
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session may have ended before the interpreter does
        return


def materialize(df: DataFrame, *by: str) -> DataFrame:
    """Cut the lineage: write df as Parquet in the shared folder, in folders by the values of columns if asked for, and read it back."""
    spark = df.sparkSession
    path = shared_dir(spark)
    df.write.partitionBy(*by).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Keys that joined() sends to every task, at most; each of them holds more than one HOT_KEYS-th of the rows.
HOT_KEYS = 2000
#: Rows of a small table that few() sends to every task at most.
SENT_ROWS = 500_000


def joined(rows: DataFrame, table: DataFrame, keys: list[str], total: int, how: str = "left") -> DataFrame:
    """rows joined with table(*keys, times, ...), which has at most one row for each value of the keys (never null); times goes.

    times is the number of rows that have the key, and total that of all rows. Keys that hold more than one HOT_KEYS-th of the rows, so fewer than
    HOT_KEYS, are sent to every task; the rows of all others are shuffled, and those of hot keys are dealt among them by a hash of all columns.
    """
    table = materialize(table)  # else Spark may keep the table's partitions by the keys alone, which deals no hot key out
    values = [c for c in table.columns if c not in {*keys, "times"}]
    hot = F.col("times") * HOT_KEYS > total
    first = F.broadcast(table.filter(hot).select(*keys, F.struct(*values).alias("__hot")))
    rows = rows.join(first, keys, "left")
    dealt = F.when(F.col("__hot").isNull(), F.lit(0)).otherwise(F.lit(1) + F.pmod(F.xxhash64(*(F.col(f.name) for f in rows.schema if f.dataType.typeName() in SIMPLE)), F.lit(1 << 30)))
    others = table.filter(~hot).select(*keys, F.struct(*values).alias("__cold")).withColumn("__dealt", F.lit(0).cast("long"))
    out = rows.withColumn("__dealt", dealt.cast("long")).join(others, [*keys, "__dealt"], "left").withColumn("__found", F.coalesce("__hot", "__cold"))
    out = out.filter(F.col("__found").isNotNull()) if how == "inner" else out
    return out.select(*(c for c in rows.columns if c != "__hot"), *(F.col(f"__found.{v}").alias(v) for v in values))


#: Types whose values joined() hashes.
SIMPLE = frozenset("long integer short byte string double float boolean binary date timestamp timestamp_ntz".split())


def looked_up(rows: DataFrame, table: DataFrame, keys: list[str], total: int) -> DataFrame:
    """joined() for a table that is mostly small: one of SENT_ROWS rows or fewer goes to every task whole."""
    table = materialize(table)
    return rows.join(F.broadcast(table.drop("times")), keys, "left") if table.count() <= SENT_ROWS else joined(rows, table, keys, total)


def few(df: DataFrame, most: int = SENT_ROWS) -> DataFrame:
    """df written and read again, sent to every task by joins where it has no more than ``most`` rows."""
    df = materialize(df)
    return F.broadcast(df) if df.count() <= most else df
