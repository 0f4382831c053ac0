"""Loaders: the tables of a directory, normalised where engines differ."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A Parquet table; event times as integer milliseconds since 1970 (UTC) in ts_ms, event properties as the integer k."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    if name == "events":
        df = df.withColumn("ts_ms", F.unix_millis(F.col("ts").cast("timestamp"))).withColumn("k", F.get_json_object("props", "$.k").cast("long"))
    return df


def read_text_documents(spark: SparkSession, path: str) -> DataFrame:
    """Whole text files as (uri, text) with line ends as \\n and outer white space gone."""
    df = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("uri"), F.col("value").alias("text"))
    return df.withColumn("text", F.regexp_replace(F.regexp_replace("text", r"\r\n?", "\n"), r"^\s+|\s+$", ""))


def jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines under an explicit schema; a broken line gives a row of nulls."""
    return spark.read.schema(schema).json(path)
