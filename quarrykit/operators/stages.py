"""Stages of an ingest that go on where they stopped: each writes its rows once, failures are rows, and a run asks only for what is missing.

A stage's table is in ``path/<stage>``, a part for each attempt: Spark commits a part when all of its tasks are done, so that a run that is killed leaves whole parts or
none. A document that fails is kept with its error and stops only itself; a retry takes up failures alone.
"""

from collections.abc import Callable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

READY, FAILED, WAITING = "ready", "failed", "waiting"


class Stage(NamedTuple):
    """run takes the rows of the stage before (or the documents) and gives rows of the schema with the key and error, null where a document went well."""

    name: str
    run: Callable[[DataFrame], DataFrame]


def each_row(step: Callable[[dict], dict], key: str, schema: str) -> Callable[[DataFrame], DataFrame]:
    """A stage's run from a function of one row; what it raises becomes the row's error, with nulls for what it would have given."""

    def stage(df: DataFrame) -> DataFrame:
        kind = df.schema[key].dataType.simpleString()
        fields = [f.split()[0] for f in schema.split(",")]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out = []
                for row in batch.to_pylist():
                    try:
                        made = step(row)
                        out.append({key: row[key], **{f: made.get(f) for f in fields}, "error": None})
                    except Exception as e:  # one document's fault is its own row
                        out.append({key: row[key], **dict.fromkeys(fields), "error": f"{type(e).__name__}: {e}"})
                yield pa.RecordBatch.from_pylist(out, schema=arrow)

        from pyspark.sql.pandas.types import to_arrow_schema

        whole = f"{key} {kind}, {schema}, error string"
        arrow = to_arrow_schema(df.sparkSession.createDataFrame([], whole).schema)
        return df.mapInArrow(run, whole)

    return stage


def _written(spark: SparkSession, path: str) -> DataFrame | None:
    """A stage's table, or None if it has no part yet."""
    try:
        return spark.read.parquet(path)
    except AnalysisException:
        return None


def _latest(rows: DataFrame, key: str) -> DataFrame:
    others = [c for c in rows.columns if c not in (key, "attempt")]
    return rows.groupBy(key).agg(F.max_by(F.struct(*others, "attempt"), "attempt").alias("r")).select(key, "r.*")


def run_stages(docs: DataFrame, key: str, stages: list[Stage], path: str, retry: bool = False) -> DataFrame:
    """(key, status, stage, error) of all documents after the stages have run over what they had not done yet; status is ready after the last stage, failed
    where one went wrong, and stage names the last that took the document up. With retry, failed rows are done anew, and the stages after them."""
    spark = docs.sparkSession
    rows, states = docs, []
    for s in stages:
        where = f"{path.rstrip('/')}/{s.name}"
        done = _written(spark, where)
        attempt = 0 if done is None else (done.agg(F.max("attempt")).first()[0] or 0) + 1
        todo = rows
        if done is not None:
            latest = _latest(done, key)
            todo = rows.join((latest.filter("error IS NULL") if retry else latest).select(key), key, "left_anti")
        if done is None or todo.limit(1).count():
            s.run(todo).withColumn("attempt", F.lit(attempt)).write.mode("append").parquet(where)
        latest = _latest(spark.read.parquet(where), key)
        states.append(latest.select(key, F.lit(s.name).alias("stage"), "error"))
        rows = latest.filter("error IS NULL").drop("error", "attempt")
    out = docs.select(key).distinct()
    for i, state in enumerate(states):
        out = out.join(state.withColumnRenamed("stage", f"s{i}").withColumnRenamed("error", f"e{i}"), key, "left")
    n = len(states)
    error = F.coalesce(*(F.col(f"e{i}") for i in range(n)))
    last = F.coalesce(*(F.col(f"s{i}") for i in reversed(range(n))))
    status = F.when(error.isNotNull(), FAILED).when(F.col(f"s{n - 1}").isNotNull(), READY).otherwise(WAITING)
    return out.select(key, status.alias("status"), last.alias("stage"), error.alias("error"))


def results(spark: SparkSession, key: str, stage: str, path: str) -> DataFrame:
    """The rows that a stage has made of documents that went well."""
    return _latest(spark.read.parquet(f"{path.rstrip('/')}/{stage}"), key).filter("error IS NULL").drop("error", "attempt")

