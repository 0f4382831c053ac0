"""Writes as table-to-table functions: a new version of a table is a DataFrame, made durable by an atomic overwrite of its partition."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def insert_ignore(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """table plus the rows whose key it lacks, each key once."""
    return table.unionByName(rows.dropDuplicates(keys).join(table.select(*keys), keys, "left_anti").select(*table.columns))


def upsert(table: DataFrame, rows: DataFrame, keys: list[str], version: str, keep: list[str] = ()) -> DataFrame:
    """The newest row of each key by version, rows before table on a tie; columns in keep stay as they are in table where it has the key."""
    both = table.withColumn("__new", F.lit(0)).unionByName(rows.withColumn("__new", F.lit(1)))
    w = Window.partitionBy(*keys)
    for c in keep:
        both = both.withColumn(c, F.coalesce(F.max(F.when(F.col("__new") == 0, F.col(c))).over(w), F.col(c)))
    newest = F.row_number().over(w.orderBy(F.desc("__new"), F.desc(version)))
    return both.withColumn("__r", newest).filter("__r = 1").select(*table.columns)


def close_versions(history: DataFrame, keys: list[str], since: str, tie: str) -> DataFrame:
    """Slowly changing rows with version numbers from 1 and valid_to, the start of the next version (null for the current one)."""
    w = Window.partitionBy(*keys).orderBy(since, tie)
    return history.withColumns({"version": F.row_number().over(w), "valid_to": F.lead(since).over(w)})


def delete_where_key(table: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return table.join(gone.select(*keys).distinct(), keys, "left_anti")


def partial_update(table: DataFrame, condition: Column, values: dict[str, Column]) -> DataFrame:
    return table.withColumns({c: F.when(condition, v).otherwise(F.col(c)) for c, v in values.items()})


def write_partition(df: DataFrame, path: str, by: list[str]) -> None:
    """Overwrite only the partitions that df has rows of."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)
