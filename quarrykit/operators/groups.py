"""Sequential steps along small groups, many groups to an Arrow batch."""

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema

#: Rows that a batch gives at most, and rows of a part that dealt() aims at.
ROWS, PART_ROWS = 4096, 500_000


def dealt(df: DataFrame, by: list[str], rows: int = PART_ROWS) -> DataFrame:
    """df dealt out by the columns in parts of about ``rows`` rows, one at least: what a task then holds to group, sort or join by them doesn't grow with the table.
    Groupings and joins by these columns need no further shuffle."""
    return df.repartition(max(1, -(-df.count() // rows)), *by)


def along_groups(df: DataFrame, by: list[str], order: list, step: Callable[[list[dict]], list[dict]], schema: str) -> DataFrame:
    """The rows that step gives for the rows of each group in order; groups are those of a query or a message, small by nature.

    Rows are dealt out by the group and sorted, and groups follow one another in a task, so that none costs a batch of its own.
    """
    keys, out = list(by), to_arrow_schema(df.sparkSession.createDataFrame([], schema).schema)

    def run(batches):
        group: list[dict] = []
        done: list[dict] = []
        for batch in batches:
            for row in batch.to_pylist():
                if group and any(group[0][k] != row[k] for k in keys):
                    done += step(group)
                    group = []
                    if len(done) >= ROWS:
                        yield pa.RecordBatch.from_pylist(done, schema=out)
                        done = []
                group.append(row)
        done += step(group) if group else []
        if done:
            yield pa.RecordBatch.from_pylist(done, schema=out)

    return df.repartition(*by).sortWithinPartitions(*by, *order).mapInArrow(run, schema)
