"""The registry that query modules fill."""

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function (spark, sf_dir) -> DataFrame under its name, with the SQL that gives the same rows."""

    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


#: Events with integer times and properties, for SQL.
EVENTS = "(SELECT event_id, user_id, event_type, value, epoch_us(ts) // 1000 AS ts_ms, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)"
