"""Hold a query's rows against those that its SQL gives in DuckDB."""

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    c = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{sf_dir}/{t}.parquet"):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def rows(frame) -> list[tuple]:
    def plain(x):
        if x is None or str(x) in ("<NA>", "NaT", "nan"):
            return "NULL"
        if isinstance(x, bool) or type(x).__name__ == "bool":
            return str(bool(x))
        try:
            return f"{float(x):.6g}" if not math.isinf(float(x)) else str(x)
        except (TypeError, ValueError):
            return str(x)

    frame = frame[sorted(frame.columns)]
    return sorted(tuple(plain(x) for x in r) for r in frame.itertuples(index=False))
