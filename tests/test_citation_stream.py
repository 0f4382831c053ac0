"""Citations in a stream: cuts inside markers, late tails, what is known, against the same rule over whole texts."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from quarrykit.streaming import citations

WHOLE = "One [^c1] two [^2] three [^7] four [not] five [^C3][^c1] six [^c8] end [^c"
KNOWN = ["c1", "c2", "c3"]


def read(pieces):
    r = citations.Reader()
    text, found = "", []
    for i, p in enumerate(pieces):
        r = citations.Reader(r.state())  # as if it had been kept
        more, new = r.take(p, KNOWN if i == 0 else None)
        text, found = text + more, found + new
    return text + r.flush(), found


def test_cuts_do_not_matter():
    text, found = read([WHOLE])
    assert text == "One  two  three [^7] four [not] five  six  end [^c"
    assert found == [("c1", 4), ("c2", 9), ("c3", len("One  two  three [^7] four [not] five "))]
    for a in range(len(WHOLE)):
        for b in (a, a + 1, a + 3):
            assert read([WHOLE[:a], WHOLE[a:b], "", None, WHOLE[b:]]) == (text, found)


@pytest.mark.parametrize("size", [1, 5])
def test_stream(spark, tmp_path, size):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    begin = datetime(2024, 1, 1)
    pieces = [(m, i, begin + timedelta(seconds=i), WHOLE[i * size : (i + 1) * size], KNOWN if i == 0 else None) for m in ("a", "b") for i in range(-(-len(WHOLE) // size))]
    schema = "message string, seq int, at timestamp, piece string, known array<string>"
    source = str(tmp_path / "in")
    third = len(pieces) // 6
    cuts = [[p for p in pieces if k * third <= p[1] < (k + 1) * third or (k == 2 and p[1] >= 3 * third)] for k in range(3)]
    late = [("z", 0, begin + timedelta(hours=h), "x", None) for h in (2, 3)]  # moves the watermark on
    for k, rows in enumerate([*cuts, late[:1], late[1:]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{source}/part={k}")
    import os
    import time

    stream_files = sorted((os.path.join(d, f), d) for d, _, fs in os.walk(source) for f in fs if f.endswith(".parquet"))
    for k, (f, _) in enumerate(sorted(stream_files, key=lambda x: x[1])):
        os.utime(f, (time.time() - 100 + 10 * k,) * 2)  # files are read in this order
    stream = spark.readStream.schema(schema + ", part int").option("maxFilesPerTrigger", 1).parquet(source).drop("part").withWatermark("at", "1 second")
    out = stream.groupBy("message").transformWithStateInPandas(citations.CitationProcessor(), "message string, text string, marker string, char_offset long", "Append", "EventTime")
    name = f"cited{size}"
    q = out.writeStream.outputMode("append").format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    assert q.awaitTermination(200)
    got = spark.table(name).filter("message <> 'z'").collect()
    text, found = read([WHOLE])
    for m in ("a", "b"):
        own = [r for r in got if r["message"] == m]
        assert [(r["marker"], r["char_offset"]) for r in own if r["marker"]] == found
        assert "".join(r["text"] for r in own if r["text"]) == text  # the tail came out when its message had been silent
    batch = citations.cited(spark.createDataFrame(pieces, schema)).filter(F.col("message") == "a").orderBy("char_offset").collect()
    assert [(r["marker"], r["char_offset"]) for r in batch] == found and {r["text"] for r in batch} == {text}
