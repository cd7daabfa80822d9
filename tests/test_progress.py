import random
from datetime import datetime, timedelta

from lodestar.streaming import progress

SCHEMA = "run long, place long, ts timestamp, node string, payload string"
START = datetime(2024, 1, 1)


def events():
    """Runs that are named and finished, silent, unnamed, and of one event."""
    out = []
    for run in range(30):
        nodes = ["extract", *["work"] * (run % 5), "close"][: None if run % 3 else -1]
        nodes = nodes[1:] if run % 7 == 3 else nodes
        out += [(run, k, START + timedelta(seconds=20 * run + k), n, f"name {run}" if n == "extract" else None) for k, n in enumerate(nodes)]
    return out


def streamed(spark, rows, tmp_path, order, name):
    r = random.Random(order)
    rows = list(rows)
    r.shuffle(rows)
    folder = f"file://{tmp_path}/in{order}"
    # small files of shuffled events, then two of one far event each that moves the watermark on
    parts = [rows[i : i + 9] for i in range(0, len(rows), 9)] + [[(-1, k, START + timedelta(days=9 + k), "work", None)] for k in range(2)]
    for part in parts:
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(folder)
    source = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)
    made = progress.messages(source, "extract", "close", silence_ms=60_000, late="2 days")
    query = made.writeStream.outputMode("append").format("memory").queryName(name).option("checkpointLocation", f"file://{tmp_path}/c{order}").start()
    query.processAllAvailable()
    query.stop()
    return sorted(map(tuple, spark.table(name).where("run >= 0").collect()), key=repr)


def test_messages_in_any_order_of_arrival_equal_the_table(spark, tmp_path):
    rows = events()
    want = sorted(map(tuple, progress.all_messages(spark.createDataFrame(rows, SCHEMA), "extract", "close").collect()), key=repr)
    assert len({w[0] for w in want if w[2] == "end"}) == len({r[0] for r in rows})
    for order in (1, 2):
        got = streamed(spark, rows, tmp_path, order, f"told{order}")
        assert got == want
    reasons = {w[0]: (w[4], w[6]) for w in want if w[2] == "end"}
    assert reasons[1] == ("name 1", "finished") and reasons[3] == (None, "silent") and reasons[10][0] is None


def test_no_events(spark):
    assert progress.all_messages(spark.createDataFrame([], SCHEMA), "a", "b").count() == 0
