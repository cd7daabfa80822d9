"""The progress of runs as a stream: windowed counts with a bound on lateness, and messages of runs that are kept in state."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def read_events(spark: SparkSession, folder: str, files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_per_trigger).option("pathGlobFilter", "*.parquet").parquet(folder)


def windowed(events: DataFrame, length: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """``start``, ``event_type``, ``n`` and ``total``; works on a stream and on a table alike."""
    kept = events.withWatermark("ts", late) if events.isStreaming else events
    counted = kept.groupBy(F.window("ts", length), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return counted.select(F.col("window.start").alias("start"), "event_type", "n", "total")


def threads(events: DataFrame, order: str = "ts") -> DataFrame:
    """The last event of each user, as a progress display shows it."""
    return events.groupBy("user_id").agg(F.max_by("event_type", F.struct(order, "event_id")).alias("last"), F.count(F.lit(1)).alias("steps"))


MESSAGE = "run long, place long, kind string, node string, name string, steps long, reason string"
_STATE = "held string, name string, steps long, latest long, finished boolean"


def messages(events: DataFrame, first: str, last: str, silence_ms: int, late: str = "1 hour") -> DataFrame:
    """What a progress display is told of runs whose events come in any order, from a stream of ``run``, ``place``, ``ts``, ``node``
    and ``payload``: ``kind`` is ``node`` for an event and ``end`` once a run.

    A run is named by the payload of its node ``first``. Events that come before it are held and told, in their order, once the
    name is known; a run that ends unnamed tells them without. A run ends once the watermark has passed its node ``last``, or
    ``silence_ms`` after its latest event; what comes later is dropped, as the watermark drops it. ``end`` tells the number of
    steps and whether the run was ``finished`` or ``silent``. The state of a run is its name, three numbers and the events held."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def told(run: int, rows: list[tuple[int, str]], name: str | None) -> list[tuple]:
        return [(run, place, "node", node, name, None, None) for place, node in sorted(rows)]

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        run = int(key[0])
        held, name, steps, latest, finished = state.get if state.exists else ("[]", None, 0, 0, False)
        waiting, out = [tuple(x) for x in json.loads(held)], []
        if state.hasTimedOut:
            out += told(run, waiting, name)
            out.append((run, None, "end", None, name, int(steps), "finished" if finished else "silent"))
            state.remove()
        else:
            for frame in frames:
                for place, ts, node, payload in zip(frame["place"], frame["ts"], frame["node"], frame["payload"], strict=True):
                    waiting.append((int(place), node))
                    steps, latest = steps + 1, max(latest, int(ts.timestamp() * 1000))
                    finished = finished or node == last
                    if node == first and name is None:
                        name = payload
            if name is not None:
                out += told(run, waiting, name)
                waiting = []
            state.update((json.dumps(waiting), name, steps, latest, finished))
            state.setTimeoutTimestamp(max(latest + (0 if finished else silence_ms), state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in MESSAGE.split(", ")])

    rows = events.select("run", "place", "ts", "node", "payload").withWatermark("ts", late)
    return rows.groupBy("run").applyInPandasWithState(step, MESSAGE, _STATE, "append", GroupStateTimeout.EventTimeTimeout)


def all_messages(events: DataFrame, first: str, last: str) -> DataFrame:
    """:func:`messages` of a table: all events told, each run ended."""
    named = events.where(F.col("node") == first).groupBy("run").agg(F.min("payload").alias("name"))  # one event a run
    ends = events.groupBy("run").agg(F.count(F.lit(1)).alias("steps"), F.max((F.col("node") == last).cast("int")).alias("finished"))
    nodes = events.join(named, "run", "left").select("run", "place", F.lit("node").alias("kind"), "node", "name", F.lit(None).cast("long").alias("steps"), F.lit(None).cast("string").alias("reason"))
    none = F.lit(None)
    ended = ends.join(named, "run", "left").select("run", none.cast("long"), F.lit("end"), none.cast("string"), "name", "steps", F.when(F.col("finished") == 1, "finished").otherwise("silent"))
    return nodes.union(ended)
