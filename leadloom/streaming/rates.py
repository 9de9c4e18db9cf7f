"""Rate limits in fixed windows that begin with their first hit: a minute, an hour and a day for each organisation, user and operation.

A request counts in the minute; if that lets it pass in the hour, and then in the day; the first window that is full refuses
it, and later ones do not see it. A window opens with the first hit after the one before has ended. Times count by whole seconds, so
the hits of one key in one second are one row, with how many of them each window refused: what must be done in order is bounded by the
seconds of a key, not by its hits. The same step serves a table and a stream.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: The windows in the order in which they count, and their seconds.
WINDOWS = {"minute": 60, "hour": 3600, "day": 86400}
KEYS = ("org_id", "user_id", "operation")
#: What is kept of a key: for each window when it opened and how many hits it has seen.
STATE = ", ".join(f"{w}_start long, {w}_count long" for w in WINDOWS)
RESULT = "second long, hits long, allowed long, " + ", ".join(f"refused_{w} long" for w in WINDOWS)


def step(state: list[int], second: int, hits: int, limits: dict[str, int]) -> tuple[list[int], tuple[int, ...]]:
    """The state after the hits of a second, and (allowed, refused by each window). A state is start and count of each window; a count of 0 is no window."""
    after, passing, refused = [], hits, []
    for i, (window, seconds) in enumerate(WINDOWS.items()):
        start, count = state[2 * i : 2 * i + 2]
        if passing and (count == 0 or second >= start + seconds):
            start, count = second, 0
        through = max(0, min(passing, limits[window] - count))
        after += [start, count + passing]
        refused.append(passing - through)
        passing = through
    return after, (passing, *refused)


def _by_second(events: DataFrame) -> DataFrame:
    keyed = events.select("org_id", F.coalesce(F.col("user_id").cast("string"), F.lit("anonymous")).alias("user_id"), "operation", F.unix_seconds(F.col("created_at").cast("timestamp")).alias("second"))
    return keyed.filter("second IS NOT NULL")


def limited(events: DataFrame, limits: dict[str, int]) -> DataFrame:
    """(org_id, user_id, operation, second, hits, allowed, refused_minute, refused_hour, refused_day) of a table of events.

    Users that are null share the name anonymous, events without a time are left out, null organisations and operations are
    keys of their own. Hits are summed by second before they are dealt; a task then goes through its keys in order, with one state at hand.
    """
    seconds = _by_second(events).groupBy(*KEYS, "second").agg(F.count("*").alias("hits"))
    dealt = seconds.repartition(*KEYS).sortWithinPartitions(*KEYS, "second")
    names = [*KEYS, *(x.split()[0] for x in RESULT.split(", "))]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, [0] * 2 * len(WINDOWS)
        for batch in batches:
            out = []
            for *own, second, hits in zip(*(c.to_pylist() for c in batch.columns)):
                if own != key:
                    key, state = own, [0] * 2 * len(WINDOWS)
                state, verdict = step(state, second, hits, limits)
                out.append(verdict)
            verdicts = [pa.array(x, pa.int64()) for x in zip(*out)] if out else [pa.array([], pa.int64())] * (1 + len(WINDOWS))
            yield pa.RecordBatch.from_arrays([*batch.columns, *verdicts], names=names)

    fields = ", ".join(f"{k} {dealt.schema[k].dataType.simpleString()}" for k in KEYS)
    return dealt.mapInArrow(each, f"{fields}, {RESULT}")


def limited_stream(stream: DataFrame, limits: dict[str, int], late: str = "10 minutes") -> DataFrame:
    """The same rows as the events arrive, of a stream; a second whose hits come in several batches has a row for each.

    What comes later than another hit of its key counts at that hit's time. A key that is quiet for longer than the longest window
    is forgotten when the watermark, `late` behind the newest event, has passed that.
    """
    longest = max(WINDOWS.values())
    keyed = stream.withWatermark("created_at", late)
    seconds = keyed.select("created_at", "org_id", F.coalesce(F.col("user_id").cast("string"), F.lit("anonymous")).alias("user_id"), "operation")
    kinds = {f.name: f.dataType.simpleString() for f in seconds.schema.fields}

    def each(key: tuple, parts: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        if held.hasTimedOut:
            held.remove()
            return
        *state, last = held.get if held.exists else [0] * (2 * len(WINDOWS) + 1)
        times = pd.concat([p["created_at"] for p in parts]).dropna().astype("datetime64[us]").astype("int64") // 1_000_000
        rows = []
        for second, hits in times.clip(lower=last).value_counts().sort_index().items():
            state, verdict = step(list(state), int(second), int(hits), limits)
            last = int(second)
            rows.append((*key, last, int(hits), *verdict))
        held.update((*state, last))
        held.setTimeoutTimestamp(max((last + longest) * 1000, held.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(rows, columns=[*KEYS, *(x.split()[0] for x in RESULT.split(", "))])

    out = ", ".join(f"{k} {kinds[k]}" for k in KEYS) + ", " + RESULT
    return seconds.groupBy(*KEYS).applyInPandasWithState(each, out, f"{STATE}, last long", "append", GroupStateTimeout.EventTimeTimeout)
