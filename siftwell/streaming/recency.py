"""Which captures of a running feed are worth a fetch: keyed state with timers, late rows beside.

A row has the time of the capture (ts) and the time it arrived. It is

* ``late`` if it arrived over ``lateness`` after its capture: such rows have no say and go to an output of their own;
* ``recent`` if its page (service, canonical URL) was fetched less than ``window`` before its capture;
* ``fetch`` otherwise.

Rows of a page are judged in order of arrival (then capture, then number). The only state is the capture time of a page's last fetch. It is given up by a timer once the arrival
clock has passed it by window and lateness: a later row is late or begins a new window, so results don't depend on how
the feed is cut into batches, and the state is bounded by the pages fetched within that time. The watermark is on arrival times, which
a feed brings in order, up to ``disorder``.

A state call costs about as much for one page as for hundreds, so pages are dealt by hash into ``buckets``, each with the times of its pages as
one state and one timer. A feed of very many pages takes more of them; a stored log keeps the number it was begun with.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from siftwell.operators.urls import canonical

JUDGED = "service string, canon string, number long, ts timestamp, arrived timestamp, status string"
STATE = "services array<string>, canons array<string>, times array<long>"
#: Groups into which the pages of a feed are dealt.
BUCKETS = 512


def canonical_stream(stream: DataFrame, url: str = "url") -> DataFrame:
    return stream.withColumn("canon", canonical(F.col(url)))


def timed(stream: DataFrame) -> DataFrame:
    """With both times as instants."""
    return stream.withColumn("ts", F.col("ts").cast("timestamp")).withColumn("arrived", F.col("arrived").cast("timestamp"))


def is_late(lateness: str) -> Column:
    return F.col("arrived") > F.col("ts") + F.expr(f"INTERVAL {lateness}")


def judged(stream: DataFrame, window: str, lateness: str, disorder: str = "0 seconds", buckets: int = BUCKETS) -> DataFrame:
    """(JUDGED) of stream (service, canon, number, ts, arrived); late rows are told from the row alone and pass no state."""
    long, wait = (int(pd.Timedelta(x.lower()).total_seconds() * 1000) for x in (window, lateness))

    def step(key: tuple[Any, ...], parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.getCurrentWatermarkMs()
        services, canons, times = state.get if state.exists else ([], [], [])
        last = dict(zip(zip(services, canons), times))
        if not state.hasTimedOut:
            rows = pd.concat(list(parts)).sort_values(["arrived", "ts", "number"], kind="stable")
            said = []
            for page, ms in zip(zip(rows["service"].tolist(), rows["canon"].tolist()), rows["ms"].tolist()):
                before = last.get(page)
                if before is None or ms >= before + long:
                    last[page] = ms
                    said.append("fetch")
                else:
                    said.append("recent")
            yield rows[["service", "canon", "number", "ts", "arrived"]].assign(status=said)
        last = {page: ms for page, ms in last.items() if ms + long + wait >= now}
        if last:
            state.update(([s for s, _ in last], [c for _, c in last], list(last.values())))
            state.setTimeoutTimestamp(max(min(last.values()) + long + wait, now) + 1)
        elif state.exists:
            state.remove()

    timely = timed(stream).filter(~is_late(lateness)).withColumn("ms", F.unix_millis("ts")).withColumn("bucket", F.pmod(F.xxhash64("service", "canon"), F.lit(buckets))).withWatermark("arrived", disorder)
    return timely.groupBy("bucket").applyInPandasWithState(step, JUDGED, STATE, "append", GroupStateTimeout.EventTimeTimeout)


def write_judged(stream: DataFrame, path: str, log: str, window: str, lateness: str, disorder: str = "0 seconds", buckets: int = BUCKETS) -> list:
    """Start the two outputs: judged rows in ``<path>/judged``, late ones in ``<path>/late``; each has a log of its own and takes up where it stopped."""
    late = timed(stream).filter(is_late(lateness)).select("service", "canon", "number", "ts", "arrived", F.lit("late").alias("status"))
    out = []
    for name, rows in (("judged", judged(stream, window, lateness, disorder, buckets)), ("late", late)):
        out.append(rows.writeStream.format("parquet").option("path", f"{path}/{name}").option("checkpointLocation", f"{log}/{name}").outputMode("append").trigger(availableNow=True).start())
    return out
