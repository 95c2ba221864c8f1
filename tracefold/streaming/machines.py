"""The batch machines on streams: sessions, windowed counts, dead band and hysteresis with state and timeouts."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState

from tracefold.operators.machines import Hysteresis, _Open, dead_band_start, dead_band_step, hysteresis_end, hysteresis_step


def windowed_counts(events: DataFrame, time: str, key: str, width: str, late: str) -> DataFrame:
    """Tumbling counts; windows are final once the watermark, ``late`` behind, has passed them."""
    return events.withWatermark(time, late).groupBy(F.window(time, width), key).agg(F.count(F.lit(1)).alias("n")).select(key, F.col("window.start").alias("start"), F.col("window.end").alias("end"), "n")


def deliver_once(events: DataFrame, key: str, time: str, late: str) -> DataFrame:
    """Repeated deliveries dropped within the watermark."""
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def stream_sessions(events: DataFrame, time: str, key: str, gap: str, late: str) -> DataFrame:
    return events.withWatermark(time, late).groupBy(F.session_window(time, gap), key).agg(F.count(F.lit(1)).alias("n")).select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def stream_dead_band(rows: DataFrame, keys: list[str], order: str, columns: list[str], width: float = 5.0, exact_width: float = 2.0) -> DataFrame:
    """The dead band on a stream, by the step function of the batch operator; rows of one trigger are put in order."""
    schema = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys) + ", id string, track int"
    names = [*keys, "id", "track"]

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = pickle.loads(state.get[0]) if state.exists else dead_band_start()
        batch = pd.concat(list(batches)).sort_values(order)
        batch = batch.astype(object).where(batch.notna(), None)
        out = [(*key, *x) for row in batch[columns].itertuples(index=False, name=None) for x in dead_band_step(held, row, width, exact_width)]
        state.update((pickle.dumps(held),))
        yield pd.DataFrame(out, columns=names)

    return rows.groupBy(*keys).applyInPandasWithState(run, schema, "held binary", "append", "NoTimeout")


def stream_hysteresis(samples: DataFrame, keys: list[str], pos: str, level: str, config: Hysteresis, quiet_ms: int = 0) -> DataFrame:
    """Finished segments on a stream; with ``quiet_ms`` an entity that stays quiet so long is closed by a timeout."""
    schema = ", ".join(f"`{k}` {samples.schema[k].dataType.simpleString()}" for k in keys) + ", first long, last long, hits long, reason string"
    names = [*keys, "first", "last", "hits", "reason"]

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, at = pickle.loads(state.get[0]) if state.exists else (_Open(), None)
        out = []
        if state.hasTimedOut:
            out = [(*key, *s) for s in hysteresis_end(held)]
            state.remove()
        else:
            for p, lv in pd.concat(list(batches)).sort_values(pos)[[pos, level]].itertuples(index=False, name=None):
                if at is not None:
                    # beyond gap + 1 negatives nothing changes any more
                    for missing in range(at + 1, min(p, at + config.gap + 3)):
                        out += [(*key, *s) for s in hysteresis_step(held, config, missing, "negative")]
                out += [(*key, *s) for s in hysteresis_step(held, config, p, lv)]
                at = p
            state.update((pickle.dumps((held, at)),))
            if quiet_ms:
                state.setTimeoutDuration(quiet_ms)
        yield pd.DataFrame(out, columns=names)

    return samples.groupBy(*keys).applyInPandasWithState(run, schema, "held binary", "append", "ProcessingTimeTimeout" if quiet_ms else "NoTimeout")


def run_once(df: DataFrame, name: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Drain a finite stream into a memory table, for tests and small reports."""
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name)
