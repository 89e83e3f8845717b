"""Survey figures over streams of points: an extension, for instruments that send while they fly."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_stats(points: DataFrame, width: str = "1 minute", late: str = "5 minutes", keys=("line_id",)) -> DataFrame:
    """Count, mean, least and largest mag_raw per key and window of event time; state goes once the watermark has passed."""
    w = points.withWatermark("timestamp", late).groupBy(F.window("timestamp", width), *keys)
    return w.agg(F.count("*").alias("n"), F.avg("mag_raw").alias("mean"), F.min("mag_raw").alias("low"), F.max("mag_raw").alias("high"))


def deduplicated(points: DataFrame, late: str = "5 minutes") -> DataFrame:
    """One row a point_id and time within the watermark."""
    return points.withWatermark("timestamp", late).dropDuplicates(["point_id", "timestamp"])


def difference_alarms(points: DataFrame, limit: float, key: str = "line_id") -> DataFrame:
    """(key, timestamp, d4): points whose 4th difference exceeds `limit`, by keyed state of the last four values. Rows of a batch are ordered by
    time; a row older than what was seen before is left out."""

    def run(k, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        held, last = state.get if state.exists else ([], None)
        held = list(held)
        rows = pd.concat(list(frames)).sort_values("timestamp")
        out = []
        for t, v in zip(rows["timestamp"], rows["mag_raw"]):
            if last is not None and t.value <= last:
                continue
            held, last = [*held, float(v)][-5:], t.value
            if len(held) == 5:
                d = (held[4] - 4 * held[3] + 6 * held[2] - 4 * held[1] + held[0]) / 70**0.5
                if abs(d) > limit:
                    out.append((k[0], t, d))
        state.update((held[-4:], last))
        yield pd.DataFrame(out, columns=[key, "timestamp", "d4"])

    return points.groupBy(key).applyInPandasWithState(run, f"{key} int, timestamp timestamp, d4 double", "held array<double>, last long", "append", "NoTimeout")
