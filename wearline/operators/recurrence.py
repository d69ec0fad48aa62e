"""A sequential per-station recurrence that window functions cannot express."""

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def vibration_drift(history: DataFrame, alpha: float = 0.05, block: str = "day") -> DataFrame:
    """Smoothed vibration per station and second: d = (1 - alpha) d + alpha x, back to 0 while the station is down.

    The recurrence is linear, so a station's history is cut into blocks that are smoothed on their own from 0, many in one
    stream of sorted rows; a missing reading leaves the state as it is. Next to the local value each row carries the weight that the state before the block still has. The state at each block
    border then follows from one summary row per block, and is added to the rows with that weight.
    """

    # Rows smoothed at once: as many as keep powers of (1 - alpha) far from what a double cannot hold.
    at_once = max(1, int(200 / -np.log1p(-alpha))) if alpha < 1 else 1

    def along(x: np.ndarray, state: float) -> tuple[np.ndarray, np.ndarray]:
        """Smoothed values of a stretch without downtime, and the weight that `state` before it still has."""
        there = ~np.isnan(x)
        steps = np.cumsum(there)
        kept, since_first = (1 - alpha) ** steps, (1 - alpha) ** np.maximum(steps - 1, 0)
        return kept * state + alpha * since_first * np.cumsum(np.where(there, x, 0.0) / since_first), kept

    def smooth(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come in order of station, block and time; a batch goes on where the one before it ended."""
        state, left, group = 0.0, 1.0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            station, block, ts, x, down = batch.columns
            codes = pc.fill_null(station.dictionary_encode().indices, -1).to_numpy()
            hours = pc.fill_null(block.cast(pa.int64()), -2**63).to_numpy()
            x, down = x.to_numpy(zero_copy_only=False), down.to_numpy(zero_copy_only=False)
            first = np.ones(len(x), dtype=bool)
            first[1:] = (codes[1:] != codes[:-1]) | (hours[1:] != hours[:-1])
            first[0] = group != (station[0].as_py(), hours[0])
            group = station[-1].as_py(), hours[-1]
            local, weight = np.zeros(len(x)), np.zeros(len(x))
            bounds = [0, *np.flatnonzero(first | down).tolist(), len(x)]
            for low, high in zip(bounds, bounds[1:]):
                if low < high and first[low]:
                    state, left = 0.0, 1.0
                if low < high and down[low]:  # back to 0, and nothing is left of what was before
                    state, left, low = 0.0, 0.0, low + 1
                for at in range(low, high, at_once):
                    part = slice(at, min(at + at_once, high))
                    local[part], kept = along(x[part], state)
                    weight[part] = left * kept
                    state, left = local[part.stop - 1], weight[part.stop - 1]
            yield pa.record_batch([station, block, ts, pa.array(local), pa.array(weight)],
                                  ["station_id", "block", "ts", "local", "weight"])

    def carry(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("block")
        before, state = [], 0.0
        for local, weight in zip(frame["local"], frame["weight"]):
            before.append(state)
            state = local + weight * state
        return frame[["station_id", "block"]].assign(before=before)

    down = F.coalesce(F.col("ttf_s") == 0, F.lit(False))
    x = F.when(down, 0.0).when(~F.isnan("vibration_rms"), F.col("vibration_rms").cast("double"))
    rows = history.select("station_id", F.date_trunc(block, "ts").alias("block"), "ts", x.alias("x"), down.alias("down"))
    ordered = rows.repartition("station_id", "block").sortWithinPartitions("station_id", "block", "ts", "down", "x")
    smoothed = ordered.mapInArrow(
        smooth, "station_id string, block timestamp, ts timestamp, local double, weight double")
    # Both sides of the join below read this one exchange, so rows are smoothed once. The join drops rows without a place;
    # dropping them here keeps the two readers alike.
    local = smoothed.where("station_id IS NOT NULL AND block IS NOT NULL").repartition("station_id", "block")
    ends = local.groupBy("station_id", "block").agg(
        F.max_by("local", "ts").alias("local"), F.max_by("weight", "ts").alias("weight"))
    starts = ends.groupBy("station_id").applyInPandas(carry, "station_id string, block timestamp, before double")
    return local.join(starts, ["station_id", "block"]).select(
        "station_id", "ts", (F.col("local") + F.col("weight") * F.col("before")).alias("drift"))
