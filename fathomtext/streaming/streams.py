"""Streams: stateless splitting and cleaning, cached embedding by micro-batch, calibration as state."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from fathomtext.functions.usage import WINDOW
from fathomtext.operators.embed import embed_df
from fathomtext.operators.split import SplitOptions, split_df
from fathomtext.sources.embedders import Embedder


def split_stream(stream: DataFrame, text: str = "text", model: str = "", options: SplitOptions = SplitOptions(), keep: tuple[str, ...] = ()) -> DataFrame:
    return split_df(stream, text, model, options, keep)


def embed_sink(e: Embedder, path: str, key: str = "row_id", text: str = "text") -> Callable[[DataFrame, int], None]:
    """For foreachBatch: vectors of a micro-batch go to their own folder, overwritten if the batch is replayed."""

    def write(batch: DataFrame, epoch: int) -> None:
        embed_df(batch, e, key, text).write.mode("overwrite").parquet(f"{path}/batch={epoch}")

    return write


def calibration_stream(log: DataFrame, window: int = WINDOW) -> DataFrame:
    """Running calibration of each model: the last ``window`` unclipped ratios are the state."""

    def update(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        ring, clipped = (list(state.get[0]), state.get[1]) if state.exists else ([], 0)
        rows = pd.concat(list(parts))
        rows = rows[(rows["tokens"] > 0) & (rows["bytes"] > 0)].sort_values("seq")
        if len(rows):
            clipped += int(rows["clipped"].sum())
            good = rows[~rows["clipped"].astype(bool)]
            ring = (ring + (good["bytes"] / good["tokens"]).tolist())[-window:]
            state.update((ring, clipped))
        if not state.exists:
            return  # no row of the model counted so far
        s, n = sorted(ring), len(ring)
        at = lambda p: s[min(n * p // 100, n - 1)] if n else None
        yield pd.DataFrame([[key[0], n, clipped, s[0] if n else None, at(10), at(50), sum(ring) / n if n else None]], columns=["model", "samples", "clipped", "min", "p10", "median", "mean"])

    return log.groupBy("model").applyInPandasWithState(update, "model string, samples bigint, clipped bigint, min double, p10 double, median double, mean double", "ring array<double>, clipped bigint", "update", GroupStateTimeout.NoTimeout)
