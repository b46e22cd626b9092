"""The write path as Structured Streaming: stateless encoding, running unit counts, and positions in arrival order."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.text import content_terms
from ..operators.units import combinations


def encoded(stream: DataFrame) -> DataFrame:
    """session, text with their units: no state."""
    return stream.select("session", "text", combinations(content_terms(F.col("text"))).alias("units"))


def running_df(stream: DataFrame) -> DataFrame:
    """u, df: how many episodes hold each unit so far (update or complete mode)."""
    return encoded(stream).select(F.explode(F.array_distinct("units")).alias("u")).groupBy("u").agg(F.count("*").alias("df"))


def positions(stream: DataFrame) -> DataFrame:
    """session, idx, text: the place of each episode in its session, in order of arrival; numbers are never used again."""

    def number(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n = state.get[0] if state.exists else 0
        for frame in batches:
            yield pd.DataFrame({"session": frame["session"], "idx": range(n, n + len(frame)), "text": frame["text"]})
            n += len(frame)
        state.update((n,))

    return stream.select("session", "text").groupBy("session").applyInPandasWithState(number, "session long, idx long, text string", "n long", "append", GroupStateTimeout.NoTimeout)


def every_batch(stream: DataFrame, consolidate: Callable[[DataFrame, int], None], checkpoint: str):
    """Run a consolidation job for each batch of writes."""
    return stream.writeStream.foreachBatch(consolidate).option("checkpointLocation", checkpoint).start()
