"""Order-dependent work: sequential in a store, parallel across stores."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame


def per_store(rows: DataFrame, fold: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """fold over the rows of each store in order of seq."""
    return rows.groupBy("store_id").applyInPandas(lambda frame: fold(frame.sort_values("seq", kind="stable").reset_index(drop=True)), schema)
