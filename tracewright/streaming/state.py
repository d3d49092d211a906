"""Positions and profiles over a stream of rows, with state per entity."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def stream_positions(stream: DataFrame, key: str, order: str) -> DataFrame:
    """The stream's rows with their 1-based position in their entity; state is one number per entity.

    Rows of a micro-batch are numbered in the order column; late rows follow those already numbered.
    """
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in stream.schema.fields]

    def number(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen = state.get[0] if state.exists else 0
        rows = pd.concat(list(parts)).sort_values(order, kind="stable")
        rows["position"] = range(seen + 1, seen + 1 + len(rows))
        state.update((seen + len(rows),))
        yield rows

    return stream.groupBy(key).applyInPandasWithState(number, ", ".join([*fields, "position long"]), "seen long", "append", GroupStateTimeout.NoTimeout)


def stream_profile(stream: DataFrame, keys: list[str], what: str, values: list[str]) -> DataFrame:
    """Running counts per entity, for complete or update mode."""
    return stream.groupBy(*keys).agg(F.count(F.lit(1)).alias("windows"), *(F.count_if(F.col(what) == v).alias(v) for v in values))
