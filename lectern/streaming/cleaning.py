"""The rules over a stream of containers.

All rules are stateless beyond their container, so a stream is cleaned as a table is; only the dictionary's join is bounded by
the dictionary, which is static. A deployment of the batch operators, with no semantics of its own.
"""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..functions import text_rules as R
from ..operators import cleaning


def clean_stream(stream: DataFrame, runs: str = "runs", enabled: Collection[str] = R.DEFAULT) -> DataFrame:
    """The stream with its runs cleaned; words split by a hyphen stay, as their repair joins with the dictionary by key."""
    return cleaning.clean(stream, runs, enabled=frozenset(enabled) - {"dehyph"})


def findings_stream(stream: DataFrame, keys: list[str], runs: str = "runs", enabled: Collection[str] = R.DEFAULT) -> DataFrame:
    return cleaning.findings(stream, runs, keys, frozenset(enabled) - {"dehyph"})


def write_clean(stream: DataFrame, path: str, checkpoint: str, dictionary: DataFrame | None = None, keys: list[str] | None = None, runs: str = "runs", enabled: Collection[str] = R.DEFAULT) -> StreamingQuery:
    """Cleans batch by batch, dictionary included, and appends to a Parquet folder."""

    def put(batch: DataFrame, _: int) -> None:
        cleaning.clean(batch, runs, keys, enabled, dictionary).write.mode("append").parquet(path)

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
