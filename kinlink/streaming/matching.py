"""Matching of owners that arrive as a stream against stored targets."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql.streaming import StreamingQuery

from kinlink.operators import retrieval as ret


def match_stream(owners: DataFrame, targets: DataFrame, terms: Callable[[Column], Column], k: int, least: float, out: str, checkpoint: str) -> StreamingQuery:
    """Retrieve the ``k`` best targets of every arriving owner (block, id, text) with a score of ``least`` or more.

    Each micro-batch writes the folder of its own number, overwriting what a
    failed attempt left there, so every owner is answered once. Target weights
    come from the stored table, which a batch reads as it is then.
    """

    def answer(batch: DataFrame, number: int) -> None:
        found = ret.top_k(batch, targets, terms, k).where(f"score >= {least}")
        found.write.mode("overwrite").parquet(f"{out}/batch={number}")

    return owners.writeStream.foreachBatch(answer).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
