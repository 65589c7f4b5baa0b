"""Streaming forms of operators that only add up: an extension, the batch operators are the measure.

Slabs of voxels arrive as appended rows.  Contingency counts, label volumes and confusion counts are sums, so
the same operators run on a streaming DataFrame in complete or update mode.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from lattica.operators import metrics, voxel


def running_contingency(stream: DataFrame, masks: tuple[int, ...] = (0,), seg: str = "label", gold: str = "gold") -> DataFrame:
    return metrics.contingency(stream, masks, seg, gold)


def running_volume(stream: DataFrame, label: str = "label") -> DataFrame:
    return voxel.label_volume(stream, label)


def start(counts: DataFrame, name: str, checkpoint: str, mode: str = "complete"):
    """A query that keeps the counts in a table of the session, to be judged by the batch metrics."""
    return counts.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", checkpoint).start()
