"""Masking and counting over streams: an extension, with the expressions of the batch operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.masking import mask
from ..functions.rows import packed, unpacked
from ..operators.detectors import Detector, PatternDetector


def masked_stream(stream: DataFrame, detector: Detector | None = None, text: str = "text", aggressiveness: float = 0.8) -> DataFrame:
    """Adds ``masked`` and drops the text; stateless, so append mode and any source will do."""
    found = (detector or PatternDetector(aggressiveness)).detect(packed(stream, t=F.col(f"`{text}`")), "t", "found")
    return unpacked(found, [c for c in stream.columns if c != text], {"masked": mask(F.col("t"), F.col("found"), aggressiveness=aggressiveness)})


def type_counts(stream: DataFrame, time: str, window: str = "10 minutes", late: str = "10 minutes", detector: Detector | None = None, text: str = "text") -> DataFrame:
    """Spans of each type in each window: window_start, type, n. Rows later than ``late`` are left out by the watermark."""
    found = (detector or PatternDetector()).detect(stream.select(F.col(f"`{time}`").alias("time"), F.col(f"`{text}`").alias("t")), "t", "found")
    rows = found.withWatermark("time", late).select("time", F.explode("found").alias("s"))
    return rows.groupBy(F.window("time", window).alias("w"), F.col("s.type").alias("type")).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("window_start"), "type", "n")
