"""Whole jobs: mask texts, evaluate detectors, merge and split datasets, and a small command line."""

from __future__ import annotations

import sys
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import masking
from ..functions.rows import packed, unpacked
from ..operators import datasets, evaluation
from ..operators.detectors import Detector, PatternDetector, RecogniserDetector
from ..sources.metrics import combined


def mask_texts(df: DataFrame, detector: Detector | None = None, policy: masking.Policy = masking.placeholder, aggressiveness: float = 0.8, text: str = "text", key: str | None = None) -> DataFrame:
    """Adds spans and ``masked``; ``key`` seeds pseudonyms."""
    found = (detector or PatternDetector(aggressiveness)).detect(df, text, "spans")
    return found.withColumn("masked", masking.mask(F.col(text), F.col("spans"), policy, aggressiveness, F.col(key) if key else None))


def mask_texts_with(df: DataFrame, replace: Callable[[str, str], str], detector: Detector | None = None, aggressiveness: float = 0.8, text: str = "text") -> DataFrame:
    """Adds spans and ``masked``, each span replaced by a user's function of its type and text."""
    found = (detector or PatternDetector(aggressiveness)).detect(df, text, "spans")
    rows = packed(found, t=F.col(f"`{text}`"), chosen=F.filter("spans", lambda s: masking.will_mask(s["type"], aggressiveness)))
    made = rows.withColumn("new", masking.custom(replace)(F.col("chosen")))
    return unpacked(made, found.columns, {"masked": masking.mask_with(F.col("t"), F.col("chosen"), F.col("new"))})


def show_ranking(metrics: DataFrame, n: int = 20) -> None:
    """Print the methods by micro F1, best first."""
    evaluation.ranking(metrics).select("method", "precision", "recall", "f1", "tp", "fp", "fn").show(n, truncate=False)


def evaluate(dialogs: DataFrame, detectors: list[Detector], pooled: bool = False, threshold: float = 1.0) -> DataFrame:
    """Metrics of each detector against the dialogs' entities, names merged and ages trimmed: method and the metric columns."""
    gold = evaluation.span_rows(dialogs, "entities", "id", pooled)
    out = {}
    for d in detectors:
        found = d.detect(dialogs.select("id", "text"), "text", "found")
        improved = found.select("id", "text", evaluation.merge_names(F.col("found")).alias("merged")).select("id", evaluation.trim_ages(F.col("merged"), F.col("text")).alias("spans"))
        out[d.name] = evaluation.metrics_by_type(gold, evaluation.span_rows(improved, "spans", "id", pooled), threshold)
    return combined(out)


def timed(df: DataFrame, detectors: list[Detector], text: str = "text") -> DataFrame:
    """Seconds that each detector takes over all texts, in turn: method, n_texts, total_seconds, seconds_per_text. The spans are computed and dropped."""
    rows = []
    for d in detectors:
        began = time.time()
        n = d.detect(df.select(F.col(f"`{text}`").alias("text"))).agg(F.count(F.lit(1)), F.sum(F.size("spans"))).first()[0]
        took = time.time() - began
        rows.append((d.name, n, took, took / n if n else 0.0))
    return df.sparkSession.createDataFrame(rows, "method string, n_texts long, total_seconds double, seconds_per_text double")


def merge_and_split(parts: list[DataFrame], train_ratio: float = 0.7, seed: int = 42) -> dict[str, DataFrame]:
    """The merged dataset, numbered from 1, and its train and validation sets."""
    merged = datasets.merge_datasets(parts)
    train, val = datasets.split_dataset(merged.drop("original_id"), train_ratio, seed)
    return {"merged": merged, "train": train, "val": val}


def main() -> int:
    """Mask standard input by the recognisers and their names for types."""
    text = sys.stdin.read().strip()
    if not text:
        print("no input", file=sys.stderr)
        return 1
    spark = SparkSession.builder.getOrCreate()
    rows = spark.createDataFrame([(text,)], "text string")
    print(mask_texts(rows, RecogniserDetector(), masking.by_type(masking.NAMES), 1.0).first().masked)
    return 0


if __name__ == "__main__":
    sys.exit(main())
