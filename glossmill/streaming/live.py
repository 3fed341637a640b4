"""Scoring as a stream.

The per-utterance kernels only look at their own row, so they run unchanged on a stream; windowed metrics need a
watermark, which bounds the state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.scoring import corpus_metrics, score_utterances


def score_stream(pairs: DataFrame, poi_window: int = 1) -> DataFrame:
    """A stream of ``pairs`` (id, ref, hyp, ...) with all utterance counters, row by row."""
    return score_utterances(pairs, poi_window)


def windowed_metrics(pairs: DataFrame, time: str = "ts", length: str = "5 minutes", late: str = "10 minutes", runaway_ratio: float = 2.0) -> DataFrame:
    """Counts of errors and tokens by window of event time, with MER.

    Rows that come more than ``late`` after the newest are left out; a window is final, and its state dropped, once the
    watermark has passed it.
    """
    scored = score_utterances(pairs.withWatermark(time, late)).withColumn("window", F.window(time, length))
    sums = scored.groupBy("window").agg(*[F.sum(c).alias(c) for c in ("n_ref", "n_hyp", "subs", "dels", "ins", "poi_err", "n_poi")], F.count_if((F.col("n_ref") > 0) & (F.col("length_ratio") > runaway_ratio)).alias("utts_runaway"), F.count(F.lit(1)).alias("n_utts"))
    rates = {"mer": F.try_divide(F.col("subs") + F.col("dels") + F.col("ins"), F.col("n_ref")), "pier": F.try_divide("poi_err", "n_poi")}
    return sums.withColumns(rates)


def append_metrics(scored: DataFrame, epoch: int, table: str) -> None:
    """For foreachBatch: appends one row of corpus metrics for each micro-batch."""
    corpus_metrics(scored).withColumn("epoch", F.lit(epoch)).write.mode("append").parquet(table)
