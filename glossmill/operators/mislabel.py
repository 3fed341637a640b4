"""Hypotheses that fit a neighbour's reference better than their own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions.align import token_distance
from ..functions.text import let, tokens


def _mer(ref: Column, hyp: Column) -> Column:
    """The error rate of two token arrays, of which neither is empty."""
    return token_distance(ref, hyp) / F.size(ref)


def misalignments(rows: DataFrame, window: int = 5, min_own_mer: float = 0.5, ratio: float = 0.5, max_best_mer: float = 0.5, part: list[str] | None = None) -> DataFrame:
    """index, id, ref, hyp, own_mer, best_id, best_index, best_mer, improvement, n_ref.

    ``rows``: index (consecutive places, within ``part`` if given), id, ref, hyp.  Rows with an own error rate of
    at least ``min_own_mer`` are compared with the references of up to ``window`` places away.  Places are cut into
    blocks with the neighbours' places at both ends, a 32nd of the rows twice: a frame within a block holds what a row looks at, so that
    a row is dealt once and not once for each place that looks at it, and no sort is of the whole table.
    The best neighbour (the first on a tie) must beat the own rate, reach ``max_best_mer`` and ``ratio`` of the own rate.
    """
    part = part or []
    width = max(1, 64 * window)
    block = lambda x: F.floor(x / F.lit(width))
    place = F.col("index")
    t = rows.select(*part, "index", "id", "ref", "hyp", F.explode(F.sequence(block(place - window), block(place + window))).alias("_block"))
    # dealt by blocks: rows that lie together already, by ``part``, may all be in one task
    t = t.repartition(*part, "_block").withColumns({"r": tokens(F.col("ref")), "h": tokens(F.col("hyp"))})
    frame = Window.partitionBy(*part, "_block").orderBy("index").rangeBetween(-window, window)
    around = F.collect_list(F.when(F.size("r") > 0, F.struct(place.alias("best_index"), F.col("id").alias("best_id"), F.col("r").alias("other")))).over(frame)
    t = t.withColumn("_around", around).where(F.col("_block") == block(place))

    def fits(own: Column) -> Column:
        # tokens that the other side lacks cost an edit each; what cannot reach ``max_best_mer`` needs no alignment, as it is no match even if it is the best
        apart = lambda x: F.greatest(F.abs(F.size(x) - F.size("h")), F.size(F.array_except(x, "h")), F.size(F.array_except("h", x)))
        near = F.filter("_around", lambda x: (x["best_index"] != place) & (apart(x["other"]) <= max_best_mer * F.size(x["other"])))
        rated = F.transform(near, lambda x: F.struct(_mer(x["other"], F.col("h")).alias("best_mer"), x["best_index"].alias("best_index"), x["best_id"].alias("best_id"), own.alias("own_mer")))
        best = F.when(own >= min_own_mer, F.array_min(rated))
        good = lambda x: (x["best_mer"] < own) & (x["best_mer"] <= max_best_mer) & (x["best_mer"] <= own * ratio)
        return F.filter(F.array(best), good)

    # exploded, since a filter on a plain column would be computed along with it, distances and all
    found = F.when((F.size("r") > 0) & (F.size("h") > 0), let(_mer(F.col("r"), F.col("h")), fits))
    out = t.select(*part, "index", "id", "ref", "hyp", F.size("r").alias("n_ref"), F.inline(found)).withColumn("improvement", F.col("own_mer") - F.col("best_mer"))
    return out.select(*part, "index", "best_mer", "best_index", "best_id", "own_mer", "id", "ref", "hyp", "n_ref", "improvement")


def _pair(part: list[str]) -> WindowSpec:
    """Rows that name the same two places: two at most, since a row names one place beside its own."""
    return Window.partitionBy(*part, F.least("index", "best_index"), F.greatest("index", "best_index"))


def mutual_pairs(found: DataFrame, part: list[str] | None = None) -> DataFrame:
    """Rows that are each other's best, once each: the first member's row with the second's place and id."""
    pair = _pair(part or [])
    second = F.max(F.when(F.col("index") > F.col("best_index"), F.col("own_mer"))).over(pair)
    return found.withColumns({"_n": F.count(F.lit(1)).over(pair), "other_own_mer": second}).where((F.col("_n") == 2) & (F.col("index") < F.col("best_index"))).drop("_n")


def with_mutual(found: DataFrame, part: list[str] | None = None) -> DataFrame:
    """``found`` with mutual: whether the best match points back."""
    return found.withColumn("mutual", F.count(F.lit(1)).over(_pair(part or [])) == 2)


def one_way(found: DataFrame, part: list[str] | None = None) -> DataFrame:
    return with_mutual(found, part).where("not mutual").drop("mutual")


def mer_impact(rows: DataFrame, found: DataFrame) -> DataFrame:
    """The share of the corpus error rate that the mislabelled rows make up: one row, null without tokens."""
    gained = found.select((F.col("improvement") * F.col("n_ref")).alias("gained"), F.lit(0).alias("n"))
    total = rows.select(F.lit(0.0).alias("gained"), F.size(tokens(F.col("ref"))).alias("n"))
    return total.unionByName(gained).agg(F.try_divide(F.sum("gained"), F.sum("n")).alias("mer_impact"))
