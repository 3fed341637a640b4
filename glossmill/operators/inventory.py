"""What was said, and what came out: the inventory of edits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.align import edit_spans
from .scoring import tokenize_pairs


def edits(pairs: DataFrame, poi_window: int = 1, pos: str = "_pos") -> DataFrame:
    """A row for each edit span: pos, span (its number in the utterance), kind, ref_lang, hyp_lang, ref, hyp, is_poi, lost.

    An ``ops`` column is used where ``pairs`` has one; else the texts are aligned.
    """
    t = tokenize_pairs(pairs, poi_window)
    spans = edit_spans("ref_tokens", "ref_langs", "hyp_tokens", "hyp_langs", F.lit(poi_window), *[c for c in ("ops",) if c in pairs.columns])
    return t.select(F.col(pos).alias("pos"), F.explode(spans).alias("s")).select("pos", "s.*")


def inventory(spans: DataFrame) -> DataFrame:
    """kind, ref_lang, hyp_lang, ref, hyp with count, poi_count and the place first seen."""
    first = F.min(F.struct("pos", "span"))
    return spans.groupBy("kind", "ref_lang", "hyp_lang", "ref", "hyp").agg(F.count(F.lit(1)).alias("count"), F.count_if("is_poi").alias("poi_count"), first.alias("first_seen"))


def lost_tokens(spans: DataFrame) -> DataFrame:
    """English tokens that were replaced or deleted: token, count, first_seen."""
    each = spans.select("pos", "span", F.posexplode("lost").alias("at", "token"))
    return each.groupBy("token").agg(F.count(F.lit(1)).alias("count"), F.min(F.struct("pos", "span", "at")).alias("first_seen"))


def top(counts: DataFrame, n: int, min_count: int = 1, by: str = "count") -> DataFrame:
    """The n most frequent, earlier seen first on a tie; the minimum applies to what is left."""
    return counts.orderBy(F.desc(by), "first_seen").limit(n).where(F.col(by) >= min_count)


def directions(table: DataFrame) -> DataFrame:
    """Substitution totals by languages, the largest first."""
    subs = table.where("kind = 'sub'").groupBy("ref_lang", "hyp_lang")
    return subs.agg(F.sum("count").alias("total"), F.count(F.lit(1)).alias("distinct_pairs")).orderBy(F.desc("total"), "ref_lang", "hyp_lang")
