"""Utterance counters and corpus metrics.

Everything about an utterance is one narrow projection; the corpus metrics are one aggregate over it (partial
sums on the map side), grouped if asked.  Rates are ratios of sums, and null where nothing is divided by.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.align import score_ops


def tokenize_pairs(pairs: DataFrame, poi_window: int = 1) -> DataFrame:
    """Adds the tokens, languages and points of interest of ref and hyp."""
    out = pairs.withColumns({"ref_tokens": X.tokens(F.col("ref")), "hyp_tokens": X.tokens(F.col("hyp"))})
    out = out.withColumns({"ref_langs": X.token_langs(F.col("ref_tokens")), "hyp_langs": X.token_langs(F.col("hyp_tokens"))})
    return out.withColumn("poi", X.poi_indices(X.switch_points(F.col("ref_langs")), F.size("ref_langs"), poi_window))


def score_utterances(pairs: DataFrame, poi_window: int = 1) -> DataFrame:
    """``pairs`` (id, ref, hyp, normalised already) with all counters of an utterance.

    Null texts are empty.  mer is null for an empty reference.
    """
    t = tokenize_pairs(pairs, poi_window)
    t = t.withColumn("s", score_ops("ref_tokens", "ref_langs", "hyp_tokens", "hyp_langs", F.lit(poi_window)))
    ref, hyp = X.lang_counts(F.col("ref_langs")), X.lang_counts(F.col("hyp_langs"))
    t = t.select(
        *pairs.columns,
        F.size("ref_tokens").alias("n_ref"),
        F.size("hyp_tokens").alias("n_hyp"),
        *[F.col(f"s.{c}").alias(c) for c in ("ops", "hits", "subs", "dels", "ins")],
        ref.alias("lang_ref"),
        hyp.alias("lang_hyp"),
        *[F.struct(*[F.col(f"s.{k}_{x}").alias(x) for x in X.LANGS]).alias(f"lang_{k}") for k in ("sub", "del", "ins")],
        F.size("poi").alias("n_poi"),
        F.size(X.switch_points(F.col("ref_langs"))).alias("n_switch_ref"),
        F.size(X.switch_points(F.col("hyp_langs"))).alias("n_switch_hyp"),
        *[F.col(f"s.{c}").alias(c) for c in ("poi_err", "en_sub_by_zh", "en_lost")],
        X.code_mixing_index(F.col("ref_langs")).alias("cmi_ref"),
    )
    err = F.struct(*[(F.col(f"lang_sub.{x}") + F.col(f"lang_del.{x}") + F.col(f"lang_ins.{x}")).alias(x) for x in X.LANGS])
    return t.withColumns(
        {
            "lang_err": err,
            "en_omitted": (F.col("lang_ref.en") > 0) & (F.col("lang_hyp.en") == 0),
            "zh_omitted": (F.col("lang_ref.zh") > 0) & (F.col("lang_hyp.zh") == 0),
            "length_ratio": X.length_ratio(F.col("n_hyp"), F.col("n_ref")),
            "foreign_script": X.foreign_script(F.col("n_hyp"), F.col("lang_hyp.other")),
            "mer": F.try_divide(F.col("subs") + F.col("dels") + F.col("ins"), F.col("n_ref")),
        }
    )


def degenerate(runaway_ratio: float = 2.0) -> Column:
    """Foreign script, or far longer than the reference (something against nothing included)."""
    return F.col("foreign_script") | (F.col("length_ratio") > runaway_ratio)


def _sums(runaway_ratio: float) -> list[Column]:
    plain = {"n_ref_tokens": "n_ref", "n_hyp_tokens": "n_hyp", **{c: c for c in ("hits", "subs", "dels", "ins", "n_poi", "poi_err", "n_switch_ref", "n_switch_hyp", "en_sub_by_zh", "en_lost")}}
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return [
        F.count(F.lit(1)).alias("n_utts"),
        *[total(c).alias(name) for name, c in plain.items()],
        *[total(f"lang_{k}.{x}").alias(f"{k}_{x}") for k in ("ref", "hyp", "err", "sub", "del", "ins") for x in X.LANGS],
        F.count_if(F.col("lang_ref.en") > 0).alias("utts_with_en_ref"),
        F.count_if(F.col("lang_ref.zh") > 0).alias("utts_with_zh_ref"),
        F.count_if("en_omitted").alias("utts_en_omitted"),
        F.count_if("zh_omitted").alias("utts_zh_omitted"),
        F.count_if((F.col("n_ref") > 0) & (F.col("length_ratio") > runaway_ratio)).alias("utts_runaway"),
        F.count_if("foreign_script").alias("utts_foreign_script"),
        F.coalesce(F.sum("cmi_ref"), F.lit(0.0)).alias("sum_cmi_ref"),
    ]


#: Rates by numerator (several are added) and denominator.
RATES = {
    "mer": ("subs dels ins", "n_ref_tokens"),
    "cer_zh": ("err_zh", "ref_zh"),
    "wer_en": ("err_en", "ref_en"),
    "num_error_rate": ("err_num", "ref_num"),
    "other_error_rate": ("err_other", "ref_other"),
    "pier": ("poi_err", "n_poi"),
    "sub_rate": ("subs", "n_ref_tokens"),
    "del_rate": ("dels", "n_ref_tokens"),
    "ins_rate": ("ins", "n_ref_tokens"),
    "en_omission_rate": ("utts_en_omitted", "utts_with_en_ref"),
    "zh_omission_rate": ("utts_zh_omitted", "utts_with_zh_ref"),
    "en_sub_by_zh_rate": ("en_sub_by_zh", "ref_en"),
    "en_lost_rate": ("en_lost", "ref_en"),
    "runaway_rate": ("utts_runaway", "n_utts"),
    "foreign_script_rate": ("utts_foreign_script", "n_utts"),
    "hyp_foreign_token_rate": ("hyp_other", "n_hyp_tokens"),
    "switch_ratio": ("n_switch_hyp", "n_switch_ref"),
    "length_ratio": ("n_hyp_tokens", "n_ref_tokens"),
    "mean_cmi_ref": ("sum_cmi_ref", "n_utts"),
}


def corpus_metrics(utts: DataFrame, by: list[str] | None = None, runaway_ratio: float = 2.0) -> DataFrame:
    """Counts and rates over all utterances, or a row for each group of ``by``."""
    sums = utts.groupBy(*by).agg(*_sums(runaway_ratio)) if by else utts.agg(*_sums(runaway_ratio))
    rate = lambda up, down: F.try_divide(sum(F.col(c) for c in up.split()), F.col(down))
    return sums.withColumns({name: rate(up, down) for name, (up, down) in RATES.items()})


def corpus_metrics_clean(utts: DataFrame, by: list[str] | None = None, runaway_ratio: float = 2.0) -> DataFrame:
    """The same without degenerate utterances: a companion of the full figures, not their replacement."""
    return corpus_metrics(utts.where(~degenerate(runaway_ratio)), by, runaway_ratio)


def worst_utterances(utts: DataFrame, k: int = 20, min_ref_tokens: int = 3, pos: str = "_pos") -> DataFrame:
    """The k highest error rates among references of at least ``min_ref_tokens`` tokens; earlier rows first on a tie."""
    return utts.where(F.col("n_ref") >= min_ref_tokens).orderBy(F.desc("mer"), pos).limit(k)


#: Findings of ``diagnose`` in their order.
FINDINGS = ("no_output", "short_output", "foreign_script", "runaway", "insertions", "script_mismatch", "english_omitted", "translated", "flattened", "switch_errors", "errors_outnumber_tokens")


def diagnosis(metrics: DataFrame) -> DataFrame:
    """``metrics`` with findings, an array of codes; empty: nothing anomalous.

    No output at all is the only finding where it is one; a foreign script explains runaway outputs and error
    rates above 1, which are then not findings of their own.
    """
    c = F.col
    zero = lambda x: F.coalesce(c(x), F.lit(0.0))
    foreign = zero("foreign_script_rate") > 0
    rules = [
        ("short_output", (zero("length_ratio") > 0) & (c("length_ratio") < 0.2)),
        ("foreign_script", foreign),
        ("runaway", (zero("runaway_rate") > 0.05) & ~foreign),
        ("insertions", (zero("ins_rate") > 0.30) & (zero("runaway_rate") <= 0.05)),
        ("script_mismatch", (zero("cer_zh") > 0.45) & (c("subs") > c("ins")) & (c("subs") > c("dels"))),
        ("english_omitted", zero("en_omission_rate") > 0.10),
        ("translated", zero("en_sub_by_zh_rate") > 0.15),
        ("flattened", F.coalesce(c("switch_ratio") < 0.6, F.lit(False))),
        ("switch_errors", F.coalesce(c("pier") > c("mer") * 1.3, F.lit(False))),
        ("errors_outnumber_tokens", (zero("mer") > 1.0) & ~foreign),
    ]
    found = F.array_compact(F.array(*[F.when(test, F.lit(code)) for code, test in rules]))
    silent = (c("n_ref_tokens") > 0) & (c("n_hyp_tokens") == 0)
    return metrics.withColumn("findings", F.when(silent, F.array(F.lit("no_output"))).otherwise(found))


def compare(runs: dict[str, DataFrame], runaway_ratio: float = 2.0) -> DataFrame:
    """A row of metrics for each run, from utterance frames by name."""
    out = None
    for name, utts in runs.items():
        named = utts.withColumn("model", F.lit(name))
        out = named if out is None else out.unionByName(named, allowMissingColumns=True)
    if out is None:
        raise ValueError("nothing to compare")
    return corpus_metrics(out, ["model"], runaway_ratio)
