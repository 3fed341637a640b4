"""References and hypotheses: keys, joins, guards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def missing_ids(records: DataFrame) -> DataFrame:
    """Rows without an id get utt_ and their place in six digits."""
    return records.withColumn("id", F.coalesce(F.col("id").cast("string"), F.format_string("utt_%06d", F.col("_pos"))))


def duplicate_ids(records: DataFrame) -> DataFrame:
    """id, n and first place of every id that occurs more than once."""
    return records.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.min("_pos").alias("first_pos")).where("n > 1")


def check_unique_ids(records: DataFrame, source: str) -> None:
    first = duplicate_ids(records).orderBy("first_pos").limit(1).collect()
    if first:
        raise ValueError(f"{source}: duplicate id {first[0].id!r}")


def last_hypotheses(hyps: DataFrame) -> DataFrame:
    """One row an id: the last one wins; ``hyp``, else ``text``, else nothing."""
    if "id" not in hyps.columns:
        raise KeyError("hypothesis records have no id")
    said = [F.col(c).cast("string") for c in ("hyp", "text") if c in hyps.columns]
    value = F.coalesce(*said, F.lit(""))
    error = F.col("error").cast("string") if "error" in hyps.columns else F.lit(None).cast("string")
    return hyps.groupBy(F.col("id").cast("string").alias("id")).agg(F.max_by(F.struct(value.alias("hyp"), error.alias("error")), "_pos").alias("h")).select("id", "h.hyp", "h.error")


def join_hypotheses(manifest: DataFrame, hyps: DataFrame) -> DataFrame:
    """Every manifest row with its hypothesis: _pos, id, ref, hyp, missing.

    A row without a hypothesis keeps an empty one (it scores as deleted); hypotheses of no row are left out.
    """
    last = last_hypotheses(hyps).select("id", F.col("hyp").alias("_hyp"))
    out = manifest.withColumn("id", F.col("id").cast("string")).join(last, "id", "left")
    rest = [c for c in manifest.columns if c not in ("id", "_pos", "text", "hyp", "ref")]
    return out.select("_pos", "id", F.coalesce("text", F.lit("")).alias("ref"), F.coalesce("_hyp", F.lit("")).alias("hyp"), F.col("_hyp").isNull().alias("missing"), *rest)


def failed_transcriptions(hyps: DataFrame) -> DataFrame:
    """n_failed and the first line of the first error: one row."""
    if "error" not in hyps.columns:
        return hyps.agg(F.lit(0).cast("long").alias("n_failed"), F.lit(None).cast("string").alias("first_error"))
    bad = F.coalesce(F.col("error").cast("string"), F.lit("")) != ""
    first = F.element_at(F.split(F.min_by(F.when(bad, F.col("error")), F.when(bad, F.col("_pos"))), "\n"), 1)
    return hyps.agg(F.count_if(bad).alias("n_failed"), first.alias("first_error"))


def require_columns(utts: DataFrame, *names: str) -> None:
    lacking = [n for n in names if n not in utts.columns]
    if lacking:
        raise ValueError(f"rows lack {', '.join(lacking)}; a dump written by score --out-utts has them")


def require_not_test(path: str, allowed: bool) -> None:
    """Error analysis of a test set leaks it into training."""
    if "test" in path.rsplit("/", 1)[-1].lower() and not allowed:
        raise PermissionError(f"{path} looks like a test set; analyse the dev split, or allow it explicitly")


def limit_rows(records: DataFrame, n: int | None) -> DataFrame:
    """The first n rows by place; none or 0: all."""
    return records.orderBy("_pos").limit(n) if n else records


def orthographic_variant(ref: Column, hyp: Column) -> Column:
    """A one-character substitution, which may be a spelling variant only."""
    return (F.char_length(ref) == 1) & (F.char_length(hyp) == 1)
