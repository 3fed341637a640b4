"""Where and how hypotheses collapse into a third script."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from ..functions.text import dominant_script


def span_of(rows: DataFrame, pos: str) -> Row:
    """lo, hi and n of the positions."""
    return rows.agg(F.min(pos).alias("lo"), F.max(pos).alias("hi"), F.count(F.lit(1)).alias("n")).first()


def equal_count_bins(rows: DataFrame, key: str, bins: int, pos: str, part: list[str] | None = None, name: str = "bin", ties: list[str] | None = None, rows_a_range: int = 1_000_000, span: Row | None = None) -> DataFrame:
    """``rows`` with the number of their bin by ``key``: bin b holds the sorted places from int(b * n / bins) up to int((b + 1) * n / bins).

    Not ntile: the edges are rounded products of doubles, which may leave the last row without a bin; such
    rows, and ones with a null key, are left out.  Equal keys are in order of ``ties`` and then ``pos`` (a whole number).
    Ranks come from the counts of keys by ranges of ``pos``, of about ``rows_a_range`` rows where those are spread
    evenly (``span``: from :func:`span_of`, where it is known), and rows are numbered within a key and a range only: neither the table nor a hot key is ever in one task.
    """
    part, ties = part or [], ties or []
    used = rows.where(F.col(key).isNotNull())
    span = span or span_of(used, pos)
    width = max(1, (int(span.hi or 0) - int(span.lo or 0) + 1) // max(1, span.n // rows_a_range))
    used = used.withColumn("_range", F.floor((F.col(pos) - F.lit(int(span.lo or 0))) / F.lit(width)))
    cell = [*part, key, *ties, "_range"]
    counts = used.groupBy(*cell).agg(F.count(F.lit(1)).alias("_c"))
    upto = Window.partitionBy(*part).orderBy(key, *ties, "_range")
    ranked = counts.withColumns({"_before": F.sum("_c").over(upto) - F.col("_c"), "_n": F.sum("_c").over(Window.partitionBy(*part))})
    # ties may be null
    other = ranked.drop("_c").select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(cell)], "_before", "_n")
    same = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(cell)])
    placed = used.join(other, same).withColumn("_r", F.col("_before") + F.row_number().over(Window.partitionBy(*cell).orderBy(pos)) - 1)
    step = F.col("_n").cast("double") / F.lit(float(bins))
    edge = lambda b: F.floor(b.cast("double") * step)
    near = F.floor(F.col("_r") / step)
    own = F.coalesce(*[F.when((F.col("_r") >= edge(near + d)) & (F.col("_r") < edge(near + d + 1)) & (near + d < bins), near + d) for d in (-1, 0, 1)])
    return placed.withColumn(name, own.cast("int")).where(F.col(name).isNotNull()).drop("_before", "_n", "_r", "_range", *[f"_k{i}" for i in range(len(cell))])


def _hits() -> Column:
    return F.count_if(F.coalesce("foreign_script", F.lit(False)))


def dose_response(rows: DataFrame, key: str = "cmi_ref", bins: int = 10, pos: str = "_pos", part: list[str] | None = None) -> DataFrame:
    """bin, lo, hi, n and collapsed by equal-count bins of ``key``."""
    binned = equal_count_bins(rows, key, bins, pos, part)
    return binned.groupBy(*(part or []), "bin").agg(F.min(key).alias("lo"), F.max(key).alias("hi"), F.count(F.lit(1)).alias("n"), _hits().alias("collapsed"))


def length_cmi_grid(rows: DataFrame, strata: int = 3, cells: int = 3, pos: str = "_pos") -> DataFrame:
    """stratum (by reference length), cell (by CMI within it), n and collapsed, with the stratum's lengths."""
    used = rows.where(F.col("cmi_ref").isNotNull() & (F.col("n_ref") > 0))
    span = span_of(used, pos)
    banded = equal_count_bins(used, "n_ref", strata, pos, name="stratum", span=span)
    # within a stratum ties on CMI keep the order by length
    celled = equal_count_bins(banded, "cmi_ref", cells, pos, ["stratum"], "cell", ["n_ref"], span=span)
    spans = banded.groupBy("stratum").agg(F.min("n_ref").alias("min_ref"), F.max("n_ref").alias("max_ref"))
    return celled.groupBy("stratum", "cell").agg(F.count(F.lit(1)).alias("n"), _hits().alias("collapsed")).join(spans, "stratum")


def onset(rows: DataFrame, bins: int = 10, pos: str = "_pos", part: list[str] | None = None) -> DataFrame:
    """onset (the lower CMI of the first bin with a collapse) and top_rate (the last bin's rate)."""
    table = dose_response(rows, "cmi_ref", bins, pos, part)
    first = F.min_by(F.when(F.col("collapsed") > 0, F.col("lo")), F.when(F.col("collapsed") > 0, F.col("bin")))
    last = F.max(F.when(F.col("bin") == bins - 1, F.col("collapsed") / F.col("n")))
    return table.groupBy(*(part or [])).agg(first.alias("onset"), F.coalesce(last, F.lit(0.0)).alias("top_rate"))


def concentration(rows: DataFrame, key: str) -> DataFrame:
    """key, total, collapsed and rate of the groups with a collapse."""
    out = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("total"), _hits().alias("collapsed")).where("collapsed > 0")
    return out.withColumn("rate", F.col("collapsed") / F.col("total"))


def top_share(groups: DataFrame, key: str, top: int = 8) -> DataFrame:
    """The share of all collapses in the ``top`` groups: groups, collapsed, covered, share."""
    best = groups.orderBy(F.desc("collapsed"), key).limit(top).select(F.lit(0).alias("groups"), F.lit(0).cast("long").alias("collapsed"), F.col("collapsed").alias("covered"))
    all_ = groups.select(F.lit(1).alias("groups"), "collapsed", F.lit(0).cast("long").alias("covered"))
    out = all_.unionByName(best).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("groups", "collapsed", "covered")])
    return out.withColumn("share", F.try_divide("covered", "collapsed"))


def group_means(rows: DataFrame) -> DataFrame:
    """Means of CMI, tokens and length, collapsed against normal."""
    means = [F.avg("cmi_ref").alias("mean_cmi"), F.avg("lang_ref.en").alias("mean_en"), F.avg("lang_ref.zh").alias("mean_zh"), F.avg("n_ref").alias("mean_len")]
    return rows.groupBy("foreign_script").agg(F.count(F.lit(1)).alias("n"), *means)


def deal(rng: np.random.Generator, sizes: np.ndarray, k: int) -> np.ndarray:
    """How many of ``k`` things drawn without replacement fall into each of the classes of ``sizes``.

    Each thing is taken with probability k / n, then things chosen evenly are added or put back until
    there are k: any k things are as likely as any others, for populations of any size.
    """
    took = rng.binomial(sizes, k / sizes.sum())
    over = int(took.sum()) - k
    if over:
        pool = took if over > 0 else sizes - took
        at = rng.choice(int(pool.sum()), abs(over), replace=False, shuffle=False)
        moved = np.bincount(np.searchsorted(np.cumsum(pool), at, side="right"), minlength=len(sizes))
        took = took - moved if over > 0 else took + moved
    return took


def _permute_blocks(counts: DataFrame, n: int, seed: int, rows_per_block: int = 100_000, tasks: int = 64) -> DataFrame:
    """The permutation test over v, c (how many there are) and k (how many of them are flagged) for any number of values: nothing but one count a block reaches the driver.

    Values are hashed into blocks.  A permutation deals its group to blocks
    by their sizes and within a block to values by their counts, so that the group has its exact size.
    """
    schema = "observed double, p_value double"
    blocks = max(1, -(-counts.count() // rows_per_block))
    counts = counts.withColumn("block", F.pmod(F.xxhash64("v"), F.lit(blocks)).cast("int"))
    sums = counts.groupBy("block").agg(F.sum("c").alias("c"), F.sum("k").alias("k"), F.sum(F.col("v") * F.col("k")).alias("a"), F.sum(F.col("v") * F.col("c")).alias("all")).orderBy("block").toPandas()
    size, k, inside, total = int(sums.c.sum()), int(sums.k.sum()), float(sums.a.sum()), float(sums["all"].sum())
    if k in (0, size):
        return counts.sparkSession.createDataFrame([(None, None)], schema)
    observed = abs(inside / k - (total - inside) / (size - k))
    sizes, place = sums.c.to_numpy(np.int64), {b: i for i, b in enumerate(sums.block.tolist())}
    slices = max(1, min(n, tasks // blocks))

    def draw(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        block, part = int(key[0]), int(key[1])
        rows = rows.sort_values("v")
        values, held = rows.v.to_numpy(), rows.c.to_numpy(np.int64)
        ids = range(part, n, slices)
        out = []
        for i in ids:
            own = deal(np.random.default_rng([seed, i]), sizes, k)[place[block]]
            out.append(float(values @ deal(np.random.default_rng([seed, i, block + 1]), held, int(own))))
        return pd.DataFrame({"id": list(ids), "some": out})

    dealt = counts.select("v", "c", "block", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("part"))
    drawn = dealt.groupBy("block", "part").applyInPandas(draw, "id long, some double").groupBy("id").agg(F.sum("some").alias("some"))
    gap = F.abs(F.col("some") / k - (F.lit(total) - F.col("some")) / (size - k))
    # sums in another order differ by rounding, and a tie counts
    hits = drawn.agg(F.count_if(gap >= observed - 1e-12 * max(1.0, abs(total) / size)).alias("hits")).first().hits
    return counts.sparkSession.createDataFrame([(observed, (hits + 1) / (n + 1))], schema)


def permutation_test(rows: DataFrame, value: str = "cmi_ref", flag: str = "foreign_script", n: int = 10_000, seed: int = 0, most: int = 2_000_000) -> DataFrame:
    """observed (difference of means) and p_value (two-sided), one row; null without two groups.

    Equal values are counted together, in the one pass over ``rows``.  All values go to all tasks while there are at
    most ``most`` of them (8 bytes each); more of them are permuted in blocks by their counts, see :func:`_permute_blocks`.
    Each permutation draws its own labels from its own seed, so the result does not depend on the partitioning.
    """
    used = rows.where(F.col(value).isNotNull()).select(F.col(value).cast("double").alias("v"), F.coalesce(flag, F.lit(False)).alias("f"))
    spark = rows.sparkSession
    counts = used.groupBy("v").agg(F.count(F.lit(1)).alias("c"), F.count_if("f").alias("k")).persist()
    try:
        size = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("size")).first().size
        if size > most:
            return _permute_blocks(counts, n, seed)
        pool = counts.toPandas().sort_values("v")
    finally:
        counts.unpersist()
    a, b = np.repeat(pool.v.to_numpy(), pool.k), np.repeat(pool.v.to_numpy(), pool.c - pool.k)
    schema = "observed double, p_value double"
    if not len(a) or not len(b):
        return spark.createDataFrame([(None, None)], schema)
    observed, k = float(abs(a.mean() - b.mean())), len(a)
    sent = spark.sparkContext.broadcast(np.concatenate([a, b]))

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        values = sent.value
        total = values.sum()
        for batch in batches:
            hits = 0
            for i in batch.id:
                some = np.random.default_rng([seed, int(i)]).choice(values, k, replace=False).sum()
                hits += abs(some / k - (total - some) / (len(values) - k)) >= observed - 1e-12
            yield pd.DataFrame({"hits": [hits]})

    hits = spark.range(n).mapInPandas(draw, "hits long").agg(F.sum("hits").alias("hits"))
    return hits.select(F.lit(observed).alias("observed"), ((F.col("hits") + 1) / F.lit(n + 1)).alias("p_value"))


def summarise_runs(runs: DataFrame, bins: int = 10, pos: str = "_pos", model: str = "model") -> DataFrame:
    """model, n, collapsed, rate, onset, top_rate, attractor (the commonest foreign script) and its share."""
    base = runs.groupBy(model).agg(F.count(F.lit(1)).alias("n"), _hits().alias("collapsed")).withColumn("rate", F.col("collapsed") / F.col("n"))
    scripts = runs.where("foreign_script").select(model, pos, dominant_script(F.col("hyp")).alias("script")).where("script is not null")
    each = scripts.groupBy(model, "script").agg(F.count(F.lit(1)).alias("c"), F.min(pos).alias("at"))
    best = each.groupBy(model).agg(F.max(F.struct("c", (-F.col("at")).alias("at"), "script")).alias("b")).select(model, F.col("b.script").alias("attractor"), F.col("b.c").alias("_c"))
    out = base.join(onset(runs, bins, pos, [model]), model, "left").join(best, model, "left")
    return out.select(model, "n", "collapsed", "rate", "onset", F.coalesce("top_rate", F.lit(0.0)).alias("top_rate"), F.coalesce("attractor", F.lit("-")).alias("attractor"), F.coalesce(F.try_divide("_c", "collapsed"), F.lit(0.0)).alias("attractor_share"))
