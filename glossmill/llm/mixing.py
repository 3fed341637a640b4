"""Mixing sources to target weights by hierarchical budgeting.

A tree of domains, languages and sources has a weight at each node.  The token budget goes
down the tree in proportion to the weights; what a child cannot supply (its tokens times
the most epochs) goes to its siblings first, and to those of an ancestor only where all
siblings are used up.  Each leaf then takes whole epochs and a token-prefix of one more, in an
order that the seed and the epoch's number fix.

The prefix is found without sorting a leaf in one task: the order keys are cut into ranges of
about ``rows_a_range`` rows, the ranges' sums are accumulated, and only the one
range in which a leaf's budget ends is looked at row by row.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import hash_words, materialize, row_slices, text_buffer, thrifty

LEVELS = ("domain", "lang", "source")
_KEY_BITS = 40


def share_out(budget: float, weights: Sequence[float], limits: Sequence[float]) -> list[float]:
    """``budget`` in proportion to ``weights``, none above its limit; what one cannot take goes to the others."""
    out = [0.0] * len(weights)
    open_ = [i for i, w in enumerate(weights) if w > 0 and limits[i] > 0]
    left = budget
    while open_ and left > 1e-9:
        total = sum(weights[i] for i in open_)
        full = [i for i in open_ if limits[i] - out[i] <= left * weights[i] / total]
        if not full:
            for i in open_:
                out[i] += left * weights[i] / total
            break
        for i in full:
            left -= limits[i] - out[i]
            out[i] = limits[i]
        open_ = [i for i in open_ if i not in set(full)]
    return out


def budgets(supply: Mapping[tuple, int], total: float, weights: Mapping[tuple, float], most_epochs: float) -> dict[tuple, float]:
    """Tokens for each leaf.  ``weights``: by path from the root, 1 where a node is not named."""
    held: dict[tuple, float] = defaultdict(float)
    children: dict[tuple, set] = defaultdict(set)
    for leaf, tokens in supply.items():
        for depth in range(len(leaf) + 1):
            held[leaf[:depth]] += tokens * most_epochs
            if depth:
                children[leaf[: depth - 1]].add(leaf[:depth])
    out: dict[tuple, float] = {(): min(total, held[()])} if supply else {}
    for depth in range(len(LEVELS)):
        for node in [n for n in out if len(n) == depth]:
            own = sorted(children[node], key=lambda c: [(x is None, str(x)) for x in c])
            parts = share_out(out[node], [weights.get(c, 1.0) for c in own], [held[c] for c in own])
            out.update(zip(own, parts))
    return {leaf: out[leaf] for leaf in supply}


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = text_buffer(batch.column(1))
        counts = [np.diff(hash_words(data, offsets[a : b + 1])[3]) for a, b in row_slices(offsets)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(counts) if counts else np.zeros(0, np.int64))], ["row", "n_tokens"])


def mix(docs: DataFrame, total_share: float, weights: Mapping[tuple, float], most_epochs: float = 4.0, seed: int = 0, rows_a_range: int = 1000, broadcast_leaves: int = 20_000, max_leaves: int = 1_000_000) -> DataFrame:
    """doc_id, domain, lang, source, n_tokens and copies (at least 1) of the rows selected.

    ``docs``: doc_id, text, domain, lang and source; other columns are ignored.  The budget is ``total_share`` of all
    tokens (words).  Each leaf gets whole epochs while they fit its budget, then the rows of one more
    epoch, in its seeded order, while their running sum fits the rest.

    Null levels are leaves of their own.  Null and empty texts have no tokens: they go with the
    rows before them in the order.  Rows that share a doc_id are taken or left together.  An empty table gives
    an empty result.  The tree (not the rows) is worked on by the driver; over ``max_leaves`` leaves are an error.
    Its table goes to all tasks up to ``broadcast_leaves`` leaves; larger ones are joined by a shuffle.
    """
    slim = docs.select(F.struct("doc_id", *LEVELS).alias("row"), F.col("text").cast("string").alias("text"))
    sized = slim.mapInArrow(thrifty(_word_counts), T.StructType([slim.schema["row"], T.StructField("n_tokens", T.LongType())]))
    rows = materialize(sized.select("row.*", "n_tokens"), "mix")
    leaves = rows.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("n_tokens"), F.count(F.lit(1)).alias("n")).limit(max_leaves + 1).collect()
    if len(leaves) > max_leaves:
        raise ValueError(f"more than {max_leaves} leaves")
    supply = {(r.domain, r.lang, r.source): r.n_tokens for r in leaves}
    sizes = {(r.domain, r.lang, r.source): r.n for r in leaves}
    parts = budgets(supply, total_share * sum(supply.values()), weights, most_epochs)
    plan = []
    for i, (leaf, tokens) in enumerate(parts.items()):
        whole = int((tokens + 1e-6) // supply[leaf]) if supply[leaf] else 0
        plan.append((*leaf, i, whole, int(tokens + 1e-6) - whole * supply[leaf] if supply[leaf] else 0, -(-sizes[leaf] // rows_a_range)))
    schema = T.StructType([*[rows.schema[c] for c in LEVELS], *[T.StructField(c, T.LongType()) for c in ("leaf", "whole", "rest", "ranges")]])
    for f in schema.fields:
        f.nullable = True
    sent = F.broadcast if len(plan) <= broadcast_leaves else (lambda df: df)
    table = sent(docs.sparkSession.createDataFrame(plan, schema))
    same = [rows[c].eqNullSafe(table[c]) for c in LEVELS]
    keyed = rows.join(table, same[0] & same[1] & same[2]).select(*[rows[c] for c in rows.columns], "leaf", "whole", "rest", "ranges")
    keyed = keyed.withColumn("turn", F.pmod(F.xxhash64(F.lit(seed), F.col("whole") + 1, F.col("doc_id").cast("string")), F.lit(1 << _KEY_BITS)))
    keyed = keyed.withColumn("range", F.floor(F.col("turn") * F.col("ranges") / (1 << _KEY_BITS)))
    sums = keyed.groupBy("leaf", "rest", "range").agg(F.sum("n_tokens").alias("t"))
    run = sums.withColumn("upto", F.sum("t").over(Window.partitionBy("leaf").orderBy("range")))
    # the range in which the budget ends: the first whose sum goes over it
    ends = run.where(F.col("upto") > F.col("rest")).groupBy("leaf").agg(F.min("range").alias("last"), F.min_by(F.col("upto") - F.col("t"), "range").alias("before"))
    placed = keyed.join(sent(ends), "leaf", "left")
    sure = placed.where("last is null or range <> last").withColumn("extra", (F.col("last").isNull() | (F.col("range") < F.col("last"))).cast("long"))
    edge = placed.where("range = last")
    upto = F.sum("n_tokens").over(Window.partitionBy("leaf").orderBy("turn", "doc_id").rangeBetween(Window.unboundedPreceding, Window.currentRow))
    edge = edge.withColumn("extra", (F.col("before") + upto <= F.col("rest")).cast("long"))
    out = sure.unionByName(edge).withColumn("copies", F.col("whole") + F.col("extra"))
    return out.where("copies > 0").select("doc_id", *LEVELS, "n_tokens", "copies")
