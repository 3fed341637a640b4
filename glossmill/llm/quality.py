"""Quality rules and a hashed n-gram log-likelihood ratio, in DataFrame operations only.

Words and word pairs are hashed to buckets.  One pass over the corpus counts
the buckets of all texts (the raw multinomial) and of the trusted ones
(the target multinomial); a text's score is the mean, over its n-grams, of
log(target share / raw share), so that long texts do not score higher for their length.
A text is kept if the base rules pass it and its score reaches the threshold, always the
same way.  No text is drawn by lot.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = "[\\x20\\x09-\\x0D]+"
SYMBOLS = "[^#*$%&|<>]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once: a column used inside lambdas would be computed at every use."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(text: Column) -> Column:
    """The words of a text, an array; no word: an empty array."""
    return F.filter(F.split(text, SPACE, -1), lambda w: w != "")


def repeat_words(words: Column) -> Column:
    """How many words lie in 3-word windows that are found twice or more in the text, the first finding included.

    Windows go by a 64-bit hash.  Where none repeats (a linear test) the sort is skipped.
    """
    n = F.size(words)
    hashes = F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))

    def in_order(h: Column) -> Column:
        return F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

    def count(h: Column) -> Column:
        return F.when(F.size(F.array_distinct(h)) < F.size(h), let(in_order(h), _covered)).otherwise(F.lit(0))

    return F.when(n >= 3, let(hashes, count)).otherwise(F.lit(0))


def _covered(ordered: Column) -> Column:
    """The number of places covered by windows that equal a neighbour in the sorted order."""
    like = lambda x, k: F.coalesce(x["h"] == F.get(ordered, k)["h"], F.lit(False))
    same = F.filter(ordered, lambda x, k: like(x, k - 1) | like(x, k + 1))
    return F.size(F.array_distinct(F.flatten(F.transform(same, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))))


def base_rules(text: Column, words: Column) -> list[Column]:
    """``text`` and ``words`` are bound by :func:`let`."""
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.regexp_like(x, F.lit("[^\\x20\\x09-\\x0D]")))
    return [
        F.size(words).cast("long").alias("n_words"),
        F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace(text, SYMBOLS, "")).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        repeat_words(words).cast("long").alias("n_repeat_words"),
    ]


def buckets_of(words: Column, buckets: int) -> Column:
    """Bucket of each word and of each pair of neighbours."""
    single = F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(buckets)).cast("int"))
    pairs = F.transform(F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))), lambda w, i: F.pmod(F.xxhash64(F.get(words, i), w), F.lit(buckets)).cast("int"))
    return F.concat(single, pairs)


def log_ratios(docs: DataFrame, labels: DataFrame, buckets: int, broadcast_ids: int, prior: float) -> list[float]:
    """log(target share / raw share) of each bucket; the target is smoothed towards the raw shares with ``prior`` pseudo-counts a bucket."""
    trusted = labels.where("quality = 1 and doc_id is not null").select("doc_id").distinct().withColumn("trusted", F.lit(1))
    sent = F.broadcast(trusted) if trusted.count() <= broadcast_ids else trusted
    flagged = docs.join(sent, "doc_id", "left")
    words = words_of(F.coalesce(F.col("text").cast("string"), F.lit("")))
    counts = flagged.select(F.explode(let(words, lambda w: buckets_of(w, buckets))).alias("bucket"), "trusted").groupBy("bucket").agg(F.count(F.lit(1)).alias("raw"), F.count("trusted").alias("target"))
    raw, target = [0] * buckets, [0] * buckets
    for r in counts.collect():  # ``buckets`` rows at most
        raw[r["bucket"]], target[r["bucket"]] = r["raw"], r["target"]
    n_raw, n_target = sum(raw), sum(target)
    share = [(x + 1) / (n_raw + buckets) for x in raw]
    return [math.log((t + prior * buckets * s) / (n_target + prior * buckets) / s) for t, s in zip(target, share)]


def judge(docs: DataFrame, labels: DataFrame, threshold: float = -0.04, buckets: int = 1 << 14, broadcast_ids: int = 1_000_000, prior: float = 1.0, min_words: int = 50, max_repeat_percent: int = 50) -> DataFrame:
    """doc_id, the base figures, base_failed, score and kept, one row for each row of ``docs``.

    ``docs``: doc_id, text; ``labels``: doc_id, quality (1: trusted).  All trusted documents make the target, all rows
    the raw counts.  Other columns are ignored.  Trusted ids go to all tasks while there are at most ``broadcast_ids``
    of them (8 bytes each); more are joined by a shuffle.

    Null and empty texts have no words: all counts 0, score 0, base_failed.  Rows that share
    a doc_id are each judged.  Without trusted documents every score is about 0.  An empty
    table gives an empty result.
    """
    slim = docs.select("doc_id", "text")
    ratios = log_ratios(slim, labels, buckets, broadcast_ids, prior)
    table = F.split(F.lit(",".join(f"{x:.9g}" for x in ratios)), ",").cast("array<double>")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))

    def figures(words: Column) -> Column:
        total = F.aggregate(buckets_of(words, buckets), F.lit(0.0), lambda acc, b: acc + F.get(table, b))
        n_grams = F.greatest(2 * F.size(words) - 1, F.lit(1))
        return F.struct(*base_rules(F.col("text"), words), (total / n_grams).alias("score"))

    out = slim.select("doc_id", text.alias("text")).select("doc_id", let(words_of(F.col("text")), figures).alias("f")).select("doc_id", "f.*")
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    return out.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("score") >= threshold))
