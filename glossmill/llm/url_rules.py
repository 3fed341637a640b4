"""URL filters by association rules.

URLs are sets of tokens (labels of the host, directories of the path, shape of the last
segment and of the query).  Spark's FP-growth mines token combinations from the pages labelled bad; those
whose support, confidence and lift are high enough become rules, and rules that a more general
one makes needless are pruned.  An inverted index matches them: rules hang on their
rarest token, so a URL looks only at the rules of its own tokens.

Fixed host and path rules come first: the longest that fits decides.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import hash_sample, materialize, scratch_scope, thrifty

ALLOW, BLOCK = "allow", "block"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; null or without :// : empty."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ?, # or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def fixed_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """The longest rule that fits, null for none.

    ``rules``: verdict and rule, the rule being a host, a slash and the beginning of a path.  A rule fits its
    host and all subdomains.  Of equally long ones the first in order of text decides.
    """
    out = F.lit(None).cast("string")
    for _, rule in sorted(rules, key=lambda r: (len(r[1]), [-ord(c) for c in r[1]])):
        own, _, rest = rule.partition("/")
        fits = ((host == own) | F.endswith(host, F.lit("." + own))) & F.startswith(path, F.lit("/" + rest))
        out = F.when(fits, F.lit(rule)).otherwise(out)
    return out


def url_tokens(host: Column, path: Column, url: Column) -> Column:
    """Distinct tokens of a URL, an array."""
    labels = F.split(host, "[.]")
    words = F.flatten(F.transform(labels, lambda x: F.split(x, "[^a-z0-9]+")))
    dirs = F.split(F.translate(path, _UPPER, _LOWER), "/")
    shape = lambda x: F.regexp_replace(x, "[0-9]+", "9")
    query = F.regexp_extract_all(F.coalesce(url, F.lit("")), F.lit(r"[?&]([A-Za-z0-9_]+)="), F.lit(1))
    scheme = F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"\A([A-Za-z]+)://", 1))
    parts = [
        F.transform(labels, lambda x: F.concat(F.lit("h:"), x)),
        F.transform(words, lambda x: F.concat(F.lit("w:"), x)),
        F.transform(dirs, lambda x: F.concat(F.lit("p:"), shape(x))),
        F.transform(query, lambda x: F.concat(F.lit("q:"), F.lower(x))),
        F.array(F.concat(F.lit("s:"), scheme)),
        F.when(host != "", F.array(F.concat(F.lit("d:"), host))).otherwise(F.array().cast("array<string>")),
    ]
    return F.filter(F.array_distinct(F.concat(*parts)), lambda x: F.length(x) > 2)


def combinations(labelled: DataFrame, min_count: int, most_sent: int = 50_000) -> DataFrame:
    """items, bad, n, confidence and lift of the token combinations that at least ``min_count`` bad rows of ``labelled`` have.

    ``labelled``: row (an id), tokens, bad.  Of tokens that are in the very same rows (a host and its labels, say) one stands for
    all, the shortest; such sets would double the combinations with each.  FP-growth runs over the bad rows
    alone, since a combination must be frequent there; the rows of either outcome that have it are counted by a join
    on its rarest token, to which the combinations are sent while there are at most ``most_sent`` of them.
    """
    said = labelled.select("row", "bad", F.explode("tokens").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.count_if("bad").alias("bad"), F.sum(F.xxhash64("row").cast("decimal(38,0)")).alias("rows"))
    tokens = said.where(F.col("bad") >= min_count).groupBy("n", "rows").agg(F.min(F.struct(F.length("token").alias("l"), "token")).alias("t")).select(F.col("t.token").alias("token"), "n")
    # each is in a share of all rows, so there are at most as many as a row's tokens by that share: few enough to send
    tokens = materialize(tokens, "tokens")
    slim = labelled.select("row", "bad", F.explode("tokens").alias("token")).join(F.broadcast(tokens.select("token")), "token").groupBy("row", "bad").agg(F.collect_list("token").alias("items"))
    slim = materialize(slim, "items")
    bad = slim.where("bad")
    n_bad = bad.count()
    if n_bad < min_count:
        return labelled.sparkSession.createDataFrame([], "items array<string>, bad long, n long, confidence double, lift double")
    sets = FPGrowth(itemsCol="items", minSupport=min_count / n_bad).fit(bad.select("items")).freqItemsets
    sets = materialize(sets.select(F.array_sort("items").alias("items"), F.col("freq").alias("bad")), "sets")
    rarest = sets.select("items", F.explode("items").alias("token")).join(F.broadcast(tokens), "token").groupBy("items").agg(F.min_by("token", F.struct("n", "token")).alias("token"))
    rarest = F.broadcast(rarest) if sets.count() <= most_sent else rarest.hint("merge")
    # the table is small in bytes, and one task would read it all
    dealt = slim.repartition(int(slim.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    found = dealt.select(F.col("items").alias("own"), F.explode("items").alias("token")).join(rarest, "token").where(F.size(F.array_except("items", "own")) == 0)
    counted = found.groupBy("items").agg(F.count(F.lit(1)).alias("n"))
    rate = labelled.agg(F.avg(F.col("bad").cast("double")).alias("rate")).first().rate
    out = sets.join(counted, "items").withColumn("confidence", F.col("bad") / F.col("n"))
    return out.withColumn("lift", F.col("confidence") / rate)


def prune(rules: DataFrame) -> list[tuple[tuple[str, ...], float]]:
    """Rules and their confidences, the shortest and surest first, without those that a part of theirs makes needless."""
    found = sorted(((tuple(r["items"]), float(r.confidence)) for r in rules.toLocalIterator()), key=lambda r: (len(r[0]), -r[1], r[0]))
    kept: dict[tuple[str, ...], float] = {}
    by_token: dict[str, list[tuple[str, ...]]] = {}
    for tokens, confidence in found:
        parts = (t for token in tokens for t in by_token.get(token, ()))
        if not any(kept[t] >= confidence and set(t) <= set(tokens) for t in parts):
            kept[tokens] = confidence
            by_token.setdefault(tokens[0], []).append(tokens)
    return list(kept.items())


def invert(rules: Sequence[tuple[tuple[str, ...], float]]) -> dict[str, list[tuple[frozenset, float]]]:
    """Rules by the one of their tokens that the fewest rules have."""
    use: dict[str, int] = {}
    for tokens, _ in rules:
        for t in tokens:
            use[t] = use.get(t, 0) + 1
    out: dict[str, list[tuple[frozenset, float]]] = {}
    for tokens, confidence in rules:
        out.setdefault(min(tokens, key=lambda t: (use[t], t)), []).append((frozenset(tokens), confidence))
    return out


def _match(index):
    """The surest rule that fits each row's tokens, or the confidence that the row brings along."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = index()
        for batch in batches:
            out = []
            for tokens, best in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                own = set(tokens)
                for t in tokens:
                    for need, confidence in table.get(t, ()):
                        if confidence > best and need <= own:
                            best = confidence
                out.append(best)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.float64())], ["row", "tokens", "confidence"])

    return rows


def labelled_tokens(parts: DataFrame, labels: DataFrame, max_labelled: int) -> DataFrame:
    """row, tokens and bad of the labelled pages, or of about ``max_labelled`` of them by the hash of page_id."""
    known = parts.join(labels.where("bad is not null").select("page_id", "bad"), "page_id")
    # ids are fixed when the table is written
    return hash_sample(known.select("page_id", "tokens", "bad"), "page_id", max_labelled).select(F.monotonically_increasing_id().alias("row"), "tokens", "bad")


def tokenized(pages: DataFrame) -> DataFrame:
    """page_id, url, host, path and tokens."""
    url = F.col("url").cast("string")
    parts = pages.select("page_id", url.alias("url")).withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    return parts.withColumn("tokens", url_tokens(F.col("host"), F.col("path"), F.col("url")))


def filter_urls(pages: DataFrame, labels: DataFrame, rules: Sequence[tuple[str, str]], min_support: float = 0.002, min_count: int = 8, min_confidence: float = 0.6, min_lift: float = 2.0, max_labelled: int = 200_000, max_rules: int = 50_000) -> DataFrame:
    """page_id, host, path, rule and verdict, with confidence (of the best mined rule), one row for each row of ``pages``.

    ``pages``: page_id, url; ``labels``: page_id, bad (boolean); other columns are ignored.  Mining uses the labelled pages,
    or about ``max_labelled`` of them by the hash of page_id, and a combination, of any number of tokens, must be in as many bad ones as
    ``min_support`` of all and ``min_count`` make; every url is judged.  A url that no
    fixed rule fits is blocked if a mined rule matches it, else allowed.

    A null url, and one without ://, has an empty host and path, no rule and the verdict allow unless mined rules say otherwise.
    Rows that share a page_id are each judged; contradicting labels count once each, repeated rows each time.  Empty tables: nothing
    is mined, an empty result.  Mined rules go to the tasks in parts of ``max_rules``, one after the other.
    """
    spark = pages.sparkSession
    parts = tokenized(pages)
    with scratch_scope(spark):
        known = materialize(labelled_tokens(parts, labels, max_labelled), "labelled")
        least = max(min_count, math.ceil(min_support * known.count()))
        mined = prune(combinations(known, least).where((F.col("confidence") >= min_confidence) & (F.col("lift") >= min_lift)))
    row = F.struct("page_id", "host", "path", fixed_rule(F.col("host"), F.col("path"), rules).alias("rule")).alias("row")
    out = parts.select(row, "tokens", F.lit(0.0).alias("confidence"))
    for a in range(0, len(mined), max_rules):
        sent = spark.sparkContext.broadcast(invert(mined[a : a + max_rules]))
        out = out.mapInArrow(thrifty(lambda it, sent=sent: _match(lambda: sent.value)(it)), T.StructType([out.schema["row"], out.schema["tokens"], T.StructField("confidence", T.DoubleType())]))
    verdicts = F.create_map(*[F.lit(x) for verdict, rule in rules for x in (rule, verdict)])
    verdict = F.when(F.col("row.rule").isNotNull(), F.element_at(verdicts, F.col("row.rule"))).when(F.col("confidence") > 0, BLOCK).otherwise(ALLOW)
    return out.select("row.*", verdict.alias("verdict"), "confidence")
