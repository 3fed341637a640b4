"""The thin queries of this subpackage: one for each operator, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .decontaminate import contaminated
from .line_dedup import dedup_lines
from .lm_scoring import score_documents
from .mixing import mix
from .pii import BASE, count_kind, find_spans, span_text
from .quality import judge
from .simhash_dedup import near_duplicates
from .token_counts import count_tokens
from .toxicity import score_toxicity
from .url_rules import ALLOW, BLOCK, filter_urls, path_of


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document: counts and digest of the base kinds, and all spans."""
    found = find_spans(read(spark, sf_dir, "documents"))
    return found.select("doc_id", *[count_kind("base", k).alias(f"n_{k}") for k in BASE], F.sha2(span_text(F.col("base")), 256).alias("base_sha256"), span_text(F.col("spans")).alias("spans"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items found in documents, one row for each pair."""
    return contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), k=5, radius=23, least=0.8)


def op3_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash of 3-word shingles; components of fingerprints within 3 bits."""
    return near_duplicates(read(spark, sf_dir, "documents"), words=3, radius=3)


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stupid-backoff scores of every document under the trigrams of all others, rounded, since sums have no fixed order."""
    out = score_documents(read(spark, sf_dir, "documents"), order=3, alpha=0.4)
    return out.select("doc_id", "n_words", F.round("log_score", 4).alias("log_score"), F.round("mean_log_score", 6).alias("mean_log_score"))


#: Fixed rules of the query: verdict and rule.
URL_RULES = [(ALLOW, "com/"), (BLOCK, "example.com/en/"), (ALLOW, "www.example.com/en/"), (BLOCK, "net/es/"), (BLOCK, "net/fr/")]


def page_labels(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """page_id and bad of the pages whose document is labelled: a page's path ends with the number of the document that it shows."""
    number = F.regexp_extract(path_of(F.col("url").cast("string")), r"/([0-9]{1,18})(?:[.][A-Za-z0-9]+)?/?$", 1)
    shown = pages.select("page_id", F.when(number != "", number).cast("long").alias("doc_id")).where("doc_id is not null")
    bad = (F.col("quality") == 0) | (F.col("toxic") == 1)
    return shown.join(labels.select("doc_id", bad.alias("bad")), "doc_id").select("page_id", "bad")


def op5_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every url; what is mined are pages that show a document of low quality, or a toxic one."""
    pages = read(spark, sf_dir, "pages")
    return filter_urls(pages, page_labels(pages, read(spark, sf_dir, "labels")), URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document as byte_bpe_50k.json counts them, against a limit of 1024."""
    return count_tokens(read(spark, sf_dir, "documents"), tokenizer_path(), limit=1024)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base figures and the verdict of the log-likelihood ratio on every document."""
    out = judge(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity scores of every document, learned from the rows that are not held out."""
    out = score_toxicity(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "labels"), threshold=0.7)
    return out.select("doc_id", "held_out", "score", "predicted")


#: Target weights by path; nodes that are not named weigh 1.
MIX_WEIGHTS = {
    ("web",): 5.0,
    ("books",): 3.0,
    ("reference",): 2.0,
    **{(d, lang): w for d in ("web", "books", "reference") for lang, w in (("en", 6.0), ("fr", 2.0), ("de", 2.0), ("es", 1.0))},
}
MIX_SHARE, MIX_EPOCHS, MIX_SEED = 0.5, 4.0, 11


def with_domain(docs: DataFrame) -> DataFrame:
    """The domain of a document, by its source's number: src0 to src9 web, to src14 books, to src19 reference; others: none."""
    number = F.regexp_extract(F.col("source").cast("string"), "^src([0-9]{1,4})$", 1)
    number = F.when(number != "", number).cast("int")
    return docs.withColumn("domain", F.when(number < 10, "web").when(number < 15, "books").when(number < 20, "reference").otherwise("other"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half of all tokens, dealt to domains, languages and sources by their weights."""
    docs = with_domain(read(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"))
    return mix(docs, MIX_SHARE, MIX_WEIGHTS, MIX_EPOCHS, MIX_SEED)


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of 40 characters or more in 5 or more documents stay in the last one only."""
    out = dedup_lines(read(spark, sf_dir, "documents").select("doc_id", "text"), min_chars=40, min_docs=5)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pii": op1_pii,
    "op2_decontaminate": op2_decontaminate,
    "op3_simhash_dedup": op3_simhash_dedup,
    "op4_lm_scoring": op4_lm_scoring,
    "op5_url_rules": op5_url_rules,
    "op6_token_counts": op6_token_counts,
    "op7_quality": op7_quality,
    "op8_toxicity": op8_toxicity,
    "op9_line_dedup": op9_line_dedup,
    "op10_mixing": op10_mixing,
}
