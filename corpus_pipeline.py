"""The corpus pipeline: from raw documents to a mixed, clean training set.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; its rows are written and read
again as the next one's docs.  All but the last return the columns of documents; other columns of docs, whatever
their names, are passed over.  Of an empty table every stage makes an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossmill.llm._common import drop_scratch, materialize, scratch_scope
from glossmill.llm.decontaminate import contaminated
from glossmill.llm.line_dedup import dedup_lines
from glossmill.llm.mixing import mix
from glossmill.llm.queries import MIX_EPOCHS, MIX_SEED, MIX_SHARE, MIX_WEIGHTS, read, with_domain
from glossmill.llm.simhash_dedup import similar_groups
from glossmill.llm.toxicity import score_toxicity
from glossmill.session import ship

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go.

    Null and empty texts score as the classifier's bias does, and stay; repeated rows are each judged alike; without
    labels nothing goes.
    """
    out = score_toxicity(docs.select(*COLUMNS), read(spark, sf_dir, "labels"), threshold=0.7)
    return out.where("predicted = 0").select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that five documents or more share stay in the last one only; n_chars follows the text.

    Every row stays: a null text becomes an empty one, and a text may lose all its lines.
    """
    out = dedup_lines(docs.select(*COLUMNS), min_chars=40, min_docs=5)
    return out.select("doc_id", F.col("kept_text").alias("text"), "lang", "source", F.when(F.col("n_dropped") > 0, F.length("kept_text").cast("long")).otherwise(F.col("n_chars")).alias("n_chars"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest doc_id stays (all rows of it).

    Texts without words are alike, so one of them stays.  Rows with a null doc_id are in no group and stay.
    """
    with scratch_scope(spark) as kept:
        groups = similar_groups(docs, words=5, radius=16, wide=24, least=0.8)
        gone = materialize(groups.where("component_id <> doc_id").select("doc_id").distinct(), "gone")
        kept.append(gone)
    # the texts move only if the ids of what goes are too many to send round
    return docs.select(*COLUMNS).join(gone, "doc_id", "left_anti")


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go, with all rows of theirs.

    Null and empty texts hold nothing; rows with a null doc_id stay, as no id names them.
    """
    found = contaminated(docs, read(spark, sf_dir, "benchmark"), k=5, radius=23, least=0.8)
    return docs.select(*COLUMNS).join(found.select("doc_id").distinct(), "doc_id", "left_anti")


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, domain, lang, source, n_tokens and copies of the documents in the mix.

    Null levels are leaves of their own; ties in the seeded order are taken or left together.
    """
    return mix(with_domain(docs), MIX_SHARE, MIX_WEIGHTS, MIX_EPOCHS, MIX_SEED)


def _shipped(stage):
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        ship(spark)
        return stage(spark, docs, sf_dir)

    return run


STAGES = [
    ("toxicity", _shipped(toxicity)),
    ("line dedup", _shipped(line_dedup)),
    ("near dedup", _shipped(near_dedup)),
    ("decontamination", _shipped(decontaminate)),
    ("mixing", _shipped(mixing)),
]

#: SQL cannot express the trained classifier; tests/llm/test_pipeline.py tests the stages by brute force, and the classifier on held-out rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other over the documents of ``sf_dir``.

    A stage's input and its scratch tables are dropped as soon as its own rows are written.
    """
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        last = docs
        with scratch_scope(spark) as kept:
            docs = materialize(stage(spark, last, sf_dir), name.replace(" ", "_"))
            kept.append(docs)
        if hasattr(last, "_scratch"):
            drop_scratch(spark, last)
    return STAGES[-1][1](spark, docs, sf_dir)
