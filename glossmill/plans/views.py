"""The code-mixing view of a driver table that the registered queries work on.

Every sentence of every conversation turn, whole texts of the whole table, is an utterance.  Some Latin letters are
turned into ideographs, which makes the references mixed, and eight classes of hypotheses are derived from them by
the utterance's place in its conversation: perfect, without English, without Chinese, repeated, translated
(with variant characters), in a foreign script (or, every second time, the reference before), and the references of the neighbours, crossed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.scoring import score_utterances

MIXED_FROM, MIXED_TO = "kwxyzjqv", "今日我好你係開會"
VARIANT_FROM, VARIANT_TO = "你係", "妳系"
THAI_FROM, THAI_TO = "abcdefghij", "กขคงจฉชซฌญ"


def utterances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """_pos, id, conv_id (as speaker and folder), role (as topic), index (place in the conversation, from 0), ref."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    said = turns.select("conv_id", "turn", "role", F.posexplode(F.split(F.coalesce("text", F.lit("")), "[.!?\\n]+")).alias("k", "u"))
    said = said.select("conv_id", "turn", "role", "k", F.translate(F.lower(F.btrim("u", F.lit(" "))), MIXED_FROM, MIXED_TO).alias("ref")).where("ref <> ''")
    place = Window.partitionBy("conv_id").orderBy("turn", "k")
    out = said.withColumn("index", (F.row_number().over(place) - 1).cast("long"))
    key = (F.col("conv_id") * 1_000_000 + F.col("index")).cast("long")
    return out.select(key.alias("_pos"), key.alias("id"), "conv_id", "role", "index", "ref")


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """utterances with k (the class) and hyp."""
    place = Window.partitionBy("conv_id").orderBy("index")
    u = utterances(spark, sf_dir).withColumns({"nx": F.lead("ref").over(place), "pv": F.lag("ref").over(place), "k": F.col("index") % 8})
    ref = F.col("ref")
    hyp = (
        F.when(F.col("k") == 0, ref)
        .when(F.col("k") == 1, F.regexp_replace(ref, r"[A-Za-z\x{c0}-\x{24f}]+", ""))
        .when(F.col("k") == 2, F.regexp_replace(ref, r"[\x{4e00}-\x{9fff}]", ""))
        .when(F.col("k") == 3, F.concat_ws(" ", ref, ref, ref))
        .when(F.col("k") == 4, F.translate(F.regexp_replace(ref, "th[a-z]*", "會議"), VARIANT_FROM, VARIANT_TO))
        .when(F.col("index") % 16 == 13, F.coalesce("pv", F.lit("")))
        .when(F.col("k") == 5, F.translate(ref, THAI_FROM, THAI_TO))
        .when(F.col("k") == 6, F.coalesce("nx", F.lit("")))
        .otherwise(F.coalesce("pv", F.lit("")))
    )
    return u.select("_pos", "id", "conv_id", "role", "index", "k", "ref", hyp.alias("hyp"))


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_utterances(pairs(spark, sf_dir))
