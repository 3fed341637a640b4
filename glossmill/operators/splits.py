"""Speaker-disjoint splits, with a check that they are comparable.

Folders are speakers.  Ratios round half to even.  The folder table (one row each) is what is numbered; the
rows only join to it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import EN, ZH, code_mixing_index, count_lang, token_langs, tokens


def folder_table(rows: DataFrame, folder: str = "folder", topic: str = "topic", folders: DataFrame | None = None) -> DataFrame:
    """folder, signature (its sorted topics) and n of each folder; ``folders`` names ones that have no rows, too."""
    own = rows.groupBy(folder).agg(F.array_sort(F.collect_set(topic)).alias("signature"), F.count(F.lit(1)).alias("n"))
    if folders is None:
        return own
    none = F.array().cast("array<string>")
    return folders.select(folder).distinct().join(own, folder, "left").select(folder, F.coalesce("signature", none).alias("signature"), F.coalesce("n", F.lit(0)).alias("n"))


def _taken(n, ratio: float):
    return F.greatest(F.lit(1), F.bround(n * F.lit(ratio), 0).cast("int"))


def positional_split(folders: DataFrame, train_folders: int = 112, train_ratio: float = 0.7, folder: str = "folder") -> DataFrame:
    """The first ``train_folders`` folders train; with fewer folders than that, ``train_ratio`` of them."""
    w = Window.orderBy(folder)  # over folders, one row each
    ranked = folders.withColumns({"rank": F.row_number().over(w), "total": F.count(F.lit(1)).over(Window.partitionBy())})
    n_train = F.when(F.col("total") < train_folders, _taken(F.col("total"), train_ratio)).otherwise(F.lit(train_folders))
    return ranked.withColumn("split", F.when(F.col("rank") <= n_train, "train").otherwise("test")).drop("rank", "total")


def stratified_split(folders: DataFrame, train_ratio: float = 0.7, folder: str = "folder") -> DataFrame:
    """``train_ratio`` of each group of folders with the same topics; a folder alone trains."""
    w = Window.partitionBy("signature")
    ranked = folders.withColumns({"rank": F.row_number().over(w.orderBy(folder)), "total": F.count(F.lit(1)).over(w)})
    n_train = F.when(F.col("total") > 1, _taken(F.col("total"), train_ratio)).otherwise(F.col("total"))
    return ranked.withColumn("split", F.when(F.col("rank") <= n_train, "train").otherwise("test")).drop("rank", "total")


def carve_dev(split: DataFrame, dev_ratio: float, stratify: bool = False, folder: str = "folder") -> DataFrame:
    """Part of the training folders becomes dev, by the rule that made the split."""
    if dev_ratio <= 0:
        return split
    if dev_ratio >= 1:
        raise ValueError(f"dev_ratio must be in (0, 1), got {dev_ratio}")
    train = split.where("split = 'train'").drop("split")
    keep = 1.0 - dev_ratio
    if stratify:
        cut = stratified_split(train, keep, folder)
    else:
        w = Window.orderBy(folder)
        ranked = train.withColumns({"rank": F.row_number().over(w), "total": F.count(F.lit(1)).over(Window.partitionBy())})
        cut = ranked.withColumn("split", F.when(F.col("rank") <= _taken(F.col("total"), keep), "train").otherwise("test")).drop("rank", "total")
    return split.where("split <> 'train'").unionByName(cut.withColumn("split", F.when(F.col("split") == "test", "dev").otherwise("train")))


def split_rows(rows: DataFrame, split: DataFrame, folder: str = "folder") -> DataFrame:
    return rows.join(split.select(folder, "split"), folder)


def split_profile(rows: DataFrame, text: str = "text") -> DataFrame:
    """n, mean_cmi and en_share (of zh and en tokens) of each split."""
    t = rows.select("split", token_langs(tokens(F.col(text))).alias("langs"))
    t = t.select("split", code_mixing_index(F.col("langs")).alias("cmi"), count_lang(F.col("langs"), EN).alias("en"), count_lang(F.col("langs"), ZH).alias("zh"))
    out = t.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.avg("cmi").alias("mean_cmi"), F.sum("en").alias("en"), F.sum("zh").alias("zh"))
    return out.withColumn("en_share", F.coalesce(F.try_divide("en", F.col("zh") + F.col("en")), F.lit(0.0)))


def topic_shares(rows: DataFrame, topic: str = "topic") -> DataFrame:
    """split, topic and the topic's share of its split."""
    n = rows.groupBy("split", F.col(topic).alias("topic")).agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("split")))


def topic_gaps(rows: DataFrame, left: str = "train", right: str = "test", tolerance: float = 0.05, topic: str = "topic") -> DataFrame:
    """Topics common on one side and next to absent on the other: topic, left_share, right_share, missing_from."""
    shares = topic_shares(rows, topic)
    a = shares.where(F.col("split") == left).select("topic", F.col("share").alias("left_share"))
    b = shares.where(F.col("split") == right).select("topic", F.col("share").alias("right_share"))
    both = a.join(b, "topic", "full_outer").fillna(0.0, ["left_share", "right_share"])
    gone = F.when((F.col("left_share") >= tolerance) & (F.col("right_share") < tolerance / 5), right).when((F.col("right_share") >= tolerance) & (F.col("left_share") < tolerance / 5), left)
    return both.withColumn("missing_from", gone).where("missing_from is not null")


def check_balance(rows: DataFrame, left: str = "train", right: str = "test", cmi_tolerance: float = 0.20, topic_tolerance: float = 0.05, topic: str = "topic") -> list[str]:
    """Ways in which two splits are not comparable; none where one is empty."""
    own = {r.split: r for r in split_profile(rows.where(F.col("split").isin(left, right))).collect()}
    if left not in own or right not in own:
        return []
    out = []
    gaps = topic_gaps(rows, left, right, topic_tolerance, topic).orderBy("topic").collect()
    for side, other in ((right, left), (left, right)):
        names = [str(g.topic) for g in gaps if g.missing_from == side]
        if names:
            out.append(f"{len(names)} topic(s) common in {other} are absent from {side}: {', '.join(names[:6])}{' ...' if len(names) > 6 else ''}")
    a, b = own[left], own[right]
    if a.mean_cmi and abs(a.mean_cmi - b.mean_cmi) / a.mean_cmi > cmi_tolerance:
        out.append(f"mean CMI {a.mean_cmi:.3f} ({left}) against {b.mean_cmi:.3f} ({right}): {right} is {'easier' if b.mean_cmi < a.mean_cmi else 'harder'}")
    if a.en_share and abs(a.en_share - b.en_share) / a.en_share > cmi_tolerance:
        out.append(f"English token share {a.en_share:.1%} ({left}) against {b.en_share:.1%} ({right})")
    if out:
        out.append("a split stratified by topic avoids this where the corpus is ordered by collection batch")
    return out


def split_summary(rows: DataFrame, by: str = "split", text: str = "text", speaker: str = "speaker") -> DataFrame:
    """utterances, speakers, zh and en tokens, share with English and mean CMI of each split."""
    t = rows.select(by, speaker, token_langs(tokens(F.col(text))).alias("langs"))
    t = t.select(by, speaker, count_lang(F.col("langs"), ZH).alias("zh"), count_lang(F.col("langs"), EN).alias("en"), code_mixing_index(F.col("langs")).alias("cmi"))
    return t.groupBy(by).agg(F.count(F.lit(1)).alias("utterances"), F.countDistinct(speaker).alias("speakers"), F.sum("zh").alias("zh_tokens"), F.sum("en").alias("en_tokens"), F.avg((F.col("en") > 0).cast("double")).alias("share_with_english"), F.avg("cmi").alias("mean_cmi"))
