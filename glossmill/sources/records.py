"""Record files: JSON lines, manifests, and the ways to write them.

Rows carry ``_pos``, their place in the file, on which ids and ties depend.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterable
from pathlib import Path

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.pairs import check_unique_ids, missing_ids


#: Partitions whose starts go to all tasks (12 bytes each); those of more are joined by a shuffle.
MOST_BROADCAST = 1_000_000


def with_pos(df: DataFrame) -> DataFrame:
    """``_pos``: the number of a row in reading order, counted partition by partition (no global sort).

    The numbers at which partitions start are a table of two longs a partition, which is joined; nothing of it is in the plan.
    """
    names = df.columns
    keyed = df.withColumns({"_part": F.spark_partition_id(), "_row": F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)})
    sizes = pa.Table.from_pylist(sorted(({"_part": r._part, "n": r.n} for r in keyed.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).toLocalIterator()), key=lambda r: r["_part"]), pa.schema([("_part", pa.int32()), ("n", pa.int64())]))
    before = pc.subtract(pc.cumulative_sum(sizes["n"]), sizes["n"])
    starts = df.sparkSession.createDataFrame(sizes.select(["_part"]).append_column("_start", before))
    placed = keyed.join(F.broadcast(starts) if len(sizes) <= MOST_BROADCAST else starts, "_part")
    return placed.select((F.col("_start") + F.col("_row")).alias("_pos"), *names)


def read_jsonl(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """JSON lines with ``_pos``; a byte-order mark and blank lines are passed over.

    A line that is not a JSON object is an error that names the file and the line.
    """
    lines = with_pos(spark.read.text(str(path)).withColumnRenamed("value", "line"))
    lines = lines.withColumn("line", F.regexp_replace("line", "^﻿", "")).where(F.trim("line") != "")
    shape = schema
    if shape is None:
        keys = spark.read.option("allowSingleQuotes", "false").json(str(path))
        shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keys.schema.fields if f.name != "_corrupt_record")
        if not shape:
            shape = "id string"
    probe = F.from_json("line", f"{shape}, _corrupt_record string", {"allowSingleQuotes": "false", "columnNameOfCorruptRecord": "_corrupt_record"})
    parsed = lines.withColumn("r", probe)
    bad = parsed.where("r is null or r._corrupt_record is not null").agg(F.min("_pos").alias("at")).first().at
    if bad is not None:
        raise ValueError(f"{path}:{bad + 1}: invalid JSON")
    return parsed.select("_pos", "r.*").drop("_corrupt_record")


def write_jsonl(df: DataFrame, path: str, pos: str = "_pos") -> None:
    """One file of JSON lines in the order of ``pos``, streamed through the driver; folders are made."""
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    ordered = df.orderBy(pos) if pos in df.columns else df
    shown = [F.col(f"`{c}`") for c in df.columns if c != pos]
    with open(path, "w", encoding="utf-8") as f:
        for row in ordered.select(F.to_json(F.struct(*shown), {"ignoreNullFields": "false"}).alias("j")).toLocalIterator():
            f.write(row.j + "\n")


def write_json(value: object, path: str) -> None:
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        json.dump(value, f, ensure_ascii=False, indent=2, default=str)


def load_manifest(spark: SparkSession, path: str, id_key: str = "id", audio_key: str = "audio", text_key: str = "text") -> DataFrame:
    """_pos, id, audio and text of a manifest in JSON lines, JSON (an array, or an object's "data"), TSV or CSV.

    Values are strings; a missing id is made from the place, a missing text is empty, a missing audio column and a
    repeated id are errors.
    """
    suffix = os.path.splitext(str(path))[1].lower()
    if suffix in (".jsonl", ".ndjson"):
        raw = read_jsonl(spark, path)
    elif suffix == ".json":
        raw = spark.read.option("multiLine", True).json(str(path))
        if "data" in raw.columns and audio_key not in raw.columns:
            raw = raw.select(F.explode("data").alias("r")).select("r.*")
        raw = with_pos(raw)
    elif suffix in (".tsv", ".csv"):
        raw = with_pos(spark.read.options(header=True, sep="\t" if suffix == ".tsv" else ",", escape='"', multiLine=True).csv(str(path)))
    else:
        raise ValueError(f"{path}: unsupported manifest {suffix!r}; use .jsonl, .ndjson, .json, .tsv or .csv")
    columns = [c.lstrip("﻿") for c in raw.columns]
    raw = raw.toDF(*columns)
    if audio_key not in columns:
        raise KeyError(f"{path}: no column {audio_key!r}; there are {', '.join(c for c in columns if c != '_pos')}")
    take = lambda k: F.col(f"`{k}`").cast("string") if k in columns else F.lit(None).cast("string")
    out = missing_ids(raw.select("_pos", take(id_key).alias("id"), take(audio_key).alias("audio"), F.coalesce(take(text_key), F.lit("")).alias("text")))
    check_unique_ids(out, str(path))
    return out


def load_hub_dataset(spark: SparkSession, dataset: str, split: str = "test", config: str | None = None, audio_column: str = "audio", text_column: str = "text", id_column: str | None = None, cache_audio_dir: str | None = None) -> DataFrame:
    """A hub dataset as a manifest, through the optional ``datasets`` package; audio held in memory is cached as 16 kHz wav files, and files that are there are used again."""
    try:
        from datasets import Audio, load_dataset
    except ImportError as e:
        raise ImportError("reading a hub dataset needs the datasets package") from e
    data = load_dataset(dataset, config, split=split).cast_column(audio_column, Audio(sampling_rate=16_000))
    rows = []
    for i, row in enumerate(data):
        utt = str(row[id_column]) if id_column else f"utt_{i:06d}"
        rows.append((i, utt, _audio_path(row[audio_column], utt, cache_audio_dir), str(row[text_column])))
    out = spark.createDataFrame(rows, "_pos long, id string, audio string, text string")
    check_unique_ids(out, dataset)
    return out


def _audio_path(audio: dict, utt: str, folder: str | None) -> str:
    if audio.get("path") and os.path.exists(audio["path"]):
        return audio["path"]
    if not folder:
        raise ValueError("audio is in memory only; name a cache folder")
    import soundfile

    target = Path(folder) / f"{''.join(c if c.isalnum() or c in '-_' else '_' for c in utt)}.wav"
    if not target.exists():
        target.parent.mkdir(parents=True, exist_ok=True)
        soundfile.write(target, audio["array"], audio["sampling_rate"])
    return str(target)


def batched(items: Iterable, size: int):
    """Lists of up to ``size`` items."""
    held: list = []
    for item in items:
        held.append(item)
        if len(held) == size:
            yield held
            held = []
    if held:
        yield held
