"""Line dedup: levelled sorted runs of line hashes, compacted periodically.

The index of lines seen is a set of *runs*: tables bucketed and sorted by line
hash, each key in exactly one run.  A new batch of documents is reduced to its
line keys, merge-anti-joined with the runs, and the keys that no run holds become
a run of their own at level 0; keys that a run holds already are appended to the
(small) table of repeats.  When a level has ``fanout`` runs they are merged into
one run of the next level.  Runs are bucketed alike, so these joins shuffle the
new batch only, never the index.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import LOWER_TABLE, SPACE_BYTES, bucketed, drop_scratch, materialize, registered, scratch_scope, thrifty

KEYS = ["hi", "lo"]


def line_key(line: bytes, min_chars: int) -> bytes | None:
    """The stripped, lower-cased line, or None where it has fewer code points."""
    key = line.strip(SPACE_BYTES)
    if len(key) < min_chars or (len(key) < 4 * min_chars and len(key.decode("utf-8", "replace")) < min_chars):
        return None
    return key.translate(LOWER_TABLE)


def key_hash(key: bytes) -> tuple[int, int]:
    """128 bits as two signed longs, so that distinct lines do not share a key."""
    h = xxhash.xxh3_128_intdigest(key)
    return tuple(x - (1 << 64) if x >> 63 else x for x in (h >> 64, h & (1 << 64) - 1))


class LineRuns:
    """The levelled index; every run has columns hi, lo, n_docs, last_doc.

    With a ``root`` (a folder in storage that the cluster shares) the index stays there: each batch ends with a
    manifest of the runs that make it up, and :meth:`open` in a later session takes up the newest one.  Without, its
    runs are scratch tables of this session.
    """

    def __init__(self, spark: SparkSession, buckets: int, fanout: int = 3, root: str | None = None):
        if buckets < 1 or fanout < 2:
            raise ValueError("buckets must be at least 1 and fanout at least 2")
        self.spark, self.buckets, self.fanout, self.root = spark, buckets, fanout, root
        self.levels: list[list[DataFrame]] = []
        self.repeats: list[DataFrame] = []
        self.batches = 0

    @classmethod
    def open(cls, spark: SparkSession, root: str) -> LineRuns:
        """The index that was left in ``root``."""
        kept = spark.read.parquet(f"{root}/manifest")
        rows = kept.where(F.col("batch") == kept.agg(F.max("batch")).first()[0]).orderBy("level", "place").collect()  # a few rows for each level
        out = cls(spark, rows[0].buckets, rows[0].fanout, root)
        out.batches = rows[0].batch
        for r in rows:
            if r.level < 0:
                out.repeats.append(spark.read.schema(r.schema).parquet(r.path))
            else:
                while len(out.levels) <= r.level:
                    out.levels.append([])
                out.levels[r.level].append(registered(spark, r.path, r.schema, out.buckets, KEYS))
        return out

    def _write(self, df: DataFrame, level: int) -> DataFrame:
        return bucketed(df.repartition(self.buckets, *KEYS), f"line_run{level}", self.buckets, KEYS, sort=True, root=self.root)

    def _keep(self, df: DataFrame, name: str) -> DataFrame:
        return materialize(df, name, root=self.root)

    def runs(self) -> list[DataFrame]:
        return [r for level in self.levels for r in level]

    def add(self, batch: DataFrame) -> None:
        """``batch``: hi, lo, n_docs, last_doc, one row a key."""
        fresh = batch
        runs = self.runs()
        if runs:
            batch = materialize(batch, "batch")
            fresh = batch
            for run in runs:
                fresh = fresh.join(run.select(*KEYS).hint("merge"), KEYS, "left_anti")
            fresh = self._write(fresh, 0)
            # the index keeps what a batch repeats, too, small as that is
            self.repeats.append(self._keep(batch.join(fresh.select(*KEYS).hint("merge"), KEYS, "left_anti"), "repeats"))
            drop_scratch(self.spark, batch)
        else:
            fresh = self._write(fresh, 0)
        self.levels = self.levels or [[]]
        self.levels[0].append(fresh)
        self._compact()
        self.batches += 1
        if self.root:
            rows = [(level, k, r._scratch, r.schema.simpleString()[7:-1]) for level, own in [(-1, self.repeats), *enumerate(self.levels)] for k, r in enumerate(own)]
            rows = [(self.batches, self.buckets, self.fanout, level, k, path, ", ".join(f.replace(":", " ") for f in shape.split(","))) for level, k, path, shape in rows]
            self.spark.createDataFrame(rows, "batch int, buckets int, fanout int, level int, place int, path string, schema string").coalesce(1).write.mode("append").parquet(f"{self.root}/manifest")

    def _compact(self) -> None:
        for level in range(99):
            if level == len(self.levels) or len(self.levels[level]) < self.fanout:
                break
            merged = self.levels[level][0]
            for run in self.levels[level][1:]:
                merged = merged.unionByName(run)
            if level + 1 == len(self.levels):
                self.levels.append([])
            old, self.levels[level] = self.levels[level], []
            self.levels[level + 1].append(self._write(merged, level + 1))
            if not self.root:  # a kept index leaves merged runs to readers of older manifests
                drop_scratch(self.spark, *old)
        if len(self.repeats) >= self.fanout:
            old, all_ = self.repeats, self.repeats[0]
            for more in self.repeats[1:]:
                all_ = all_.unionByName(more)
            self.repeats = [self._keep(all_.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.max("last_doc").alias("last_doc")), "repeats")]
            if not self.root:
                drop_scratch(self.spark, *old)

    def counts(self, min_docs: int) -> DataFrame:
        """Keys of at least ``min_docs`` documents: hi, lo, n_docs, last_doc."""
        runs = self.runs()
        seen = runs[0]
        for run in runs[1:]:
            seen = seen.unionByName(run)
        if not self.repeats:
            return seen.where(F.col("n_docs") >= min_docs)
        again = self.repeats[0]
        for more in self.repeats[1:]:
            again = again.unionByName(more)
        again = materialize(again.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.max("last_doc").alias("last_doc")), "again")
        both = seen.join(again.select(*KEYS, F.lit(1).alias("again")), KEYS, "left")
        own = both.where(F.col("again").isNotNull() | (F.col("n_docs") >= min_docs)).drop("again")
        return own.unionByName(again).groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.max("last_doc").alias("last_doc")).where(F.col("n_docs") >= min_docs)


def _line_rows(min_chars: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, hi, lo = [], [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                keys = {key_hash(k) for line in (text or "").encode().split(b"\n") if (k := line_key(line, min_chars))}
                for a, b in keys:
                    ids.append(doc), hi.append(a), lo.append(b)
            yield pa.RecordBatch.from_arrays([pa.array(ids, batch.schema.field(0).type), pa.array(hi, pa.int64()), pa.array(lo, pa.int64())], ["doc_id", "hi", "lo"])

    return rows


def _kept_rows(min_chars: int, keep: dict):
    """``keep``: for repeated keys the document that keeps them; each row brings a list of further keys to drop, or null."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: tuple[list, list, list] = ([], [], [])
            own = batch.column(2).to_pylist()
            for doc, text, drops in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), own):
                lines = (text or "").encode().split(b"\n")
                gone = {(x["hi"], x["lo"]) for x in drops or ()}
                kept = []
                for line in lines:
                    key = line_key(line, min_chars)
                    if key is not None and (keep or gone):
                        h = key_hash(key)
                        if h in gone or h in keep and keep[h] != doc:
                            continue
                    kept.append(line)
                out[0].append(b"\n".join(kept).decode())
                out[1].append(len(lines))
                out[2].append(len(lines) - len(kept))
            rest = [batch.column(0), batch.column(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([rest[0], pa.array(out[0], pa.string()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64()), rest[1]], ["doc_id", "kept_text", "n_lines", "n_dropped", "rest"])

    return rows


def dedup_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, batches: int = 3, buckets: int | None = None, broadcast_keys: int = 200_000, index: LineRuns | None = None) -> DataFrame:
    """Drop lines that many documents share, except in the largest doc_id holding them.

    ``docs``: doc_id, text and any other columns, which are passed on.  Adds
    kept_text, n_lines (before dropping) and n_dropped.  A line's key is the line
    without ``[\\x20\\x09-\\x0D]`` at both ends, A-Z lower-cased; keys of under
    ``min_chars`` code points or in under ``min_docs`` documents always stay.

    ``index``: lines seen in earlier calls, whose documents (other ones than these) count, too; the lines of ``docs`` are
    added to it.  Only the rows of ``docs`` are returned.

    Null and empty texts are one empty line.  Rows with the same doc_id are one
    document for the counts, and all of them keep or lose a line alike; rows with
    a null doc_id are together one document that comes before all others.  An
    empty table gives an empty result.  Extra columns stay as they are, but for ones
    named as the three that are added, which are replaced; text itself, of which
    kept_text is what stays, is not returned.

    The repeated keys are sent to all tasks only while there are at most ``broadcast_keys`` of them (some 20 MB of
    Python dict).  Beyond that, the keys in over 1 / ``broadcast_keys`` of all (document, key) pairs are sent, of which there
    cannot be more than that, and the drop lists of the others, none of which is hot, are joined by document.
    """
    spark = docs.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    id_type = docs.schema["doc_id"].dataType.simpleString()
    text = F.col("text").cast("string").alias("text")
    with scratch_scope(spark) as scratch:
        lines = docs.select("doc_id", text).mapInArrow(thrifty(_line_rows(min_chars)), f"doc_id {id_type}, hi long, lo long")
        lines = lines.withColumn("batch", F.pmod(F.xxhash64("doc_id"), F.lit(batches)).cast("int"))
        lines = materialize(lines, "lines", "batch")
        runs = index or LineRuns(spark, buckets)
        for b in range(batches):
            pairs = lines.where(F.col("batch") == b).select("doc_id", *KEYS).distinct()
            runs.add(pairs.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n_docs"), F.max("doc_id").alias("last_doc")))
        hot = materialize(runs.counts(min_docs), "hot")
        scratch.append(hot)
        if index:
            scratch += [*index.runs(), *index.repeats]

        n_hot, light = hot.count(), None
        heavy = hot
        if n_hot > broadcast_keys:
            # a key with more pairs than this is one of at most ``broadcast_keys``
            cut = hot.agg(F.sum("n_docs")).first()[0] / max(1, broadcast_keys)
            heavy, light = hot.where(F.col("n_docs") > cut), hot.where(F.col("n_docs") <= cut)
            drops = lines.join(light, KEYS).where(~F.col("doc_id").eqNullSafe(F.col("last_doc"))).groupBy("doc_id").agg(F.collect_set(F.struct(*KEYS)).alias("drops"))
            drops = materialize(drops.withColumnRenamed("doc_id", "_id"), "drops")
            scratch.append(drops)
        keep = {(r.hi, r.lo): r.last_doc for r in heavy.select(*KEYS, "last_doc").toLocalIterator()}
    sent = spark.sparkContext.broadcast(keep)

    added = ("kept_text", "n_lines", "n_dropped")
    others = [c for c in docs.columns if c not in ("doc_id", "text", *added)]
    rest = F.struct(F.lit(None).cast("int").alias("none"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(others)])
    slim = docs.select("doc_id", text, rest.alias("rest"))
    schema = T.StructType([slim.schema["doc_id"], T.StructField("kept_text", T.StringType()), T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType()), slim.schema["rest"]])
    if light is None:
        slim = slim.select("doc_id", "text", F.lit(None).cast("array<struct<hi:bigint,lo:bigint>>").alias("drops"), "rest")
    else:
        slim = slim.join(drops, F.col("doc_id").eqNullSafe(F.col("_id")), "left").select("doc_id", "text", "drops", "rest")
    out = slim.mapInArrow(thrifty(lambda it: _kept_rows(min_chars, sent.value)(it)), schema)
    kept = [F.col("rest").getField(f"c{i}").alias(c) for i, c in enumerate(others)]
    return out.select("doc_id", *kept, *added)
