"""Stupid-backoff scores (Brants et al., 2007), computed relationally.

Documents are laid out in blocks of some megabytes.  A block's distinct n-grams and their counts
go to the partition that their hash names; there the counts of all blocks add up to the
corpus count table, which is joined to what the blocks sent, and the totals go
back to the blocks, where they are joined to the exploded n-grams and the scores of the
n-grams are summed per document.

The relation that is exchanged is (hash partition, order, block, n-grams, counts): a row holds the n-grams that one block
has in one partition, sorted and packed into bytes; the way back holds the totals only, in the order in which they were sent.
So the shuffles stay a few times smaller than rows of one n-gram would make them, and no
n-gram is pruned.  There are never more rows than distinct n-grams of blocks: as the corpus grows and with it the number of
partitions, rows get shorter, down to one n-gram (and are then laid out plainly), and their number grows in proportion to the input.
"""

from __future__ import annotations

import itertools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import bucketed, distinct, hash_words, mix, row_slices, text_buffer, thrifty


#: Shorter arrays are not worth deflating.
FEW = 16


def pack_sorted(values: np.ndarray) -> bytes:
    """Distinct 64-bit hashes in rising runs: differences (modulo 2**64), laid out by byte significance, deflated; a few as they are."""
    if len(values) < FEW:
        return b"r" + values.astype(np.uint64).tobytes()
    steps = np.diff(values, prepend=np.uint64(0))
    return b"z" + zlib.compress(np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8).T).tobytes(), 1)


def unpack_sorted(data: bytes) -> np.ndarray:
    if data[:1] == b"r":
        return np.frombuffer(data, np.uint64, offset=1)
    planes = np.frombuffer(zlib.decompress(data[1:]), np.uint8)
    return np.cumsum(np.ascontiguousarray(planes.reshape(8, -1).T).view(np.uint64).ravel(), dtype=np.uint64)


def pack_counts(counts: np.ndarray) -> bytes:
    if len(counts) < FEW and counts.max(initial=0) < 256:
        return b"b" + counts.astype(np.uint8).tobytes()
    return b"z" + zlib.compress(np.ascontiguousarray(counts.astype(np.uint64).view(np.uint8).reshape(-1, 8).T).tobytes(), 1)


def unpack_counts(data: bytes) -> np.ndarray:
    if data[:1] == b"b":
        return np.frombuffer(data, np.uint8, offset=1).astype(np.int64)
    planes = np.frombuffer(zlib.decompress(data[1:]), np.uint8)
    return np.ascontiguousarray(planes.reshape(8, -1).T).view(np.uint64).ravel().astype(np.int64)


def pack_places(places: np.ndarray) -> bytes:
    """Places in a vocabulary by frequency: the higher bytes are mostly zero."""
    return zlib.compress(np.ascontiguousarray(places.astype(np.uint32).view(np.uint8).reshape(-1, 4).T).tobytes(), 1)


def unpack_places(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zlib.decompress(data), np.uint8).reshape(4, -1).T).view(np.uint32).ravel()


def n_gram_hashes(words: np.ndarray, rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-grams and the place of each one's last word; none goes over the end of a text."""
    if len(words) < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    out = np.full(len(words) - n + 1, n, np.uint64)
    for i in range(n):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + words[i : i + len(out)])
    whole = rows[: len(out)] == rows[n - 1 :]
    return out[whole], np.flatnonzero(whole) + n - 1


def partition_of(grams: np.ndarray, parts: int) -> np.ndarray:
    """The hash partition of each n-gram; partitions are ranges of the hash, so sorted n-grams have sorted partitions."""
    return ((grams >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def _block_rows(size: int):
    """Blocks: the hashes of their distinct words, the commonest first, the words as places among those, and the number of words of each text."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        next_id = TaskContext.get().partitionId() << 32
        ids, hashes, counts, held = [], [], [], 0

        def emit():
            nonlocal next_id, held
            words = np.concatenate(hashes)
            vocabulary, places, uses = np.unique(words, return_inverse=True, return_counts=True)
            # by classes of frequency, and by hash in each, so that places and differences both stay small
            order = np.argsort(-np.frexp(uses.astype(np.float64))[1], kind="stable")
            rank = np.empty(len(order), np.uint32)
            rank[order] = np.arange(len(order), dtype=np.uint32)
            docs = pa.array(ids, id_type)
            row = [pa.array([next_id]), pa.array([pack_sorted(vocabulary[order])], pa.binary()), pa.array([pack_places(rank[places])], pa.binary()), pa.array([zlib.compress(np.concatenate(counts).astype(np.int64).tobytes(), 1)]), pa.ListArray.from_arrays(pa.array([0, len(docs)], pa.int32()), docs), pa.array([len(words)])]
            next_id += 1
            ids.clear(), hashes.clear(), counts.clear()
            held = 0
            return pa.RecordBatch.from_arrays(row, ["block", "vocabulary", "places", "n_words", "doc_ids", "n"])

        id_type = pa.int64()
        for batch in batches:
            id_type = batch.schema.field(0).type
            data, offsets = text_buffer(batch.column(1))
            docs = batch.column(0).to_pylist()
            for a, b in row_slices(offsets):
                words, _, _, firsts = hash_words(data, offsets[a : b + 1], lower=True)
                ids += docs[a:b]
                hashes.append(words), counts.append(np.diff(firsts))
                held += int(offsets[b] - offsets[a])
                if held >= size:
                    yield emit()
        if ids:
            yield emit()

    return rows


def _words_of_block(vocabulary: bytes, places: bytes, n_words: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    counts = np.frombuffer(zlib.decompress(n_words), np.int64)
    words = unpack_sorted(vocabulary)[unpack_places(places)]
    return words, np.repeat(np.arange(len(counts)), counts), counts


def _sent_rows(order: int, parts: int):
    """A block's distinct n-grams, one row for each hash partition that they fall into: as many as it has n-grams, at most."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, vocabulary, places, n_words in zip(*(batch.column(i).to_pylist() for i in range(4))):
                words, owner, _ = _words_of_block(vocabulary, places, n_words)
                for n in range(1, order + 1):
                    grams, counts = np.unique(n_gram_hashes(words, owner, n)[0], return_counts=True)
                    part = partition_of(grams, parts)
                    cuts = np.flatnonzero(np.diff(part, prepend=-1)).tolist() + [len(grams)]
                    for a in range(0, len(cuts) - 1, 64):
                        own = list(itertools.pairwise(cuts[a : a + 65]))
                        yield pa.RecordBatch.from_arrays([pa.array([block] * len(own), pa.int64()), pa.array([n] * len(own), pa.int32()), pa.array(part[[x for x, _ in own]].astype(np.int32)), pa.array([pack_sorted(grams[x:y]) for x, y in own], pa.binary()), pa.array([pack_counts(counts[x:y]) for x, y in own], pa.binary())], ["block", "n", "part", "grams", "counts"])

    return rows


def _total_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows arrive sorted by (part, n): the counts of one hash partition and order add up to the count table, and each block gets its totals."""
    key, held = None, []

    def totals():
        grams = np.concatenate([h[1] for h in held])
        known, back = np.unique(grams, return_inverse=True)
        total = np.bincount(back, np.concatenate([h[2] for h in held]), len(known)).astype(np.int64)
        at = 0
        for block, own, _ in held:
            yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([key[1]], pa.int32()), pa.array([key[0]], pa.int32()), pa.array([pack_counts(total[back[at : at + len(own)]])], pa.binary())], ["block", "n", "part", "totals"])
            at += len(own)

    for batch in batches:
        for block, n, part, grams, counts in zip(*(c.to_pylist() for c in batch.columns)):
            if (part, n) != key:
                if held:
                    yield from totals()
                key, held = (part, n), []
            held.append((block, unpack_sorted(grams), unpack_counts(counts)))
    if held:
        yield from totals()


def backoff_scores(words: np.ndarray, counts: np.ndarray, totals: dict[int, np.ndarray], order: int, alpha: float, n_corpus: int, slice_words: int = 200_000) -> np.ndarray:
    """Log score of each text of a block, from the counts in all documents but itself.

    ``counts``: words of each text; ``totals``: by order, corpus counts of the block's distinct n-grams in
    order of their hashes.  Texts are worked through in slices of about ``slice_words`` words.
    """
    owner = np.repeat(np.arange(len(counts)), counts)
    known = {n: distinct(n_gram_hashes(words, owner, n)[0]) for n in range(1, order + 1)}
    out = np.zeros(len(counts))
    firsts = np.concatenate([[0], np.cumsum(counts)])
    for a, b in row_slices(firsts, slice_words):
        part, own = words[firsts[a] : firsts[b]], owner[firsts[a] : firsts[b]] - a
        if len(part) == 0:
            continue
        others = np.maximum(n_corpus - counts[a:b], 1)[own]
        score, context = np.log(alpha / others), others
        for n in range(1, order + 1):
            grams, ends = n_gram_hashes(part, own, n)
            if len(grams) == 0:
                break
            few, at = np.unique(grams, return_inverse=True)
            _, back, own_count = np.unique(own[ends] * len(few) + at, return_inverse=True, return_counts=True)
            # looked up in order: far fewer cache misses than place by place
            seen = totals[n][np.searchsorted(known[n], few)][at] - own_count[back]
            under = context[ends] if n == 1 else context[ends - 1]
            score[ends] = np.where(seen > 0, np.log(np.maximum(seen, 1)) - np.log(np.maximum(under, 1)), score[ends] + (np.log(alpha) if n > 1 else 0.0))
            context = np.ones(len(part), np.int64)
            context[ends] = seen
        out[a:b] = np.bincount(own, score, b - a)
    return out


def _score_rows(order: int, alpha: float, n_corpus: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            id_type = batch.schema.field(3).type.value_type
            for vocabulary, places, n_words, docs, back in zip(*(batch.column(i).to_pylist() for i in range(5))):
                words, _, counts = _words_of_block(vocabulary, places, n_words)
                totals: dict[int, list] = {n: [] for n in range(1, order + 1)}
                for x in sorted(back or (), key=lambda x: x["part"]):
                    totals[x["n"]].append(unpack_counts(x["totals"]))
                whole = {n: np.concatenate(t) if t else np.zeros(0, np.int64) for n, t in totals.items()}
                sums = backoff_scores(words, counts, whole, order, alpha, n_corpus)
                yield pa.RecordBatch.from_arrays([pa.array(docs, id_type), pa.array(counts), pa.array(sums), pa.array(sums / np.maximum(counts, 1))], ["doc_id", "n_words", "log_score", "mean_log_score"])

    return rows


def score_documents(docs: DataFrame, order: int = 3, alpha: float = 0.4, block_bytes: int = 16 << 20, rows_a_part: int = 500_000) -> DataFrame:
    """doc_id, n_words, log_score and mean_log_score (a word's mean), one row for each row of ``docs``.

    ``docs``: doc_id, text; other columns are ignored.  Words are runs without ``[\\x20\\x09-\\x0D]``, A-Z lower-cased.  The
    counts are of all other documents (rows): a document does not vouch for itself.  The score of a word is
    count(n-gram) / count(its first n - 1 words) for the longest n-gram seen elsewhere, times ``alpha`` for each order
    backed off; a word seen nowhere else scores alpha / (words of the others).  Where a text's
    beginning has less context, the orders that it has are used without penalty.

    Null and empty texts have no words and score 0.  Repeated rows count as other documents.  An empty
    table gives an empty result.
    """
    if order < 1:
        raise ValueError("order must be at least 1")
    slim = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    id_type = slim.schema["doc_id"].dataType.simpleString()
    spark = docs.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    laid_out = slim.mapInArrow(thrifty(_block_rows(block_bytes)), f"block long, vocabulary binary, places binary, n_words binary, doc_ids array<{id_type}>, n long")
    # bucketed by block: the totals come to the blocks, which are never shuffled
    blocks = bucketed(laid_out, "lm_blocks", buckets, ["block"])
    n_corpus = blocks.agg(F.sum("n").alias("n")).first().n or 0
    parts = max(1, -(-n_corpus // rows_a_part))
    sent = blocks.select("block", "vocabulary", "places", "n_words").mapInArrow(thrifty(_sent_rows(order, parts)), "block long, n int, part int, grams binary, counts binary")
    tasks = min(parts, max(buckets, parts // 8))
    totals = sent.repartition(tasks, "part").sortWithinPartitions("part", "n", "block").mapInArrow(thrifty(_total_rows), "block long, n int, part int, totals binary")
    back = totals.groupBy("block").agg(F.collect_list(F.struct("n", "part", "totals")).alias("back"))
    joined = blocks.join(back.hint("merge"), "block", "left").select("vocabulary", "places", "n_words", "doc_ids", "back")
    return joined.mapInArrow(thrifty(_score_rows(order, alpha, n_corpus)), f"doc_id {id_type}, n_words long, log_score double, mean_log_score double")
