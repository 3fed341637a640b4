"""Benchmark decontamination by SimHash over item-sized windows.

For each length that a benchmark item has, a text is seen through all windows of that many
words.  A window's SimHash is a difference of running sums over weighted shingle bits.
Items are in buckets by their rarest shingles, one of which any similar window has.  In a bucket,
fingerprints are looked up in a multi-index: cut into blocks, every window within the
radius of an item agrees with it in some block to within radius // blocks bits, and
the index lists the items under every such block value, so none within the radius is missed.
Candidates are verified by the exact weighted-shingle similarity (weighted Jaccard).

A window's similarity to items of its length is at most the share of its weight that lies on
shingles of theirs; windows below the threshold by this bound are passed over before fingerprinting,
which loses nothing.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import hash_words, mix, row_slices, text_buffer, thrifty

BLOCKS, BLOCK_BITS = 8, 8
_PLAIN = np.arange(256, dtype=np.uint8)
_PLAIN[[c for c in range(128) if not chr(c).isalnum()]] = 0x20


def shingles(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the k-word shingles; fewer words: of the whole sequence."""
    if len(words) == 0:
        return words
    k = min(k, len(words))
    out = np.zeros(len(words) - k + 1, np.uint64)
    for i in range(k):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + words[i : i + len(out)])
    return out


def text_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased words without ASCII punctuation, and the first of each text."""
    part = _PLAIN[data[offsets[0] : offsets[-1]]]
    hashes, _, _, firsts = hash_words(part, offsets - offsets[0], lower=True)
    return hashes, firsts


def signs(hashes: np.ndarray) -> np.ndarray:
    return 2.0 * np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little") - 1.0


def pack(sums: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(np.packbits(sums > 0, axis=1, bitorder="little")).view(np.uint64).ravel()


def held_in(known: np.ndarray, s: np.ndarray) -> np.ndarray:
    """Which of ``s`` are among the sorted ``known``."""
    if len(known) == 0:
        return np.zeros(len(s), bool)
    return known[np.minimum(np.searchsorted(known, s), len(known) - 1)] == s


class Blocks:
    """A multi-index: fingerprints by the values of their blocks, each listed under every value within radius // blocks bits."""

    near: dict[int, np.ndarray] = {}

    def __init__(self, prints: np.ndarray, radius: int):
        self.prints, self.radius = prints, radius
        flips = radius // BLOCKS
        near = self.near.setdefault(flips, np.array([m for m in range(1 << BLOCK_BITS) if m.bit_count() <= flips]))
        self.table: list[tuple[np.ndarray, np.ndarray]] = []
        for b in range(BLOCKS):
            block = (prints >> np.uint64(b * BLOCK_BITS)).astype(np.int64) & (1 << BLOCK_BITS) - 1
            values = (block[:, None] ^ near[None, :]).ravel()
            order = np.argsort(values, kind="stable")
            self.table.append((np.searchsorted(values[order], np.arange((1 << BLOCK_BITS) + 1)), np.repeat(np.arange(len(block)), len(near))[order]))

    def within(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in ``prints``, place in the index) of all pairs within the radius."""
        pairs = []
        for b, (starts, owner) in enumerate(self.table):
            block = (prints >> np.uint64(b * BLOCK_BITS)).astype(np.int64) & (1 << BLOCK_BITS) - 1
            row, at = spread(starts[block], starts[block + 1])
            pairs.append(row * len(self.prints) + owner[at])
        both = np.unique(np.concatenate(pairs))
        row, own = both // len(self.prints), both % len(self.prints)
        near = np.bitwise_count(prints[row] ^ self.prints[own]) <= self.radius
        return row[near], own[near]


def spread(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(range, place) of every place of the ranges from ``starts`` up to ``ends``."""
    n = np.maximum(ends - starts, 0)
    row = np.repeat(np.arange(len(n)), n)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(starts, n)


class _Group:
    """The items of one length, in buckets by their prefixes.

    An item's prefix is its heaviest shingles, of over 1 - ``least`` of its weight together: a window without any of
    them cannot be as similar as ``least``.  So a window is compared only with items in the buckets of shingles that it
    has; a bucket of over ``page`` fingerprints is a multi-index, one of fewer is a single page of it that is read at once.
    """

    def __init__(self, index: ItemIndex, items: np.ndarray, page: int = 64):
        self.items, self.prints, self.radius = items, index.prints[items], index.radius
        own = [index.of(i) for i in items.tolist()]
        self.known = np.unique(np.concatenate([v for v, _ in own]))
        values, owners = [], []
        for place, (v, n) in enumerate(own):
            weight = index.weigh(v) * n
            order = np.lexsort((v, -weight))
            upto = np.cumsum(weight[order])
            head = order[: int(np.searchsorted(upto, (1 - index.least + 1e-9) * upto[-1], side="right")) + 1]
            values.append(v[head]), owners.append(np.full(len(head), place))
        value, owner = np.concatenate(values), np.concatenate(owners)
        order = np.argsort(value, kind="stable")
        self.owner = owner[order]
        self.prefixes, first = np.unique(value[order], return_index=True)
        self.edges = np.append(first, len(value))
        self.large = {k: Blocks(self.prints[self.owner[self.edges[k] : self.edges[k + 1]]], self.radius) for k in np.flatnonzero(np.diff(self.edges) > page).tolist()}
        self.compared = 0

    def within(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, item) for all pairs within the radius, whatever their shingles."""
        window, own = Blocks(self.prints, self.radius).within(prints)
        return window, self.items[own]

    def candidates(self, s: np.ndarray, starts: np.ndarray, n: int, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in ``starts``, item) of all pairs within the radius that share a prefix shingle; windows are ``n`` shingles from each start."""
        lo, hi = int(starts[0]), int(starts[-1]) + n
        at = np.minimum(np.searchsorted(self.prefixes, s[lo:hi]), len(self.prefixes) - 1)
        hit = np.flatnonzero(self.prefixes[at] == s[lo:hi])
        # the buckets that each window's shingles name, each once
        row, place = spread(np.searchsorted(hit, starts - lo), np.searchsorted(hit, starts - lo + n))
        both = np.unique(row * len(self.prefixes) + at[hit[place]])
        row, bucket = both // len(self.prefixes), both % len(self.prefixes)
        big = np.isin(bucket, np.array(list(self.large), np.int64))
        pair, member = spread(self.edges[bucket[~big]], self.edges[bucket[~big] + 1])
        pairs = [row[~big][pair] * len(self.prints) + self.owner[member]]
        for k in np.unique(bucket[big]).tolist():
            windows = row[bucket == k]
            near, own = self.large[k].within(prints[windows])
            pairs.append(windows[near] * len(self.prints) + self.owner[self.edges[k] + own])
        both = np.unique(np.concatenate(pairs))
        self.compared += len(both)
        row, own = both // len(self.prints), both % len(self.prints)
        near = np.bitwise_count(prints[row] ^ self.prints[own]) <= self.radius
        return row[near], self.items[own[near]]


class ItemIndex:
    """Items by shingle weights, prefixes and the blocks of their fingerprints, in arrays."""

    def __init__(self, items: list[tuple[int, str]], k: int, radius: int, totals: tuple[int, np.ndarray, np.ndarray] | None = None, least: float = 0.8):
        """``totals``: the number of all items with words, and the shingles (sorted) that several of them have with
        their numbers of items, where ``items`` are only a part of all."""
        self.k, self.radius, self.least = k, radius, least
        data, offsets = text_buffer(pa.array([t for _, t in items], pa.large_string()))
        words, firsts = text_words(data, offsets)
        own = [words[a:b] for a, b in itertools.pairwise(firsts.tolist())]
        held = [i for i, w in enumerate(own) if len(w)]
        self.ids = [items[i][0] for i in held]
        self.lengths = np.array([len(own[i]) for i in held], np.int64)
        bags = [np.unique(shingles(own[i], k), return_counts=True) for i in held]
        self.values = np.concatenate([v for v, _ in bags]) if bags else np.zeros(0, np.uint64)
        self.uses = np.concatenate([n for _, n in bags]) if bags else np.zeros(0, np.int64)
        self.edges = np.concatenate([[0], np.cumsum([len(v) for v, _ in bags])]).astype(np.int64)
        self.known, df = np.unique(self.values, return_counts=True)
        n, self.weighed, df = totals or (len(bags), self.known, df)
        self.weights = np.log1p(n / df)
        self.other = float(np.log1p(n))  # of shingles that no item has, or one
        weights = self.weigh(self.values) * self.uses
        self.sums = np.add.reduceat(weights, self.edges[:-1]) if len(bags) else np.zeros(0)
        self.prints = np.array([pack((signs(v) * weights[a : a + len(v), None]).sum(0, keepdims=True))[0] for (v, _), a in zip(bags, self.edges.tolist())], np.uint64)
        self.groups = {n: _Group(self, np.flatnonzero(self.lengths == n)) for n in np.unique(self.lengths).tolist()}

    def of(self, item: int) -> tuple[np.ndarray, np.ndarray]:
        """The distinct shingles of an item, sorted, and how often it has them."""
        own = slice(self.edges[item], self.edges[item + 1])
        return self.values[own], self.uses[own]

    def weigh(self, s: np.ndarray) -> np.ndarray:
        if len(self.weighed) == 0:
            return np.full(len(s), self.other)
        at = np.minimum(np.searchsorted(self.weighed, s), len(self.weighed) - 1)
        return np.where(self.weighed[at] == s, self.weights[at], self.other)

    def contains(self, s: np.ndarray) -> np.ndarray:
        return held_in(self.known, s)

    def similarity(self, s: np.ndarray, item: int) -> float:
        """Weighted Jaccard of a window's shingles and an item's, repeats counted."""
        values, n = np.unique(s, return_counts=True)
        w = self.weigh(values)
        own, uses = self.of(item)
        at = np.minimum(np.searchsorted(own, values), len(own) - 1)
        inner = float((w * np.minimum(n, np.where(own[at] == values, uses[at], 0))).sum())
        whole = float((w * n).sum()) + float(self.sums[item]) - inner
        return inner / whole if whole else 0.0

    def match(self, words: np.ndarray, least: float, block: int = 20_000) -> dict[int, tuple[float, int]]:
        """For each item found in a text's words: the best similarity and the first word of its first best window."""
        if least < self.least:
            raise ValueError(f"the prefixes are for similarities from {self.least} up")
        best: dict[int, tuple[float, int]] = {}
        if len(words) == 0 or len(self.ids) == 0:
            return best
        most = int(self.lengths.max())
        for lo in range(0, len(words), block):
            part = words[lo : lo + block + most - 1]
            by_k: dict[int, tuple | None] = {}
            for length, group in self.groups.items():
                size = min(length, len(part))
                if lo and size < length:
                    continue
                k = min(self.k, size)
                if k not in by_k:
                    s = shingles(part, k)
                    by_k[k] = None
                    if self.contains(s).any():
                        w = self.weigh(s)
                        by_k[k] = (s, w, np.concatenate([[0.0], np.cumsum(w)]), np.concatenate([np.zeros((1, 64)), np.cumsum(signs(s) * w[:, None], axis=0)]))
                if by_k[k] is None:
                    continue
                s, w, whole, sums = by_k[k]
                hit = held_in(group.known, s)
                if not hit.any():
                    continue
                n = size - k + 1
                held = np.concatenate([[0.0], np.cumsum(np.where(hit, w, 0.0))])
                starts = np.flatnonzero(held[n:] - held[:-n] >= (least - 1e-9) * (whole[n:] - whole[:-n]))
                starts = starts[starts < block]
                for a in range(0, len(starts), 1024):
                    some = starts[a : a + 1024]
                    window, item = group.candidates(s, some, n, pack(sums[some + n] - sums[some]))
                    for at, i in zip(some[window].tolist(), item.tolist()):
                        sim = self.similarity(s[at : at + n], i)
                        if sim >= least and sim > best.get(i, (0.0, 0))[0]:
                            best[i] = (sim, lo + at)
        return best


def _match_rows(index, least: float):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: ItemIndex = index()
        for batch in batches:
            data, offsets = text_buffer(batch.column(1))
            docs = batch.column(0).to_pylist()
            out: list[tuple] = []
            for a, b in row_slices(offsets):
                words, firsts = text_words(data, offsets[a : b + 1])
                s = shingles(words, own.k)
                hit = np.concatenate([[0], np.cumsum(own.contains(s))])
                for i, (f, t) in enumerate(itertools.pairwise(firsts.tolist())):
                    short = t - f < own.k or int(own.lengths.min(initial=own.k)) < own.k
                    if t > f and (short or hit[min(t - own.k + 1, len(s))] > hit[f]):
                        out += [(docs[a + i], own.ids[j], sim, at) for j, (sim, at) in sorted(own.match(words[f:t], least).items())]
            names = ["doc_id", "item_id", "similarity", "first_word"]
            types = [batch.schema.field(0).type, pa.int64(), pa.float64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], t) for c, t in enumerate(types)], names)

    return rows


def _shingle_rows(k: int):
    """The distinct shingles of each item that has words, and a null for the item itself."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffer(batch.column(0))
            words, firsts = text_words(data, offsets)
            for a, b in itertools.pairwise(firsts.tolist()):
                if b > a:
                    own = pa.array(np.unique(shingles(words[a:b], k)).view(np.int64))
                    yield pa.RecordBatch.from_arrays([pa.concat_arrays([own, pa.nulls(1, pa.int64())])], ["shingle"])

    return rows


def item_totals(items: DataFrame, k: int) -> tuple[int, np.ndarray, np.ndarray]:
    """The number of items with words, and the shingles that several of them have, sorted, with their numbers of items."""
    found = items.select("text").mapInArrow(thrifty(_shingle_rows(k)), "shingle long").groupBy("shingle").agg(F.count(F.lit(1)).alias("n"))
    rows = found.where("n > 1 or shingle is null").toArrow()
    shingle, n = rows["shingle"].combine_chunks(), rows["n"].to_numpy()
    every = shingle.is_null().to_numpy(zero_copy_only=False)
    values = shingle.fill_null(0).to_numpy()[~every].view(np.uint64)
    order = np.argsort(values)
    return int(n[every].sum()), values[order], n[~every][order]


def contaminated(docs: DataFrame, benchmark: DataFrame, k: int = 5, radius: int = 23, least: float = 0.8, max_words: int = 2_000_000) -> DataFrame:
    """doc_id, item_id, similarity and first_word of every benchmark item found in a document.

    ``docs``: doc_id, text; ``benchmark``: item_id (a long), text; other columns are ignored.  A row for each
    pair whose best window has a similarity of at least ``least``; first_word counts from 0.

    Null and empty texts, on either side, match nothing.  Texts shorter than an item are one window.
    Repeated rows of ``docs`` are each reported; repeated items are each found.  Empty tables give an
    empty result.  The index goes to all tasks only in parts of up to ``max_words`` words (and at least
    one item); a larger benchmark takes a pass over the documents for each part.  Shingle weights are of all items
    in any case: the weights of shingles that several items have (16 bytes each) go along with every part.
    """
    spark = docs.sparkSession
    slim = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    schema = T.StructType([slim.schema["doc_id"], T.StructField("item_id", T.LongType()), T.StructField("similarity", T.DoubleType()), T.StructField("first_word", T.LongType())])
    items = benchmark.where("text is not null and item_id is not null").select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    size = items.agg(F.sum(F.length("text")).alias("n")).first().n or 0
    parts = max(1, -(-size // (6 * max_words)))
    totals = item_totals(items, k) if parts > 1 else None
    out = None
    for p in range(parts):
        own = items.where(F.pmod(F.xxhash64("item_id"), F.lit(parts)) == p).collect() if parts > 1 else items.collect()
        sent = spark.sparkContext.broadcast(ItemIndex(sorted((r.item_id, r.text) for r in own), k, radius, totals, least))
        found = slim.mapInArrow(thrifty(lambda it, sent=sent: _match_rows(lambda: sent.value, least)(it)), schema)
        out = found if out is None else out.unionByName(found)
    return out
