"""SimHash near-dedup with BK-trees.

Texts become 64-bit SimHash fingerprints of their word shingles.  Distinct fingerprints
are put into shards, so that any two within the radius meet in at least one shard;
each shard is a BK-tree, whose children are keyed by their integer Hamming distance to
the parent, and a search follows only the edges within the radius.  A shard yields
the links of a minimum spanning forest at most, never all pairs.  Linked
fingerprints form components.

Trees of all fingerprints would grow with the corpus, so they are not broadcast from the
driver: a shard's members go to the shard's task by a shuffle.  Shards with many
members are dealt out: the members are hashed into chunks, and every pair of chunks is
a tree of its own.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import LOWER_TABLE, materialize, thrifty
from .components import components

BITS = 64


def shingle_hashes(text: bytes, words: int, seed: int = 42) -> np.ndarray:
    """XXH64 of each space-joined shingle of the A-Z lower-cased text, repeats included.

    Fewer words than a shingle has: the whole sequence; none: no hash.
    """
    parts = text.translate(LOWER_TABLE).split()
    if not parts:
        return np.zeros(0, np.uint64)
    joined = b" ".join(parts)
    h = xxhash.xxh64_intdigest
    if len(parts) <= words:
        return np.array([h(joined, seed)], np.uint64)
    ends = np.cumsum([len(p) + 1 for p in parts]) - 1
    starts = [0, *(ends[: len(parts) - words] + 1).tolist()]
    return np.array([h(joined[a:b], seed) for a, b in zip(starts, ends[words - 1 :].tolist())], np.uint64)


def fold(hashes: np.ndarray) -> int:
    """The fingerprint: a bit is 1 where it is set in over half the hashes."""
    n = len(hashes)
    if n == 0:
        return 0
    ones = np.zeros(BITS, np.int64)
    for i in range(0, n, 1 << 15):
        ones += np.unpackbits(hashes[i : i + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def fingerprint(text: str | None, words: int = 3) -> int:
    return fold(shingle_hashes((text or "").encode(), words))


def _fingerprint_rows(words: int, sketch: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.zeros(batch.num_rows, np.uint64)
            least: list[list[int]] = []
            sizes = np.zeros(batch.num_rows, np.int64)
            for i, text in enumerate(batch.column(1).to_pylist()):
                hashes = shingle_hashes((text or "").encode(), words)
                if sketch:
                    hashes = own = np.unique(hashes)
                    sizes[i] = len(own)
                    least.append(own[:sketch].view(np.int64).tolist())
                prints[i] = fold(hashes)
            columns = [batch.column(0), pa.array(prints.view(np.int64))]
            names = ["doc_id", "fp"]
            if sketch:
                columns += [pa.array(least, pa.list_(pa.int64())), pa.array(sizes)]
                names += ["least", "n_shingles"]
            yield pa.RecordBatch.from_arrays(columns, names)

    return rows


def fingerprints(docs: DataFrame, words: int, sketch: int = 0) -> DataFrame:
    """doc_id, fp (as a signed long); with ``sketch`` also the smallest shingle hashes and the number of distinct ones, and fp is of the distinct ones."""
    schema = T.StructType([docs.schema["doc_id"], T.StructField("fp", T.LongType())])
    if sketch:
        schema.add("least", T.ArrayType(T.LongType())).add("n_shingles", T.LongType())
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(thrifty(_fingerprint_rows(words, sketch)), schema)


def block_keys(fp: str, radius: int, shared: int = 2) -> F.Column:
    """Shard keys of a fingerprint, an array of longs.

    The bits are cut into ``radius + shared`` blocks.  Two fingerprints that differ
    in at most ``radius`` bits agree in ``shared`` blocks at least, so they share
    the key of one combination of ``shared`` blocks.
    """
    n = radius + shared
    edges = [round(i * BITS / n) for i in range(n + 1)]
    keys = []
    for k, combo in enumerate(itertools.combinations(range(n), shared)):
        blocks = [F.shiftrightunsigned(fp, edges[b]).bitwiseAND(F.lit((1 << edges[b + 1] - edges[b]) - 1)) for b in combo]
        keys.append(F.xxhash64(F.lit(k), *blocks))
    return F.array(*keys)


class BKTree:
    """Values by Hamming distance: each child hangs on its parent by the distance between them."""

    def __init__(self) -> None:
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def search_insert(self, value: int, radius: int) -> list[tuple[int, int]]:
        """(distance, place) of the earlier values within ``radius``; then ``value`` is a member too."""
        place = len(self.values)
        found, todo = [], [0] if place else []
        while todo:
            at = todo.pop()
            d = (self.values[at] ^ value).bit_count()
            if d <= radius:
                found.append((d, at))
            todo += [c for edge, c in self.children[at].items() if d - radius <= edge <= d + radius]
        at = 0
        while place:
            d = (self.values[at] ^ value).bit_count()
            step = self.children[at].get(d)
            if step is None:
                self.children[at][d] = place
                break
            at = step
        self.values.append(value)
        self.children.append({})
        return found


def shard_links(values: list[int], radius: int) -> list[tuple[int, int]]:
    """A minimum spanning forest of the links within ``radius`` among a shard's members."""
    tree = BKTree()
    by_distance: list[list[tuple[int, int]]] = [[] for _ in range(radius + 1)]
    for place, value in enumerate(values):
        for d, at in tree.search_insert(value, radius):
            by_distance[d].append((at, place))
    root = list(range(len(values)))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out = []
    for links in by_distance:
        for a, b in links:
            x, y = find(a), find(b)
            if x != y:
                root[max(x, y)] = min(x, y)
                out.append((a, b))
    return out


def _link_rows(radius: int):
    """Rows arrive sorted by shard; a shard may go over the end of a batch."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left: list[np.ndarray] = [np.zeros(0, np.int64) for _ in range(3)]

        def linked(shard: np.ndarray, node: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
            us, vs = [], []
            cut = np.flatnonzero(np.diff(shard)) + 1
            starts, ends = np.concatenate([[0], cut]), np.concatenate([cut, [len(shard)]])
            for a, b in zip(starts[ends - starts > 1].tolist(), ends[ends - starts > 1].tolist()):
                own = node[a:b].tolist()
                for x, y in shard_links(fp[a:b].view(np.uint64).tolist(), radius):
                    if own[x] != own[y]:
                        us.append(own[x]), vs.append(own[y])
            return pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], ["u", "v"])

        for batch in batches:
            now = [np.concatenate([old, c.to_numpy(zero_copy_only=False)]) for old, c in zip(left, batch.columns)]
            whole = int(np.searchsorted(now[0], now[0][-1])) if len(now[0]) else 0
            left = [x[whole:] for x in now]
            if whole:
                yield linked(*(x[:whole] for x in now))
        if len(left[0]):
            yield linked(*left)

    return rows


def deal_shards(members: DataFrame, most: int, weight: str | None = None, most_weight: int = 2_000_000) -> DataFrame:
    """``members`` (key, node and others) with a shard for each shard that they are in, instead of the key.

    A key with over ``most`` members, or over ``most_weight`` of ``weight``, is dealt out: its members are hashed into chunks of
    about ``most``, and each pair of chunks makes a shard.
    """
    load = F.col("count") / most
    sums = [F.count(F.lit(1)).alias("count")]
    if weight:
        load = F.greatest(load, F.col("weight") / most_weight)
        sums.append(F.sum(weight).alias("weight"))
    hot = members.groupBy("key").agg(*sums).where((load > 1) & (F.col("count") > 1)).select("key", F.least(F.ceil(load), "count").cast("int").alias("chunks"))
    dealt = members.join(hot, "key", "left")
    own = F.when(F.col("chunks").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64("node"), F.col("chunks"))).cast("int")
    cells = F.transform(F.sequence(F.lit(0), F.coalesce(F.col("chunks"), F.lit(1)) - 1), lambda j: F.xxhash64("key", F.least(own, j), F.greatest(own, j)))
    # ids in 64 bits: a shard shared by chance only costs comparisons
    return dealt.select(F.explode(cells).alias("shard"), *[c for c in members.columns if c != "key"])


def by_shard(shards: DataFrame) -> DataFrame:
    n = int(shards.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return shards.repartition(n, "shard").sortWithinPartitions("shard")


def tree_links(members: DataFrame, radius: int, most: int = 1000) -> DataFrame:
    """Links u, v between the nodes of ``members`` (key, node, fp) that share a key and are within ``radius``."""
    return by_shard(deal_shards(members, most)).mapInArrow(thrifty(_link_rows(radius)), "u long, v long")


def near_duplicates(docs: DataFrame, words: int = 3, radius: int = 3, shared: int = 2, most: int = 1000) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id, one row for each row of ``docs``.

    ``docs``: doc_id (a long) and text; other columns are ignored.  Texts link where their
    fingerprints differ in ``radius`` bits or less; component_id is the smallest doc_id
    reachable over links, itself included.

    A null text is an empty one; texts without words have fingerprint zero and are linked
    like any others.  Equal texts share a fingerprint.  Rows that share a doc_id are each
    reported.  A row with a null doc_id gets its fingerprint and a null component_id,
    and links nothing.  An empty table gives an empty result.
    """
    prints = materialize(fingerprints(docs, words), "fingerprints")
    nodes = materialize(prints.where("doc_id is not null").groupBy("fp").agg(F.min(F.col("doc_id").cast("long")).alias("node")), "nodes")
    members = nodes.select(F.explode(block_keys("fp", radius, shared)).alias("key"), "node", "fp")
    linked = components(tree_links(members, radius, most))
    named = nodes.join(linked, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id"))
    out = prints.join(named, "fp", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), component)


def sketch_members(prints: DataFrame, keys: int, *others: str) -> DataFrame:
    """key, node and ``others`` of nodes (node, least) for each of their ``keys`` smallest shingle hashes.

    For radii at which shards by blocks of bits would hold nearly everything: two texts of
    shingle similarity J agree in the smallest hash of their union with probability J, and miss each
    other in all of ``keys`` with about (1 - J) ** keys.
    """
    members = prints.select(F.explode(F.slice("least", 1, keys)).alias("key"), "node", *others)
    none = prints.where(F.size("least") == 0).select(F.lit(0).cast("long").alias("key"), "node", *others)
    return members.unionByName(none)


def _similar_rows(words: int, least: float):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            u, v, a, b = (c.to_pylist() for c in batch.columns)
            good = []
            cache: dict[int, np.ndarray] = {}
            for x, y, s, t in zip(u, v, a, b):
                own = []
                for node, text in ((x, s), (y, t)):
                    if node not in cache:
                        if len(cache) > 64:
                            cache.clear()
                        cache[node] = np.unique(shingle_hashes((text or "").encode(), words))
                    own.append(cache[node])
                both = len(np.intersect1d(*own, assume_unique=True))
                whole = len(own[0]) + len(own[1]) - both
                good.append(whole == 0 or both >= least * whole)
            yield pa.RecordBatch.from_arrays([pa.array([x for x, g in zip(u, good) if g], pa.int64()), pa.array([y for y, g in zip(v, good) if g], pa.int64())], ["u", "v"])

    return rows


def _open_rows(radius: int, least: float, few: int):
    """(shard, node) of the members that are within ``radius`` of one of another component, or have few shingles on a side; rows arrive sorted by shard."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left: list[np.ndarray] = [np.zeros(0, np.int64) for _ in range(5)]

        def opened(shard, node, fp, n, component) -> pa.RecordBatch:
            out = []
            edges = np.flatnonzero(np.diff(shard)) + 1
            starts, ends = np.concatenate([[0], edges]), np.concatenate([edges, [len(shard)]])
            several = np.minimum.reduceat(component, starts) != np.maximum.reduceat(component, starts)
            for a, b in zip(starts[several].tolist(), ends[several].tolist()):
                bits, sizes, own = fp[a:b].view(np.uint64), n[a:b], component[a:b]
                hit = np.zeros(b - a, bool)
                for lo in range(0, b - a, 256):
                    some = slice(lo, lo + 256)
                    near = np.bitwise_count(bits[some, None] ^ bits[None, :]) <= radius
                    fewer = np.minimum(sizes[some, None], sizes[None, :])
                    near |= fewer <= few
                    near &= own[some, None] != own[None, :]
                    # sets of sizes m <= n have a Jaccard similarity of m / n at most
                    near &= fewer >= least * np.maximum(sizes[some, None], sizes[None, :])
                    hit[some] |= near.any(1)
                out.append(a + np.flatnonzero(hit))
            at = np.concatenate(out) if out else np.zeros(0, np.int64)
            return pa.RecordBatch.from_arrays([pa.array(shard[at]), pa.array(node[at])], ["shard", "node"])

        for batch in batches:
            now = [np.concatenate([old, c.to_numpy(zero_copy_only=False)]) for old, c in zip(left, batch.columns)]
            whole = int(np.searchsorted(now[0], now[0][-1])) if len(now[0]) else 0
            left = [x[whole:] for x in now]
            if whole:
                yield opened(*(x[:whole] for x in now))
        if len(left[0]):
            yield opened(*left)

    return rows


def _set_rows(words: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.unique(shingle_hashes((t or "").encode(), words)).tobytes() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], ["node", "shingles"])

    return rows


def common_counts(sets: list[np.ndarray], step: int = 4096) -> np.ndarray:
    """How many elements any two of ``sets`` (distinct elements each) have in common."""
    both = np.zeros((len(sets), len(sets)))
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, column, uses = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = uses > 1
    keep = shared[column]
    column, owner = (np.cumsum(shared) - 1)[column[keep]], owner[keep]
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    n = int(shared.sum())
    for lo in range(0, n, step):
        a, b = np.searchsorted(column, [lo, lo + step])
        part = np.zeros((len(sets), min(step, n - lo)), np.float32)
        part[owner[a:b], column[a:b] - lo] = 1
        both += part @ part.T
    return both


def _verified_rows(radius: int, least: float, few: int):
    """Links between components, a forest for each shard, from all its pairs within ``radius`` that are similar; rows arrive sorted by shard."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def linked() -> list[tuple[int, int]]:
            bits = np.array([r[1] for r in held], np.int64).view(np.uint64)
            own = [r[2] for r in held]
            sets = [np.frombuffer(r[3], np.uint64) for r in held]
            sizes = np.array([len(s) for s in sets])
            both = common_counts(sets)
            root = {c: c for c in own}

            def find(x: int) -> int:
                while root[x] != x:
                    root[x] = root[root[x]]
                    x = root[x]
                return x

            out = []
            for x in range(len(held)):
                near = (np.bitwise_count(bits[x] ^ bits[x + 1 :]) <= radius) | (np.minimum(sizes[x], sizes[x + 1 :]) <= few)
                near &= both[x, x + 1 :] >= least * (sizes[x] + sizes[x + 1 :] - both[x, x + 1 :])
                for y in (np.flatnonzero(near) + x + 1).tolist():
                    a, b = find(own[x]), find(own[y])
                    if a != b:
                        root[max(a, b)] = min(a, b)
                        out.append((own[x], own[y]))
            return out

        def batch_of(links: list[tuple[int, int]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([p[i] for p in links], pa.int64()) for i in range(2)], ["u", "v"])

        last = None
        for batch in batches:
            out = []
            for shard, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if shard != last and held:
                    out += linked()
                    held.clear()
                last = shard
                held.append((shard, *row))
            yield batch_of(out)
        if held:
            yield batch_of(linked())

    return rows


def open_links(nodes: DataFrame, texts: DataFrame, words: int, radius: int, least: float, keys: int, most: int, few: int) -> DataFrame:
    """Links between components of ``nodes`` (node, own, fp, least, n_shingles, component) from every pair of one shard that is
    within ``radius`` (or has at most ``few`` shingles on one side) and similar.  The shingles of a text (``texts``: id, own, text) move only to shards where it has such a pair left to verify."""
    shards = deal_shards(sketch_members(nodes, keys, "fp", "n_shingles", "component"), most, "n_shingles")
    opened = by_shard(shards).mapInArrow(thrifty(_open_rows(radius, least, few)), "shard long, node long")
    opened = materialize(opened, "open")
    used = opened.select("node").distinct().join(nodes.select("node", F.col("own").alias("of")), "node")
    sets = texts.join(used, (texts.id == used.node) & (texts.own == used.of), "left_semi").dropDuplicates(["id", "own"]).select("id", "text").mapInArrow(thrifty(_set_rows(words)), "node long, shingles binary")
    full = opened.join(nodes.select("node", "fp", "component"), "node").join(sets, "node").select("shard", "fp", "component", "shingles")
    return by_shard(full).mapInArrow(thrifty(_verified_rows(radius, least, few)), "u long, v long")


def similar_groups(docs: DataFrame, words: int = 5, radius: int = 16, least: float = 0.8, keys: int = 8, most: int = 1000, wide: int = 24, few: int = 16) -> DataFrame:
    """doc_id and component_id of near-duplicate texts by shingle similarity, one row for each row of ``docs``.

    Texts with the same fingerprint and the same sketch are one node.  Two nodes are alike where they share one of their ``keys``
    smallest shingle hashes, their fingerprints are within ``wide`` bits or one of them has at most ``few`` shingles, and the exact Jaccard
    similarity of the distinct shingles is at least ``least``; groups are the components of all such pairs.  What BK-trees link
    within ``radius`` bits (the tightest links of a spanning forest) is verified first; then every pair whose components are still apart.  Nulls, empty texts, repeated rows and empty
    tables: as in :func:`near_duplicates`.
    """
    # a node's text is the one it was made of, also where rows share a doc_id
    text = F.col("text").cast("string")
    named = docs.select(F.struct(F.col("doc_id").alias("id"), F.xxhash64(text).alias("own")).alias("doc_id"), text.alias("text"))
    prints = fingerprints(named, words, sketch=max(keys, 16)).select("doc_id.id", "doc_id.own", "fp", "least", "n_shingles").withColumnRenamed("id", "doc_id")
    prints = materialize(prints.withColumn("same", F.xxhash64("fp", "n_shingles", F.array_join(F.col("least").cast("array<string>"), ","))), "sketches")
    nodes = prints.where("doc_id is not null").groupBy("same").agg(F.min(F.struct(F.col("doc_id").cast("long").alias("node"), "own")).alias("x"), F.first("fp").alias("fp"), F.first("least").alias("least"), F.first("n_shingles").alias("n_shingles"))
    # one doc_id may have rows of several sketches: each is a node, and they are linked as one document
    nodes = materialize(nodes.select("same", "x.node", "x.own", "fp", "least", "n_shingles"), "nodes")
    trees = tree_links(sketch_members(nodes, keys, "fp"), radius, most)
    links = materialize(trees.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "links")
    used = links.select(F.col("u").alias("node")).unionByName(links.select(F.col("v").alias("node"))).distinct()
    used = used.join(nodes.select("node", "own"), "node").select(F.col("node").alias("id"), "own")
    known = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("id"), F.xxhash64(text).alias("own"), text.alias("text"))
    texts = materialize(known.join(used, ["id", "own"], "left_semi").dropDuplicates(["id", "own"]), "linked")
    pairs = links.join(texts.select(F.col("id").alias("u"), F.col("text").alias("a")), "u").join(texts.select(F.col("id").alias("v"), F.col("text").alias("b")), "v")
    good = pairs.select("u", "v", "a", "b").mapInArrow(thrifty(_similar_rows(words, least)), "u long, v long")
    first = nodes.join(components(good), "node", "left").withColumn("component", F.coalesce("component", "node"))
    first = materialize(first, "first_groups")
    joined = components(open_links(first, known, words, max(radius, wide), least, keys, most, few)).select(F.col("node").alias("component"), F.col("component").alias("whole"))
    named = first.select("same", "component").join(joined, "component", "left").select("same", F.coalesce("whole", "component").alias("component_id"))
    out = prints.select("doc_id", "same").join(named, "same", "left")
    return out.select("doc_id", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))
