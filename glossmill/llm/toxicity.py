"""Toxicity by non-negative positive-unlabelled learning (Kiryo et al., 2017).

A linear classifier over hashed words is trained in numpy from confirmed toxic
texts and unlabelled text.  Its risk is the class prior's share of the positive risk plus the
unlabelled negative risk less the share that positives have in it; where that
difference falls below zero it is corrected by ascending on it instead, so that the
classifier cannot fit the positives away.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import distinct, hash_sample, hash_words, materialize, mix, row_slices, scratch_scope, text_buffer, thrifty


_PLAIN = np.arange(256, dtype=np.uint8)
_PLAIN[[c for c in range(128) if not chr(c).isalnum()]] = 0x20


#: Features beside whole words: the first so many bytes of words that are longer.
PREFIXES = (5, 7)


def features(data: np.ndarray, offsets: np.ndarray, bits: int, prefixes: tuple[int, ...] = PREFIXES) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of a few texts: slot of each distinct feature of a text, and the first of each text.

    Features are the words of the lower-cased text without ASCII punctuation, and the beginnings
    of long ones, each once in a text however often it occurs.
    """
    part = _PLAIN[data[offsets[0] : offsets[-1]]]
    offsets = offsets - offsets[0]
    words, starts, ends, firsts = hash_words(part, offsets, lower=True)
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(firsts))
    slots, owners = [words], [owner]
    for k in prefixes:
        long = np.flatnonzero(ends - starts > k)
        if len(long):
            head = part[starts[long][:, None] + np.arange(k)].ravel()
            cut = np.arange(len(long) + 1) * k
            slots.append(mix(hash_words(head, cut, lower=True)[0] + np.uint64(k)))
            owners.append(owner[long])
    keys = distinct(np.concatenate(owners).astype(np.uint64) << np.uint64(bits) | np.concatenate(slots) >> np.uint64(64 - bits))
    owner = (keys >> np.uint64(bits)).astype(np.int64)
    return (keys & np.uint64((1 << bits) - 1)).astype(np.int64), np.searchsorted(owner, np.arange(len(offsets)))


def margins(weights: np.ndarray, bias: float, slots: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """The margin of each text, which does not depend on the texts around it."""
    n = len(firsts) - 1
    return np.bincount(np.repeat(np.arange(n), np.diff(firsts)), weights[slots], n) + bias


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def telling(sample: DataFrame, least_z: float, most: int) -> DataFrame:
    """slot of the features whose shares among positives and unlabelled texts differ by ``least_z`` standard errors, at most ``most`` of them.

    ``sample``: positive, drawn, slots; a text that is both counts on both sides.
    """
    sides = sample.agg(F.greatest(F.count_if("positive"), F.lit(1)).alias("n_pos"), F.greatest(F.count_if("drawn"), F.lit(1)).alias("n_all"))
    counts = sample.select("positive", "drawn", F.explode("slots").alias("slot")).groupBy("slot").agg(F.count_if("positive").alias("p"), F.count_if("drawn").alias("u"))
    both = (F.col("p") + F.col("u") + 1) / (F.col("n_pos") + F.col("n_all") + 2)
    z = F.abs(F.col("p") / F.col("n_pos") - F.col("u") / F.col("n_all")) / F.sqrt(both * (1 - both) * (1 / F.col("n_pos") + 1 / F.col("n_all")))
    return counts.join(F.broadcast(sides)).withColumn("z", z).where(F.col("z") >= least_z).orderBy(F.desc("z"), "slot").limit(most).select("slot")


def risk(z: np.ndarray, positive: np.ndarray, prior: float, beta: float = 0.0, gamma: float = 1.0) -> tuple[float, np.ndarray]:
    """The corrected risk that is stepped on, and its slope by each text's margin.

    With the logistic loss: prior * mean over positives of loss(+) plus the negative risk, mean over unlabelled of loss(-) less
    prior * mean over positives of loss(-).  Where the negative risk is below ``-beta``, the step is on ``-gamma`` times it alone.
    """
    n_pos, n_all = max(1, int(positive.sum())), max(1, int((~positive).sum()))
    p = sigmoid(z)
    share = np.where(positive, prior / n_pos, 0.0)
    negative = np.where(positive, -prior / n_pos, 1 / n_all)
    negative_risk = float(negative @ np.logaddexp(0, z))
    if negative_risk < -beta:
        return -gamma * negative_risk, -gamma * negative * p
    return float(share @ np.logaddexp(0, -z)) + negative_risk, negative * p + share * (p - 1)


def train(slots: np.ndarray, firsts: np.ndarray, n_slots: int, positive: np.ndarray, prior: float, rounds: int = 300, step: float = 0.05, ridge: float = 5e-4) -> tuple[np.ndarray, float]:
    """Weights of ``n_slots`` features and the bias; ``positive`` marks the confirmed texts, all others are unlabelled.

    Adam on the full sample; ``slots`` and ``firsts`` as :func:`features` gives them.
    """
    rows = np.repeat(np.arange(len(positive)), np.diff(firsts))
    w, bias = np.zeros(n_slots), float(np.log(prior / (1 - prior)))
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for t in range(1, rounds + 1):
        _, slope = risk(margins(w, bias, slots, firsts), positive, prior)
        grad = np.bincount(slots, slope[rows], n_slots) + ridge * w
        gb = float(slope.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        rate = step * np.sqrt(1 - 0.999**t) / (1 - 0.9**t)
        w -= rate * m / (np.sqrt(v) + 1e-8)
        bias -= rate * mb / (np.sqrt(vb) + 1e-8)
    return w, bias


def calibrate(z: np.ndarray, positive: np.ndarray, prior: float, threshold: float, cost: float = 1.5, slack: float = 0.5) -> tuple[float, float]:
    """Slope and shift of margins, so that a score of ``threshold`` falls where the classes part.

    A cut's corrected error is its missed positives at their prior, plus the unlabelled texts above it beyond the positives'
    share, ``cost`` times.  Of the cuts whose error is within ``slack`` standard errors (of a share of the unlabelled
    texts) of the least, the one in the middle of the widest gap between margins is taken.  The slope spreads the scores around it.
    """
    order = np.unique(np.round(z, 9))
    cuts, gaps = ((order[1:] + order[:-1]) / 2, np.diff(order)) if len(order) > 1 else (np.zeros(1), np.ones(1))
    pos, rest = np.sort(z[positive]), np.sort(z[~positive])
    miss = np.searchsorted(pos, cuts) / max(1, len(pos))
    above = 1 - np.searchsorted(rest, cuts) / max(1, len(rest))
    error = prior * miss + cost * np.maximum(0.0, above - prior * (1 - miss))
    near = np.flatnonzero(error <= error.min() + slack * np.sqrt(prior * (1 - prior) / max(1, len(rest))))
    cut = float(cuts[near[np.argmax(gaps[near])]])
    spread = max(float(np.median(pos) - cut) if len(pos) else 1.0, 1e-3)
    slope = 3.0 / spread
    return slope, float(np.log(threshold / (1 - threshold))) - slope * cut


def _feature_rows(bits: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffer(batch.column(1))
            parts = [features(data, offsets[a : b + 1], bits) for a, b in row_slices(offsets)]
            slots = np.concatenate([p[0] for p in parts]) if parts else np.zeros(0, np.int64)
            firsts = np.concatenate([[0], np.cumsum(np.concatenate([np.diff(p[1]) for p in parts] or [[]]))]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(firsts), pa.array(slots.astype(np.int32)))], ["row", "slots"])

    return rows


def fit(sample: DataFrame, prior: float, threshold: float, bits: int, fold: int = 5, least_held: int = 20, least_z: float = 5.0, most: int = 2000) -> tuple[np.ndarray, float, float, float, int]:
    """Weights, bias, slope, shift and bits, from ``sample``: doc_id, positive, drawn and slots (of whole texts).

    One text in ``fold``, by the hash of its doc_id, is kept from the training and places the cut, since the margins of texts
    trained on are too wide; where that leaves under ``least_held`` positives, all texts do.  The driver gets no
    texts, only which of the ``most`` telling features each text of the sample has.
    """
    aside = F.pmod(F.xxhash64("doc_id", F.lit("aside")), F.lit(fold)) == 0
    if sample.where(aside & F.col("positive")).count() < least_held:
        aside = F.lit(False)
    marked = sample.withColumn("aside", aside)
    used = np.sort(np.array([r.slot for r in telling(marked.where("not aside"), least_z, most).collect()], np.int64))
    own = F.array_intersect("slots", F.lit(used.astype(int).tolist()).cast("array<int>")) if len(used) else F.lit([]).cast("array<int>")
    kept = marked.select("doc_id", "positive", "drawn", "aside", F.array_sort(own).alias("slots")).collect()
    rows = [(0, r) for r in kept if r.positive] + [(1, r) for r in kept if r.drawn]
    rows.sort(key=lambda x: (x[0], x[1].doc_id is None, x[1].doc_id or 0, x[1].slots))
    positive, held = np.array([side == 0 for side, _ in rows], bool), np.array([r.aside for _, r in rows], bool)

    def laid_out(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        lists = [rows[i][1].slots for i in np.flatnonzero(mask)]
        flat = np.fromiter((x for own in lists for x in own), np.int64)
        return np.searchsorted(used, flat), np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int64)

    w, bias = train(*laid_out(~held), len(used), positive[~held], prior)
    seen = held if held.any() else ~held
    slope, shift = calibrate(margins(w, bias, *laid_out(seen)), positive[seen], prior, threshold)
    whole = np.zeros(1 << bits, np.float32)
    whole[used] = w
    return whole, bias, slope, shift, bits


def _score_rows(model):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias, slope, shift, bits = model()
        for batch in batches:
            data, offsets = text_buffer(batch.column(1))
            z = [margins(weights, bias, *features(data, offsets[a : b + 1], bits)) for a, b in row_slices(offsets)]
            z = np.concatenate(z) if z else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sigmoid(slope * z + shift))], ["row", "score"])

    return rows


def score_toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, bits: int = 21, max_positive: int = 3000, max_unlabelled: int = 6000) -> DataFrame:
    """All columns of ``docs`` with held_out, score and predicted.

    ``docs``: doc_id and text; ``labels``: doc_id and toxic (0 or 1; null: unlabelled).  Rows whose
    crc32 of doc_id, as text, is 1 modulo 3 are held out: neither their labels nor
    their texts are learned from.  Of the others, the confirmed toxic documents and the unlabelled
    ones (drawn from all documents, as the risk estimator wants) are sampled by the hash of doc_id, of the former about
    ``max_positive`` at most, of the latter the share that makes ``max_unlabelled`` rows of the whole table, and the class prior is
    the share of 1 among the labels.  Texts are learned from and scored whole, however long.

    Null and empty texts score as the classifier's bias does.  A null doc_id counts as not
    held out.  Documents with several label rows are toxic if one of them says so.
    Columns of ``docs`` named as the three added ones are replaced.  Without a confirmed toxic
    document nothing can be learned: every score is 0.  An empty table gives an empty result.
    """
    spark = docs.sparkSession
    held = lambda c: F.coalesce(F.crc32(F.col(c).cast("string").cast("binary")) % 3 == 1, F.lit(False))
    known = labels.where(~held("doc_id") & F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    share = known.agg(F.avg("toxic").alias("p")).first()
    toxic = hash_sample(known.where("toxic = 1"), "doc_id", max_positive).select("doc_id", F.lit(True).alias("positive"))  # about max_positive rows at most
    slim = docs.select("doc_id", F.col("text").cast("string").alias("text")).where(~held("doc_id"))
    share_taken = min(1.0, max_unlabelled / max(1, docs.count()))
    drawn = F.pmod(F.xxhash64("doc_id", F.lit("turn")), F.lit(1 << 40)) < int(share_taken * (1 << 40))
    picked = slim.join(F.broadcast(toxic), "doc_id", "left").select(F.struct("doc_id", F.coalesce("positive", F.lit(False)).alias("positive"), drawn.alias("drawn")).alias("row"), "text").where("row.positive or row.drawn")
    found = picked.mapInArrow(thrifty(_feature_rows(bits)), T.StructType([picked.schema["row"], T.StructField("slots", T.ArrayType(T.IntegerType()))]))
    with scratch_scope(spark):
        sample = materialize(found.select("row.*", "slots"), "toxicity")  # the bounds above, in rows
        if sample.where("positive").take(1):
            prior = min(0.5, max(1e-3, float(share.p)))
            model = fit(sample, prior, threshold, bits)
        else:
            model = (np.zeros(1 << bits, np.float32), 0.0, 0.0, -40.0, bits)
    sent = spark.sparkContext.broadcast(model)  # 4 bytes times 2 ** bits
    others = [c for c in docs.columns if c not in ("held_out", "score", "predicted")]
    row = F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(others)])
    packed = docs.select(row.alias("row"), F.col("text").cast("string").alias("text"))
    out = packed.mapInArrow(thrifty(lambda it: _score_rows(lambda: sent.value)(it)), T.StructType([packed.schema["row"], T.StructField("score", T.DoubleType())]))
    back = [F.col("row").getField(f"c{i}").alias(c) for i, c in enumerate(others)]
    out = out.select(*back, "score")
    return out.select(*[f"`{c}`" for c in others], held("doc_id").alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
