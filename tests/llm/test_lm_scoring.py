import math
import random
from collections import Counter

import numpy as np
import pytest

from glossmill.llm.lm_scoring import pack_counts, pack_sorted, partition_of, score_documents, unpack_counts, unpack_sorted


def test_packing_round_trip():
    rng = np.random.default_rng(0)
    values = np.unique(rng.integers(0, 1 << 63, 1000, dtype=np.uint64) * np.uint64(2))
    assert (unpack_sorted(pack_sorted(values)) == values).all()
    counts = rng.integers(1, 1 << 40, 1000)
    assert (unpack_counts(pack_counts(counts)) == counts).all()
    for n in (0, 1, 15, 16):
        assert (unpack_sorted(pack_sorted(values[:n])) == values[:n]).all()
        assert (unpack_counts(pack_counts(counts[:n])) == counts[:n]).all() and (unpack_counts(pack_counts(counts[:n] % 255)) == counts[:n] % 255).all()


def test_partitions_are_ranges_and_rows_no_more_than_n_grams():
    rng = np.random.default_rng(2)
    grams = np.unique(rng.integers(0, 1 << 63, 5000, dtype=np.uint64) * np.uint64(2))
    for parts in (1, 7, 10**6):
        part = partition_of(grams, parts)
        assert (np.diff(part) >= 0).all() and part.min() >= 0 and part.max() < parts


def brute(texts, order, alpha):
    docs = [[w.lower() for w in (t or "").split()] for t in texts]
    grams = lambda d, n: [tuple(d[i : i + n]) for i in range(len(d) - n + 1)]
    total = {n: Counter(g for d in docs for g in grams(d, n)) for n in range(1, order + 1)}
    out = []
    for d in docs:
        own = {n: Counter(grams(d, n)) for n in range(1, order + 1)}
        others = max(1, sum(map(len, docs)) - len(d))
        seen = lambda g: total[len(g)][g] - own[len(g)][g]

        def score(g):
            if not g[:-1]:
                return seen(g) / others if seen(g) else alpha / others
            return seen(g) / seen(g[:-1]) if seen(g) else alpha * score(g[1:])

        out.append(sum(math.log(score(tuple(d[max(0, i - order + 1) : i + 1]))) for i in range(len(d))))
    return out


@pytest.mark.parametrize("order,block_bytes,rows_a_part", [(1, 1 << 20, 50), (3, 200, 40), (3, 300, 1), (3, 1 << 20, 10**6)])
def test_scores_equal_brute_force(spark, order, block_bytes, rows_a_part):
    random.seed(3)
    texts = [" ".join(random.choice("a b c D d e the THE é x\n".split(" ")) for _ in range(random.randint(0, 30))) for _ in range(60)]
    texts += [None, "", "once", texts[3], "only here twice only here"]
    docs = spark.createDataFrame([(i, t, i) for i, t in enumerate(texts)], "doc_id long, text string, n_words int")
    got = {r.doc_id: r for r in score_documents(docs, order, 0.4, block_bytes, rows_a_part).collect()}
    for i, want in enumerate(brute(texts, order, 0.4)):
        assert got[i].log_score == pytest.approx(want, abs=1e-6), texts[i]
        assert got[i].n_words == len((texts[i] or "").split())


def test_nothing(spark):
    assert score_documents(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_rows_that_share_a_doc_id_are_documents_of_their_own(spark):
    texts = ["a b c", "a b c", "a b d"]
    docs = spark.createDataFrame([(1, texts[0]), (1, texts[1]), (None, texts[2])], "doc_id long, text string")
    got = sorted(round(r.log_score, 9) for r in score_documents(docs).collect())
    assert got == sorted(round(x, 9) for x in brute(texts, 3, 0.4))
