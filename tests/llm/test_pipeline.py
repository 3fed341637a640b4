"""The pipeline's stages against brute force, on rows with nulls, empty texts, repeats, ties and clashing columns."""

import zlib
from collections import Counter

import pytest

import corpus_pipeline
from glossmill.llm import _common

from .test_corpus_operators import brute_leaks, brute_lines, prose, toxic_rows, union_find

SHAPE = "doc_id long, text string, lang string, source string, n_chars long, score int, n_lines int, component_id int"
STAGES = dict(corpus_pipeline.STAGES)


def stage(spark, name, rows, sf_dir):
    docs = spark.createDataFrame([(i, t, None if i is None else "en", f"src{(i or 0) % 20}", None if t is None else len(t), 1, 2, 3) for i, t in rows], SHAPE)
    return STAGES[name](spark, docs, sf_dir)


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("tables")
    _, labels, _ = toxic_rows()
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    spark.createDataFrame(ITEMS, "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    return str(root)


ITEMS = [(1, prose(9001, 25)), (2, prose(9002, 40)), (3, None), (4, "")]
SHARED = "This line is found in more documents than five, and so it is dropped."


def awkward():
    base = prose(40, 120)
    rows = [(i, f"{prose(i, 30)}\n{SHARED}\n{prose(i + 300, 9)}") for i in range(12)]
    rows += [(20 + i, base.replace(" ", "  ") if i == 3 else " ".join([f"new{i}", *base.split()[1:]]) if i else base) for i in range(5)]
    rows += [(30, f"{prose(31, 12)} {ITEMS[0][1].upper()}, {prose(32, 12)}"), (31, ITEMS[1][1]), (32, " ".join(ITEMS[1][1].split()[:20]))]
    rows += [(50, None), (51, ""), (52, " \n"), (53, "one two"), (54, "One  two"), (55, "x " * 30_000), (None, None), (None, base), (None, SHARED)]
    return rows + [rows[0], rows[14], rows[18]]


def ids(rows):
    return Counter(r.doc_id for r in rows)


def test_toxicity_keeps_what_it_does_not_reject(spark, tables):
    rows, _, held = toxic_rows()
    out = stage(spark, "toxicity", rows + awkward()[-12:], tables)
    assert out.columns == corpus_pipeline.COLUMNS
    kept = ids(out.collect())
    bad = [d for d, _ in rows if d % 9 == 0 and held(d)]
    good = [d for d, _ in rows if d % 9 and held(d)]
    assert all(held(d) == (zlib.crc32(str(d).encode()) % 3 == 1) for d in bad)
    assert sum(d in kept for d in bad) <= 0.1 * len(bad) and sum(d in kept for d in good) >= 0.98 * len(good)
    assert kept[None] == 3


def test_line_dedup(spark, tables):
    rows = awkward()
    out = stage(spark, "line dedup", rows, tables)
    assert out.columns == corpus_pipeline.COLUMNS
    got = sorted(((r.doc_id, r.text) for r in out.collect()), key=str)
    assert got == sorted(((d, t) for d, t, *_ in brute_lines(rows, 40, 5)), key=str)
    assert all(r.n_chars == len(r.text) for r in out.where("n_chars is not null").collect())


def test_near_dedup(spark, tables):
    rows = awkward()
    lower = lambda t: "".join(c.lower() if c.isascii() else c for c in t or "").split()
    sets = {}
    for i, t in rows:
        if i is not None:
            w = lower(t)
            sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    alike = lambda a, b: (not a and not b) or bool(a | b) and len(a & b) >= 0.8 * len(a | b)
    group = union_find(sorted(sets), [(a, b) for a in sets for b in sets if a < b and alike(sets[a], sets[b])])
    out = stage(spark, "near dedup", rows, tables)
    assert out.columns == corpus_pipeline.COLUMNS
    assert ids(out.collect()) == Counter(i for i, _ in rows if i is None or group[i] == i)
    assert len(set(group.values())) < len(group) - 5


def test_decontamination(spark, tables):
    rows = [x for x in awkward() if x[0] != 55]
    leaks = {d for d, _ in brute_leaks([x for x in rows if x[0] is not None], ITEMS, 5, 0.8)}
    assert leaks == {30, 31}
    out = stage(spark, "decontamination", rows, tables)
    assert out.columns == corpus_pipeline.COLUMNS
    assert ids(out.collect()) == Counter(i for i, _ in rows if i not in leaks)


def test_mixing_takes_rows_of_one_id_together(spark, tables):
    rows = awkward()
    got = stage(spark, "mixing", rows, tables).collect()
    assert set(ids(got)) <= set(dict(rows)) and all(1 <= r.copies <= 4 for r in got)
    assert sum(r.n_tokens * r.copies for r in got) <= 0.5 * sum(len((t or "").split()) for _, t in rows)


def test_stages_of_nothing(spark, tables):
    for name in STAGES:
        assert stage(spark, name, [], tables).collect() == []


def test_run_leaves_nothing_but_what_its_result_reads(spark, tables):
    docs = spark.createDataFrame([(i, t, "en", f"src{(i or 0) % 20}", 1) for i, t in awkward()], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.mode("overwrite").parquet(f"{tables}/documents.parquet")
    _common.drop_scratch(spark)
    out = corpus_pipeline.run(spark, tables)
    assert out.count() > 0
    left = [p.rpartition("/")[2].partition("-")[0] for p, _ in _common._SCRATCH[spark.sparkContext.applicationId]]
    assert sorted(left) == ["decontamination", "mix"]
    _common.drop_scratch(spark)
