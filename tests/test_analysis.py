import random

import pytest
from pyspark.sql import functions as F

from glossmill.operators import collapse, inventory, mislabel, report, scoring, splits


def pairs_of(spark, *rows):
    return spark.createDataFrame([(i, f"u{i}", r, h) for i, (r, h) in enumerate(rows)], "_pos long, id string, ref string, hyp string")


def test_spans_merge_runs(spark):
    spans = inventory.edits(pairs_of(spark, ("上week的typhoon好猛", "上week的台风好猛"), ("我好busy", ""), ("我好", "我very好"), ("好", "好嗎")))
    rows = {(r.pos, r.span): r for r in spans.collect()}
    assert (rows[0, 0].kind, rows[0, 0].ref, rows[0, 0].hyp, rows[0, 0].is_poi) == ("sub", "typhoon", "台风", True)
    assert (rows[1, 0].kind, rows[1, 0].ref_lang, rows[1, 0].ref) == ("del", "mixed", "我好 busy")
    assert (rows[2, 0].kind, rows[2, 0].hyp) == ("ins", "very") and rows[3, 0].hyp == "嗎"
    assert {r.token for r in inventory.lost_tokens(spans).collect()} == {"typhoon", "busy"}


def test_top_keeps_first_seen_on_ties_and_filters_after(spark):
    spans = inventory.edits(pairs_of(spark, ("b", "甲"), ("a", "甲"), ("c", "甲"), ("c", "甲")))
    table = inventory.inventory(spans)
    assert [r.ref for r in inventory.top(table, 2).collect()] == ["c", "b"]
    assert [r.ref for r in inventory.top(table, 2, 2).collect()] == ["c"]
    assert "c -> 甲" in report.format_inventory(spans, 5, 1)
    assert report.inventory_to_dict(spans)["substitutions"]["en->zh"][0] == {"ref": "c", "hyp": "甲", "count": 2}


def test_swapped_neighbours(spark):
    rows = pairs_of(spark, ("今日天氣好好", "我要去返工"), ("我要去返工", "今日天氣好好"), ("完全無關嘅", "完全無關嘅"), ("", "唔知")).withColumnRenamed("_pos", "index")
    found = mislabel.misalignments(rows)
    assert [(r["index"], r.best_index) for r in found.orderBy("index").collect()] == [(0, 1), (1, 0)]
    assert [r["index"] for r in mislabel.mutual_pairs(found).collect()] == [0]
    assert mislabel.one_way(found).count() == 0
    assert mislabel.mer_impact(rows, found).first().mer_impact == pytest.approx((1.0 * 6 + 1.2 * 5) / 16)
    assert mislabel.misalignments(rows, window=1, ratio=-1.0).count() == 0
    assert mislabel.mer_impact(rows, found.where("false")).first().mer_impact == 0.0


def shuffled_rows(df):
    """Rows that the exchanges of a collected frame wrote, each exchange once."""
    todo, seen = [df._jdf.queryExecution().executedPlan()], {}
    while todo:
        node = todo.pop()
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
        elif kind.endswith("QueryStageExec"):
            todo.append(node.plan())
        else:
            if kind == "ShuffleExchangeExec":
                seen[node.id()] = node.metrics().apply("shuffleRecordsWritten").value()
            todo += [node.children().apply(i) for i in range(node.children().size())]
    assert seen
    return sum(seen.values())


def edits_between(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, up = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(up[j - 1] + (x != y), up[j] + 1, row[-1] + 1))
    return row[-1]


@pytest.mark.parametrize("part", [None, ["talk"]])
def test_mislabelled_rows_by_brute_force_deal_each_row_once(spark, part):
    rng = random.Random(5)
    refs = [" ".join(rng.choices("abcdefgh", k=rng.randint(0, 6))) for _ in range(1500)]
    refs[20:30] = ["a b c d"] * 10  # ties
    said = [refs[min(max(i + rng.randint(-7, 7), 0), 1499)] for i in range(1500)]
    rows = [(7 if i < 900 else 8, i, f"u{i}", r, h) for i, (r, h) in enumerate(zip(refs, said))]
    found = mislabel.misalignments(spark.createDataFrame(rows, "talk int, index long, id string, ref string, hyp string"), part=part).select("index", "best_index", "best_id", "own_mer", "best_mer")
    want = []
    for talk, i, _, r, h in rows:
        r, h = r.split(), h.split()
        own = edits_between(r, h) / len(r) if r and h else 0
        near = [(edits_between(o.split(), h) / len(o.split()), j) for t, j, _, o, _ in rows[max(0, i - 5) : i + 6] if j != i and o and (not part or t == talk)]
        if own >= 0.5 and near and (best := min(near))[0] < own and best[0] <= 0.5 and best[0] <= own * 0.5:
            want.append((i, best[1], f"u{best[1]}", own, best[0]))
    assert sorted(map(tuple, found.collect())) == want and len(want) > 300
    assert shuffled_rows(found) < 1.1 * len(rows)


def folders_of(spark, *signatures):
    rows = [(i, t) for i, s in enumerate(signatures, 1) for t in s]
    return splits.folder_table(spark.createDataFrame(rows, "folder int, topic string"))


def parts(df):
    out = {}
    for r in df.orderBy("folder").collect():
        out.setdefault(r.split, []).append(r.folder)
    return out


def test_positional_split_rounds_half_to_even(spark):
    assert len(parts(splits.positional_split(folders_of(spark, *["A"] * 10)))["train"]) == 7
    assert len(parts(splits.positional_split(folders_of(spark, *["A"] * 15)))["train"]) == 10  # 10.5
    assert parts(splits.positional_split(folders_of(spark, "A"))) == {"train": [1]}
    assert len(parts(splits.positional_split(folders_of(spark, *["A"] * 5), train_folders=2))["train"]) == 2


def test_stratified_split_and_dev(spark):
    table = folders_of(spark, *["A"] * 10, *["B"] * 6)
    p = parts(splits.stratified_split(table))
    assert p["train"] == [1, 2, 3, 4, 5, 6, 7, 11, 12, 13, 14] and p["test"] == [8, 9, 10, 15, 16]
    carved = parts(splits.carve_dev(splits.positional_split(folders_of(spark, *["A"] * 21)), 0.2))
    assert (len(carved["train"]), len(carved["dev"]), len(carved["test"])) == (12, 3, 6)
    assert parts(splits.stratified_split(folders_of(spark, "A", "BC", "CB"))) == {"train": [1, 2], "test": [3]}
    with pytest.raises(ValueError):
        splits.carve_dev(table, 1.0)


def test_balance(spark):
    rows = [("train", "A", "我哋開meeting傾project")] * 20 + [("test", "B", "今日天氣好好我哋去行山")] * 20
    found = splits.check_balance(spark.createDataFrame(rows, "split string, topic string, text string"))
    assert any("absent from test: A" in w for w in found) and any("easier" in w for w in found)
    assert splits.check_balance(spark.createDataFrame(rows[:20], "split string, topic string, text string")) == []


def test_equal_count_bins_are_not_ntile(spark):
    rows = spark.range(23).select(F.col("id").alias("_pos"), F.col("id").cast("double").alias("cmi_ref"), (F.col("id") == 22).alias("foreign_script"))
    d = collapse.dose_response(rows, "cmi_ref", 10).orderBy("bin").collect()
    assert [r.n for r in d] == [2, 2, 2, 3, 2, 2, 3, 2, 2, 3] and [r.collapsed for r in d][-1] == 1
    o = collapse.onset(rows).first()
    assert (o.onset, o.top_rate) == (20.0, pytest.approx(1 / 3))
    expected = lambda n, b: [int((k + 1) * (n / b)) - int(k * (n / b)) for k in range(b)]
    many = spark.range(49).select(F.col("id").alias("_pos"), F.lit(1.0).alias("cmi_ref"), F.lit(False).alias("foreign_script"))
    assert [r.n for r in collapse.dose_response(many, "cmi_ref", 49).orderBy("bin").collect()] == [n for n in expected(49, 49) if n]


def test_permutation_and_runs(spark):
    rows = spark.createDataFrame([(i, i % 50 / 50, i % 50 > 45, "สวัสดี" if i % 50 > 45 else "好", "m") for i in range(400)], "_pos long, cmi_ref double, foreign_script boolean, hyp string, model string")
    p = collapse.permutation_test(rows, n=500).first()
    assert p.p_value == pytest.approx(1 / 501) and p.observed > 0.4
    assert collapse.permutation_test(rows.where("not foreign_script"), n=10).first().p_value is None
    s = collapse.summarise_runs(rows).first()
    assert (s.n, s.collapsed, s.attractor, s.attractor_share) == (400, 32, "THAI", 1.0)
    g = collapse.concentration(rows.withColumn("speaker", F.col("_pos") % 4), "speaker")
    assert collapse.top_share(g, "speaker", 8).first().share == 1.0


def test_permutation_over_the_bound(spark, monkeypatch):
    import numpy as np

    rng = np.random.default_rng(3)
    sizes = np.array([5, 1, 30, 4])
    drawn = np.array([collapse.deal(rng, sizes, 13) for _ in range(20_000)])
    assert (drawn.sum(1) == 13).all() and (drawn <= sizes).all() and (drawn >= 0).all()
    exact = rng.multivariate_hypergeometric(sizes, 13, 20_000)
    assert drawn.mean(0) == pytest.approx(exact.mean(0), abs=0.05) and drawn.var(0) == pytest.approx(exact.var(0), abs=0.1)
    rows = spark.createDataFrame([(float(v), bool(f)) for v, f in zip(rng.random(300).round(2), rng.random(300) < 0.3)], "cmi_ref double, foreign_script boolean")
    whole, blocks = (collapse.permutation_test(rows, n=2000, most=m).first() for m in (1000, 100))
    assert blocks.observed == pytest.approx(whole.observed) and blocks.p_value == pytest.approx(whole.p_value, abs=0.05)
    monkeypatch.setattr(collapse._permute_blocks, "__defaults__", (20, 16))  # several blocks
    assert collapse.permutation_test(rows, n=2000, most=100).first().p_value == pytest.approx(whole.p_value, abs=0.05)
    assert collapse.permutation_test(rows.where("not foreign_script"), n=10, most=10).first().p_value is None


@pytest.mark.parametrize("most", [1000, 100])
def test_permutation_passes_over_the_rows_once(spark, most):
    rows = spark.createDataFrame([(i % 40 / 40, i % 7 == 0) for i in range(300)], "cmi_ref double, foreign_script boolean")
    seen = spark.sparkContext.accumulator(0)
    counted = F.udf(lambda x: seen.add(1) or x, "double").asNondeterministic()
    p = collapse.permutation_test(rows.withColumn("cmi_ref", counted("cmi_ref")), n=200, most=most).first()
    assert seen.value == 300
    a, b = ([i % 40 / 40 for i in range(300) if (i % 7 == 0) == x] for x in (True, False))
    assert p.observed == pytest.approx(abs(sum(a) / len(a) - sum(b) / len(b))) and 0.1 < p.p_value <= 1
    assert collapse.permutation_test(rows.where("false"), n=10, most=most).first().p_value is None


def test_registered_permutation_test_runs_all_permutations(monkeypatch):
    import inspect

    from glossmill.plans import queries

    n = []
    own = inspect.signature(collapse.permutation_test)
    monkeypatch.setattr(queries, "scored", lambda spark, sf_dir: None)
    monkeypatch.setattr(collapse, "permutation_test", lambda *a, **k: n.append((b := own.bind(*a, **k), b.apply_defaults())[0].arguments["n"]))
    queries.permutation_test(None, "")
    assert n == [10_000]


def test_reports_render(spark):
    m = scoring.diagnosis(scoring.corpus_metrics(scoring.score_utterances(pairs_of(spark, ("我好", "我好"))))).first()
    text = report.format_metrics(m, "x")
    assert "WER_en" in text and "n/a" in text and "nothing anomalous" in text


@pytest.mark.parametrize("rows_a_range", [10, 1_000_000])
def test_bins_with_one_hot_key(spark, rows_a_range):
    # nine of ten rows have one key; positions have gaps
    r = random.Random(12)
    rows = [(i * 7 + r.randrange(3), 0.0 if r.random() < 0.9 else r.choice([0.25, 0.5, None]), r.choice([1, 2, None])) for i in range(400)]
    df = spark.createDataFrame(rows, "pos long, k double, tie int")
    want = {}
    held = sorted((x for x in rows if x[1] is not None), key=lambda x: (x[1], x[2] is not None, x[2] or 0, x[0]))
    for b in range(7):
        for x in held[int(b * (len(held) / 7)) : int((b + 1) * (len(held) / 7))]:
            want[x[0]] = b
    got = collapse.equal_count_bins(df, "k", 7, "pos", ties=["tie"], rows_a_range=rows_a_range)
    assert got.columns == ["pos", "k", "tie", "bin"]
    assert {x.pos: x.bin for x in got.collect()} == want
