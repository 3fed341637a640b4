import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StringType
from pyspark.util import PythonEvalType

from glossmill.functions import align
from glossmill.functions import text as X
from glossmill.functions.align import edit_distance, op_string, token_distance
from glossmill.operators import inventory, scoring


def naive(ref, hyp):
    n, m = len(ref), len(hyp)
    d = [[i + j if not i or not j else 0 for j in range(m + 1)] for i in range(n + 1)]
    for i in range(1, n + 1):
        for j in range(1, m + 1):
            d[i][j] = min(d[i - 1][j - 1] + (ref[i - 1] != hyp[j - 1]), d[i - 1][j] + 1, d[i][j - 1] + 1)
    out, i, j = "", n, m
    while i or j:
        if i and j and d[i][j] == d[i - 1][j - 1] + (ref[i - 1] != hyp[j - 1]):
            out, i, j = ("E" if ref[i - 1] == hyp[j - 1] else "S") + out, i - 1, j - 1
        elif i and d[i][j] == d[i - 1][j] + 1:
            out, i = "D" + out, i - 1
        else:
            out, j = "I" + out, j - 1
    return out


def test_alignment_equals_a_plain_table():
    random.seed(0)
    for _ in range(2000):
        r, h = (["abcd"[random.randrange(k)] for _ in range(random.randint(0, 9))] for k in (random.randint(1, 4),) * 2)
        assert op_string(r, h) == naive(r, h)


def score(spark, *rows, window=1):
    df = spark.createDataFrame([(i, str(i), r, h) for i, (r, h) in enumerate(rows)], "_pos long, id string, ref string, hyp string")
    return scoring.score_utterances(df, window)


def test_goldens(spark):
    a, b, c, d, e, f, g = score(
        spark, ("我今日好busy要開meeting", "我今日好要開"), ("我要開meeting", "我要開會議"), ("我好busy啊", "我好啊"), ("我今日好busy", "我尋日好busy"), ("我好攰", "我好攰我好攰我好攰"), ("我今日好攰", "我今日好攰"), ("", "")
    ).orderBy("_pos").collect()
    assert (a.n_ref, a.dels, a.mer, a.en_lost) == (8, 2, 0.25, 2) and a.en_omitted
    assert (b.subs, b.ins, b.en_sub_by_zh) == (1, 1, 1)
    assert (c.mer, c.n_poi, c.poi_err) == (0.25, 3, 1)
    assert (d.mer, d.poi_err) == (0.2, 0)
    assert (e.ins, e.mer, e.length_ratio) == (6, 2.0, 3.0)
    assert f.mer == 0.0 and f.n_poi == 0
    assert g.mer is None and g.length_ratio == 1.0
    assert score(spark, ("我今日好busy", "我尋日好busy"), window=3).first().poi_err == 1


def test_corpus_rates_are_ratios_of_sums(spark):
    utts = score(spark, ("我", "你"), ("我今日好開心呀真係好", "我今日好開心呀真係好"))
    m = scoring.corpus_metrics(utts).first()
    assert m.mer == pytest.approx(1 / 11) and m.wer_en is None and m.pier is None
    empty = scoring.corpus_metrics(utts.where("false")).first()
    assert empty.n_utts == 0 and empty.mer is None


def test_clean_figures_and_foreign_script(spark):
    utts = score(spark, ("我好busy", "ผมยุ่งมากครับ"), ("", "我"), ("我好busy", "我好busy"))
    rows = utts.orderBy("_pos").collect()
    assert [r.foreign_script for r in rows] == [True, False, False]
    assert rows[1].length_ratio == float("inf")
    assert scoring.corpus_metrics_clean(utts).first().n_utts == 1
    m = scoring.corpus_metrics(utts).first()
    assert m.utts_runaway == 1  # an empty reference is none, and the Thai one is


def test_diagnosis(spark):
    find = lambda *rows: scoring.diagnosis(scoring.corpus_metrics(score(spark, *rows))).first().findings
    assert find(("我好busy", ""), ("好", "")) == ["no_output"]
    assert find(("我好", "我好")) == []
    assert "foreign_script" in find(("我好busy", "ผมยุ่งมากครับ")) and "errors_outnumber_tokens" not in find(("我好busy", "ผมยุ่งมากครับ"))
    assert "runaway" in find(("我好攰", "我好攰我好攰我好攰"))
    assert "english_omitted" in find(("我好busy啊", "我好啊"))


def test_tokens_and_switches(spark):
    row = spark.createDataFrame([("我好busy啊 don't 3.14 １２ \U00020000×!",)], "t string").select(X.tokens(F.col("t")).alias("t"))
    row = row.select("t", X.token_langs(F.col("t")).alias("l"))
    row = row.select("t", "l", X.switch_points(F.col("l")).alias("s"), X.code_mixing_index(F.col("l")).alias("c")).first()
    assert row.t == ["我", "好", "busy", "啊", "don't", "3.14", "１２", "\U00020000", "×", "!"]
    assert row.l == ["zh", "zh", "en", "zh", "en", "num", "num", "zh", "en", "other"]
    assert row.s == [2, 3, 4, 7, 8] and row.c == pytest.approx(3 / 7)
    poi = spark.range(1).select(X.poi_indices(F.array(F.lit(2), F.lit(3)), F.lit(4)).alias("p")).first().p
    assert poi == [1, 2, 3]
    with pytest.raises(ValueError):
        X.poi_indices(F.array(), F.lit(1), 0)


def test_native_distance(spark):
    df = spark.createDataFrame([(["a", "好", "c"], ["好", "c", "d"]), ([], ["x"]), ([], [])], "r array<string>, h array<string>")
    assert [x.d for x in df.select(token_distance(F.col("r"), F.col("h")).alias("d")).collect()] == [2, 1, 0]
    assert spark.range(1).select(edit_distance(F.lit("EESDI")).alias("d")).first().d == 3


def test_scripts(spark):
    df = spark.createDataFrame([("สวัสดี привет",), ("hello 你好",), ("при สวัส",)], "t string")
    assert [r.s for r in df.select(X.dominant_script(F.col("t")).alias("s")).collect()] == ["CYRILLIC", None, "CYRILLIC"]
    words = spark.createDataFrame([("▁hello",), ("你好",), ("привет",), ("12!",)], "t string")
    assert [r.a for r in words.select(X.allowed_by(F.col("t"), ["zh"]).alias("a")).collect()] == [False, True, False, True]


def test_worst_and_compare(spark):
    utts = score(spark, ("我好busy啊", ""), ("我好", "他壞"), ("我好busy啊", "我好busy"), ("我好忙啊", ""))
    assert [r.id for r in scoring.worst_utterances(utts, 3).collect()] == ["0", "3", "2"]
    runs = scoring.compare({"a": utts, "b": utts.where("id = '2'")}).orderBy("model").collect()
    assert [r.n_utts for r in runs] == [4, 1]


def test_scoring_stream(spark, tmp_path):
    from glossmill.streaming.live import score_stream, windowed_metrics

    rows = spark.createDataFrame([("1", "我好busy", "我好", "2024-01-01 00:00:01"), ("2", "好", "好", "2024-01-01 00:09:00")], "id string, ref string, hyp string, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    for name, df, mode in (("scored", score_stream(stream), "append"), ("windows", windowed_metrics(stream), "complete")):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).start()
        try:
            q.processAllAvailable()
        finally:
            q.stop()
    assert {r.id: r.mer for r in spark.table("scored").collect()} == {"1": pytest.approx(1 / 3), "2": 0.0}
    assert sorted(r.mer for r in spark.table("windows").collect()) == [0.0, pytest.approx(1 / 3)]


def test_token_distance_of_many_tokens(spark):
    # over 60,000 distinct tokens: codes go past the surrogates and the first plane
    df = spark.range(1).select(F.transform(F.sequence(F.lit(0), F.lit(69_999)), lambda i: F.concat(F.lit("t"), i.cast("string"))).alias("a"))
    got = df.select(token_distance(F.slice("a", 1, 60), F.slice("a", 31, 60)).alias("d"), token_distance(F.slice("a", 55_200, 300), F.concat(F.slice("a", 1, 55_199), F.slice("a", 55_201, 299))).alias("e")).first()
    assert got.d == 60 and got.e == 55_199


def test_a_few_rows_of_a_batch_are_python_values_at_a_time(spark):
    import pyarrow as pa

    from glossmill.functions import batches

    assert list(batches.slices([1] * 7, 3, 100)) == [(0, 3), (3, 3), (6, 1)]
    assert list(batches.slices([5, 50, 5, 5, 90], 9, 10)) == [(0, 1), (1, 1), (2, 2), (4, 1)] and list(batches.slices([], 9, 10)) == []
    column = pa.array([["a", "b"], [], None, ["ü"], ["c"]])
    assert batches.values(column.slice(3)) == [["ü"], ["c"]] and batches.values(column) == column.to_pylist() and batches.values(pa.array(["x", None])) == ["x", None]


def test_kernels_get_bounded_slices_of_arrow_batches(spark):
    import pyarrow as pa

    from glossmill.functions import batches

    rows = spark.range(2400, numPartitions=1).select(F.col("id").alias("_pos"), F.lit("我哋開meeting").alias("ref"), F.lit("我哋開會").alias("hyp"))

    def plain(frame):
        plan = frame._jdf.queryExecution().executedPlan().toString()
        # one Python node with Arrow's own arrays: a second one is a second worker, and pandas holds the whole batch as objects
        assert plan.count("+- ArrowEvalPython") == 1 and all(f.evalType == PythonEvalType.SQL_SCALAR_ARROW_UDF for f in (align.align_ops, align.score_ops, align.edit_spans))
        return frame.collect()

    spans = plain(inventory.edits(rows))
    assert len(spans) == 2400 and {r.pos for r in spans} == set(range(2400)) and {(r.kind, r.ref, r.hyp) for r in spans} == {("sub", "meeting", "會")}
    with_ops = rows.withColumn("ops", F.lit("EEES"))
    assert plain(inventory.edits(with_ops)) == spans
    sizes = []
    run = batches.arrow_function(lambda texts: sizes.append(len(texts)) or texts, StringType(), rows=10, weight=100).func
    assert run(pa.array(["x" * 60] * 5 + ["x"] * 95)).to_pylist() == ["x" * 60] * 5 + ["x"] * 95 and max(sizes) == 10 and sizes[:4] == [1, 1, 1, 1]


def test_a_filter_on_the_mixing_index_cuts_texts_into_tokens_once(spark):
    rows = spark.createDataFrame([(0, "我哋開meeting", "我哋開會"), (1, "", "x"), (2, None, None)], "id long, ref string, hyp string")
    used = scoring.score_utterances(rows).where(F.col("cmi_ref").isNotNull()).select("id", "cmi_ref")
    assert used._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") == 1
    assert {r.id: r.cmi_ref for r in used.collect()} == {0: 0.25, 1: 0.0, 2: 0.0}
