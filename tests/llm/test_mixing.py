import pytest
from pyspark.sql import functions as F

from glossmill.llm.mixing import budgets, mix, share_out


def test_share_out_gives_shortages_to_siblings():
    assert share_out(100, [1, 1, 2], [10, 100, 100]) == pytest.approx([10, 30, 60])
    assert share_out(100, [1, 1], [10, 20]) == [10, 20]
    assert share_out(10, [0, 1], [100, 100]) == [0, 10]
    assert share_out(10, [], []) == []


def test_shortage_stays_among_siblings_before_it_goes_up():
    supply = {("a", "x", "1"): 10, ("a", "x", "2"): 100, ("a", "y", "3"): 100, ("b", "x", "4"): 1000}
    out = budgets(supply, 100, {}, 1)
    assert sum(out.values()) == pytest.approx(100)
    assert out["b", "x", "4"] == pytest.approx(50)  # its share alone: a's own leaves made up the shortage
    assert out["a", "x", "1"] == pytest.approx(10) and out["a", "x", "2"] == pytest.approx(15)
    scarce = {("a", "x", "1"): 10, ("b", "x", "4"): 1000}
    assert budgets(scarce, 100, {}, 1)["b", "x", "4"] == pytest.approx(90)
    assert budgets(scarce, 100, {}, 4)["a", "x", "1"] == pytest.approx(40)


def brute(spark, docs, total_share, weights, most_epochs, seed):
    from glossmill.llm.mixing import LEVELS

    rows = [(r.doc_id, r.domain, r.lang, r.source, len((r.text or "").encode().split())) for r in docs.collect()]
    supply = {}
    for r in rows:
        supply[r[1:4]] = supply.get(r[1:4], 0) + r[4]
    parts = budgets(supply, total_share * sum(supply.values()), weights, most_epochs)
    out = []
    for leaf, tokens in parts.items():
        own = [r for r in rows if r[1:4] == leaf]
        whole = int((tokens + 1e-6) // supply[leaf]) if supply[leaf] else 0
        rest = int(tokens + 1e-6) - whole * supply[leaf] if supply[leaf] else 0
        ids = spark.createDataFrame([(r[0],) for r in own], "doc_id long").distinct()
        turn = {r.doc_id: r.t for r in ids.select("doc_id", F.pmod(F.xxhash64(F.lit(seed), F.lit(whole + 1).cast("long"), F.col("doc_id").cast("string")), F.lit(1 << 40)).alias("t")).collect()}
        total = {}
        for r in own:
            total[r[0]] = total.get(r[0], 0) + r[4]
        upto, taken = 0, set()
        for d in sorted(total, key=lambda d: (turn[d], d)):
            upto += total[d]
            if upto > rest:
                break
            taken.add(d)
        for r in own:
            if whole + (r[0] in taken):
                out.append((*r, whole + (r[0] in taken)))
    assert LEVELS == ("domain", "lang", "source")
    return sorted(out, key=str)


@pytest.mark.parametrize("total_share,rows_a_range,broadcast_leaves", [(0.5, 7, 100), (0.9, 3, 0), (2.5, 1000, 100), (0.0, 5, 100)])
def test_mix_equals_brute_force(spark, total_share, rows_a_range, broadcast_leaves):
    rows = [(i, "w " * (i * 37 % 41), "web" if i % 3 else "books", "en" if i % 4 else None, f"s{i % 5 % 3}", i) for i in range(300)]
    rows += [(7, "again and again", "web", "en", "s2", 0), (400, None, "web", "en", "s1", 0), (401, "", "tiny", "xx", "none", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, domain string, lang string, source string, n_tokens int")
    weights = {("web",): 1.0, ("books",): 3.0, ("web", "en"): 2.0}
    got = sorted((tuple(r) for r in mix(docs, total_share, weights, 3.0, 5, rows_a_range, broadcast_leaves).collect()), key=str)
    assert got == brute(spark, docs, total_share, weights, 3.0, 5)


def test_mix_of_nothing(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, domain string, lang string, source string")
    assert mix(docs, 0.5, {}).collect() == []
