"""Registered queries of the evaluation operators, over the code-mixing view or other driver tables, and their DuckDB oracles.

Floating-point sums are rounded, since their last bits depend on the order of addition.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import normalize as N
from ..functions import text as X
from ..functions.align import align_ops, edit_distance, token_distance
from ..operators import collapse, inventory, mislabel, pairs as P, scoring, splits
from ..operators.transcribe import EchoRecognizer, allowed_entries, transcribe
from .oracle_parts import ALIGNED, PAIRS, SCORED, SPANS, TOKENS
from .views import pairs, scored, utterances

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def registered(sql: str | None = None):
    def add(query):
        QUERIES[query.__name__] = query
        if sql:
            ORACLE_SQL[query.__name__] = sql
        return query

    return add


def _with(parts: str, body: str) -> str:
    return f"WITH RECURSIVE {parts.strip()}\n{body}"


def _metric_sql(select: str, tail: str = "", where: str = "true", cols: list[str] | None = None) -> str:
    rates = {
        "mer": "sum(subs + dels + ins) / nullif(sum(n_ref), 0)",
        "cer_zh": "sum(sub_zh + del_zh + ins_zh) / nullif(sum(ref_zh), 0)",
        "wer_en": "sum(sub_en + del_en + ins_en) / nullif(sum(ref_en), 0)",
        "pier": "sum(poi_err) / nullif(sum(n_poi), 0)",
        "sub_rate": "sum(subs) / nullif(sum(n_ref), 0)",
        "del_rate": "sum(dels) / nullif(sum(n_ref), 0)",
        "ins_rate": "sum(ins) / nullif(sum(n_ref), 0)",
        "en_omission_rate": "count(*) FILTER (WHERE en_omitted) / nullif(count(*) FILTER (WHERE ref_en > 0), 0)",
        "zh_omission_rate": "count(*) FILTER (WHERE zh_omitted) / nullif(count(*) FILTER (WHERE ref_zh > 0), 0)",
        "en_sub_by_zh_rate": "sum(en_sub_by_zh) / nullif(sum(ref_en), 0)",
        "en_lost_rate": "sum(en_lost) / nullif(sum(ref_en), 0)",
        "runaway_rate": "count(*) FILTER (WHERE n_ref > 0 AND length_ratio > 2.0) / nullif(count(*), 0)",
        "foreign_script_rate": "count(*) FILTER (WHERE foreign_script) / nullif(count(*), 0)",
        "hyp_foreign_token_rate": "sum(hyp_other) / nullif(sum(n_hyp), 0)",
        "switch_ratio": "sum(n_switch_hyp) / nullif(sum(n_switch_ref), 0)",
        "length_ratio": "sum(n_hyp) / nullif(sum(n_ref), 0)",
        "mean_cmi_ref": "sum(cmi_ref) / nullif(count(*), 0)",
    }
    counts = "count(*) AS n_utts, sum(n_ref)::BIGINT AS n_ref_tokens, sum(n_hyp)::BIGINT AS n_hyp_tokens, sum(hits)::BIGINT AS hits, sum(subs)::BIGINT AS subs, sum(dels)::BIGINT AS dels, sum(ins)::BIGINT AS ins"
    return f"SELECT {select}{counts}, " + ", ".join(f"round({v}, 9) AS {k}" for k, v in rates.items()) + f" FROM sc WHERE {where} {tail}"


METRIC_COLUMNS = ["n_utts", "n_ref_tokens", "n_hyp_tokens", "hits", "subs", "dels", "ins"]
RATE_COLUMNS = [r for r in scoring.RATES if r not in ("num_error_rate", "other_error_rate")]


def _shown(m: DataFrame, *keys: str) -> DataFrame:
    return m.select(*keys, *METRIC_COLUMNS, *[F.round(c, 9).alias(c) for c in RATE_COLUMNS])


@registered(_with(TOKENS, "SELECT id, len(r) AS n_tokens, zh, en, len(list_filter(rl, lambda x: x = 'num')) AS num, len(list_filter(rl, lambda x: x = 'other')) AS other, array_to_string(r, ' ') AS tokens FROM tok"))
def tokenize_lang_counts(spark, sf_dir):
    """Tokens of every utterance and their languages."""
    u = utterances(spark, sf_dir).withColumn("t", X.tokens(F.col("ref"))).withColumn("l", X.token_langs(F.col("t")))
    return u.select("id", F.size("t").cast("long").alias("n_tokens"), *[X.count_lang(F.col("l"), x).cast("long").alias(x) for x in X.LANGS], F.array_join("t", " ").alias("tokens"))


@registered(_with(TOKENS, "SELECT id, round(CASE WHEN zh + en > 0 THEN least(zh, en) / (zh + en) ELSE 0.0 END, 9) AS cmi FROM tok"))
def code_mixing_index(spark, sf_dir):
    u = utterances(spark, sf_dir)
    return u.select("id", F.round(X.code_mixing_index(X.token_langs(X.tokens(F.col("ref")))), 9).alias("cmi"))


@registered(_with(TOKENS, "SELECT id, array_to_string(rs, ',') AS points, array_to_string(poi, ',') AS poi, len(rs) AS n_points, len(poi) AS n_poi FROM tok"))
def switch_points(spark, sf_dir):
    """Switch points and points of interest of every utterance."""
    t = scoring.tokenize_pairs(pairs(spark, sf_dir)).withColumn("s", X.switch_points(F.col("ref_langs")))
    text = lambda c: F.array_join(F.col(c).cast("array<string>"), ",")
    return t.select("id", text("s").alias("points"), text("poi").alias("poi"), F.size("s").cast("long").alias("n_points"), F.size("poi").cast("long").alias("n_poi"))


_JOIN_SQL = """
WITH h AS (SELECT conv_id, arg_max(text, turn) AS hyp FROM conversations WHERE role <> 'system' GROUP BY conv_id)
SELECT d.doc_id AS id, coalesce(d.text, '') AS ref, coalesce(h.hyp, '') AS hyp, h.conv_id IS NULL AS missing FROM documents d LEFT JOIN h ON h.conv_id = d.doc_id
"""


@registered(_JOIN_SQL)
def ref_hyp_left_join(spark, sf_dir):
    """Documents as references, conversation turns as hypotheses: the last turn of an id wins, gaps stay empty."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("_pos"), F.col("doc_id").alias("id"), "text")
    hyps = spark.read.parquet(f"{sf_dir}/conversations.parquet").where("role <> 'system'").select(F.col("turn").alias("_pos"), F.col("conv_id").alias("id"), F.col("text").alias("hyp"))
    return P.join_hypotheses(docs, hyps).select(F.col("id").cast("long").alias("id"), "ref", "hyp", "missing")


@registered("SELECT conv_id AS id, count(*) AS n, min(turn) AS first_pos FROM conversations GROUP BY conv_id HAVING count(*) > 1")
def duplicate_ids(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(F.col("conv_id").alias("id"), F.col("turn").alias("_pos"))
    return P.duplicate_ids(c)


@registered("SELECT count(*) FILTER (WHERE text LIKE '%###%') AS n_failed, split_part(arg_min(text, doc_id) FILTER (WHERE text LIKE '%###%'), chr(10), 1) AS first_error FROM documents")
def failed_transcriptions(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return P.failed_transcriptions(d.select(F.col("doc_id").alias("_pos"), F.when(F.col("text").contains("###"), F.col("text")).alias("error")))


@registered(_with(ALIGNED, "SELECT id, ops FROM al"))
def align_op_strings(spark, sf_dir):
    t = scoring.tokenize_pairs(pairs(spark, sf_dir))
    return t.select("id", align_ops("ref_tokens", "hyp_tokens").alias("ops"))


@registered(_with(ALIGNED, "SELECT id, len(replace(ops, 'E', '')) AS distance, len(replace(ops, 'E', '')) AS native_distance FROM al"))
def edit_distances(spark, sf_dir):
    """Edit distances from alignments, and without Python."""
    t = scoring.tokenize_pairs(pairs(spark, sf_dir))
    return t.select("id", edit_distance(align_ops("ref_tokens", "hyp_tokens")).cast("long").alias("distance"), token_distance(F.col("ref_tokens"), F.col("hyp_tokens")).cast("long").alias("native_distance"))


_UTT = ["n_ref", "n_hyp", "hits", "subs", "dels", "ins", "n_poi", "poi_err", "n_switch_ref", "n_switch_hyp", "en_sub_by_zh", "en_lost"]
_UTT_LANGS = [f"{k}_{x}" for k in ("ref", "hyp", "sub", "del", "ins") for x in X.LANGS]


@registered(_with(SCORED, f"SELECT id, {', '.join(f'{c}::BIGINT AS {c}' for c in _UTT + _UTT_LANGS)}, en_omitted, zh_omitted, foreign_script, round(length_ratio, 9) AS length_ratio, round(mer, 9) AS mer, round(cmi_ref, 9) AS cmi_ref FROM sc"))
def utterance_scores(spark, sf_dir):
    s = scored(spark, sf_dir)
    langs = [F.col(f"lang_{c.partition('_')[0]}.{c.partition('_')[2]}").cast("long").alias(c) for c in _UTT_LANGS]
    return s.select("id", *[F.col(c).cast("long").alias(c) for c in _UTT], *langs, "en_omitted", "zh_omitted", "foreign_script", *[F.round(c, 9).alias(c) for c in ("length_ratio", "mer", "cmi_ref")])


@registered(_with(SCORED, _metric_sql("")))
def corpus_metrics(spark, sf_dir):
    return _shown(scoring.corpus_metrics(scored(spark, sf_dir)))


@registered(_with(SCORED, _metric_sql("", where="NOT foreign_script AND length_ratio <= 2.0")))
def corpus_metrics_clean(spark, sf_dir):
    return _shown(scoring.corpus_metrics_clean(scored(spark, sf_dir)))


@registered(_with(SCORED, _metric_sql("role, ", "GROUP BY role")))
def metrics_by_group(spark, sf_dir):
    return _shown(scoring.corpus_metrics(scored(spark, sf_dir), ["role"]), "role")


@registered(_with(SCORED, _metric_sql("'run' || k AS model, ", "GROUP BY k")))
def compare_runs(spark, sf_dir):
    """The hypothesis classes as runs, side by side."""
    s = scored(spark, sf_dir).withColumn("model", F.concat(F.lit("run"), F.col("k").cast("string")))
    return _shown(scoring.corpus_metrics(s, ["model"]), "model")


_FINDINGS = (
    "WITH m AS (SELECT * FROM met) SELECT model, CASE WHEN n_ref_tokens > 0 AND n_hyp_tokens = 0 THEN 'no_output' ELSE concat_ws(',', "
    "CASE WHEN length_ratio > 0 AND length_ratio < 0.2 THEN 'short_output' END, CASE WHEN foreign_script_rate > 0 THEN 'foreign_script' END, "
    "CASE WHEN runaway_rate > 0.05 AND NOT coalesce(foreign_script_rate, 0) > 0 THEN 'runaway' END, CASE WHEN ins_rate > 0.3 AND coalesce(runaway_rate, 0) <= 0.05 THEN 'insertions' END, "
    "CASE WHEN cer_zh > 0.45 AND subs > ins AND subs > dels THEN 'script_mismatch' END, CASE WHEN en_omission_rate > 0.1 THEN 'english_omitted' END, "
    "CASE WHEN en_sub_by_zh_rate > 0.15 THEN 'translated' END, CASE WHEN switch_ratio < 0.6 THEN 'flattened' END, CASE WHEN pier > mer * 1.3 THEN 'switch_errors' END, "
    "CASE WHEN mer > 1 AND NOT coalesce(foreign_script_rate, 0) > 0 THEN 'errors_outnumber_tokens' END) END AS findings FROM m"
)


@registered(_with(SCORED + ",\nmet AS (" + _metric_sql("'run' || k AS model, ", "GROUP BY k") + ")", _FINDINGS.replace("WITH m AS (SELECT * FROM met) ", "").replace("FROM m", "FROM met")))
def diagnose_codes(spark, sf_dir):
    s = scored(spark, sf_dir).withColumn("model", F.concat(F.lit("run"), F.col("k").cast("string")))
    return scoring.diagnosis(scoring.corpus_metrics(s, ["model"])).select("model", F.array_join("findings", ",").alias("findings"))


@registered(_with(SCORED, "SELECT id, round(mer, 9) AS mer, subs, dels, ins FROM sc WHERE n_ref >= 3 ORDER BY sc.mer DESC, id LIMIT 20"))
def worst_k(spark, sf_dir):
    w = scoring.worst_utterances(scored(spark, sf_dir))
    return w.select("id", F.round("mer", 9).alias("mer"), *[F.col(c).cast("long").alias(c) for c in ("subs", "dels", "ins")])


def _spans(spark, sf_dir):
    return inventory.edits(pairs(spark, sf_dir))


def _dashed(df):
    return df.withColumns({c: F.coalesce(c, F.lit("-")) for c in ("ref_lang", "hyp_lang")})


@registered(_with(SPANS, "SELECT kind, ref_lang, hyp_lang, ref, hyp, count(*) AS count, count(*) FILTER (WHERE is_poi) AS poi_count FROM spn GROUP BY ALL"))
def error_inventory(spark, sf_dir):
    """Every edit of the corpus with its counts, all and at switch points."""
    return _dashed(inventory.inventory(_spans(spark, sf_dir))).drop("first_seen")


@registered(_with(SPANS, "SELECT ref, hyp, count(*) AS count FROM spn WHERE kind = 'sub' AND ref_lang = 'en' AND hyp_lang = 'zh' GROUP BY ref, hyp ORDER BY count(*) DESC, min((id, t0)) LIMIT 30"))
def sub_pairs_topk(spark, sf_dir):
    table = inventory.inventory(_spans(spark, sf_dir)).where("kind = 'sub' and ref_lang = 'en' and hyp_lang = 'zh'")
    return inventory.top(table, 30).select("ref", "hyp", "count")


@registered(_with(SPANS, "SELECT ref, hyp, ref_lang, hyp_lang, count(*) AS poi_count FROM spn WHERE kind = 'sub' AND is_poi GROUP BY ALL HAVING count(*) >= 2"))
def poi_sub_pairs(spark, sf_dir):
    table = inventory.inventory(_spans(spark, sf_dir)).where("kind = 'sub' and poi_count >= 2")
    return table.select("ref", "hyp", "ref_lang", "hyp_lang", "poi_count")


@registered(_with(ALIGNED, "SELECT rt AS token, count(*) AS count FROM oo WHERE op IN ('S', 'D') AND rtl = 'en' GROUP BY rt ORDER BY count(*) DESC, min((id, t)) LIMIT 30"))
def lost_tokens_topk(spark, sf_dir):
    return inventory.top(inventory.lost_tokens(_spans(spark, sf_dir)), 30).select("token", "count")


@registered(_with(ALIGNED, "SELECT token, count FROM (SELECT rt AS token, count(*) AS count FROM oo WHERE op IN ('S', 'D') AND rtl = 'en' GROUP BY rt ORDER BY count(*) DESC, min((id, t)) LIMIT 30) WHERE count >= 40"))
def frequent_lost_tokens(spark, sf_dir):
    """The minimum applies to what the limit leaves."""
    return inventory.top(inventory.lost_tokens(_spans(spark, sf_dir)), 30, 40).select("token", "count")


@registered(_with(SPANS, "SELECT ref_lang, hyp_lang, sum(c)::BIGINT AS total, count(*) AS distinct_pairs FROM (SELECT ref_lang, hyp_lang, ref, hyp, count(*) AS c FROM spn WHERE kind = 'sub' GROUP BY ALL) GROUP BY ref_lang, hyp_lang"))
def inventory_totals(spark, sf_dir):
    return inventory.directions(inventory.inventory(_spans(spark, sf_dir)))


@registered(_with(SPANS, "SELECT ref, hyp, count(*) AS count FROM spn WHERE kind = 'sub' AND ref_lang = 'zh' AND hyp_lang = 'zh' AND length(ref) = 1 AND length(hyp) = 1 GROUP BY ref, hyp"))
def orthographic_variants(spark, sf_dir):
    table = inventory.inventory(_spans(spark, sf_dir)).where("kind = 'sub' and ref_lang = 'zh' and hyp_lang = 'zh'")
    return table.where(P.orthographic_variant(F.col("ref"), F.col("hyp"))).select("ref", "hyp", "count")


def _found(spark, sf_dir):
    return mislabel.misalignments(pairs(spark, sf_dir), part=["conv_id"])


# Distances on anti-diagonals for pairs of a hypothesis and a neighbour's reference.
_BAND = TOKENS + """,
bd0 AS (SELECT a.conv_id, a."index", b."index" AS j, a.id, b.id AS bid, b.r, a.h, len(b.r) AS nr FROM tok a JOIN tok b ON a.conv_id = b.conv_id AND abs(a."index" - b."index") <= 5 WHERE len(a.h) > 0 AND len(b.r) > 0 AND len(a.r) > 0),
dp AS (SELECT id, j, r, h, len(r) n, len(h) m, 0 kd, [CASE WHEN i = 0 THEN 0 ELSE NULL END for i in range(0, len(r) + 1)] p1, [CAST(NULL AS INT) for i in range(0, len(r) + 1)] p2 FROM bd0 WHERE "index" = j
 UNION ALL SELECT id, j, r, h, n, m, kd + 1, [CASE WHEN kd + 1 - i < 0 OR kd + 1 - i > m THEN NULL WHEN i = 0 OR i = kd + 1 THEN kd + 1
   ELSE least(p2[i] + (CASE WHEN r[i] = h[kd + 1 - i] THEN 0 ELSE 1 END), p1[i] + 1, p1[i + 1] + 1) END for i in range(0, n + 1)], p1 FROM dp WHERE kd < n + m),
own AS (SELECT id, p1[n + 1] / n AS own_mer FROM dp WHERE kd = n + m),
bd AS (SELECT bd0.*, own_mer FROM bd0 JOIN own USING (id) WHERE own_mer >= 0.5 AND "index" <> j),
dq AS (SELECT id, j, r, h, len(r) n, len(h) m, 0 kd, [CASE WHEN i = 0 THEN 0 ELSE NULL END for i in range(0, len(r) + 1)] p1, [CAST(NULL AS INT) for i in range(0, len(r) + 1)] p2 FROM bd
 UNION ALL SELECT id, j, r, h, n, m, kd + 1, [CASE WHEN kd + 1 - i < 0 OR kd + 1 - i > m THEN NULL WHEN i = 0 OR i = kd + 1 THEN kd + 1
   ELSE least(p2[i] + (CASE WHEN r[i] = h[kd + 1 - i] THEN 0 ELSE 1 END), p1[i] + 1, p1[i + 1] + 1) END for i in range(0, n + 1)], p1 FROM dq WHERE kd < n + m),
cand AS (SELECT bd.conv_id, bd.id, bd."index", bd.bid AS best_id, j AS best_index, own_mer, p1[n + 1] / n AS best_mer FROM dq JOIN bd USING (id, j) WHERE kd = n + m),
best AS (SELECT * FROM cand QUALIFY row_number() OVER (PARTITION BY id ORDER BY best_mer, best_index) = 1),
mis AS (SELECT * FROM best WHERE best_mer < own_mer AND best_mer <= 0.5 AND best_mer <= own_mer * 0.5),
mut AS (SELECT a.* FROM mis a JOIN mis b ON a.conv_id = b.conv_id AND a.best_index = b."index" AND b.best_index = a."index")"""


@registered(_with(_BAND, "SELECT id, best_id, round(own_mer, 9) AS own_mer, round(best_mer, 9) AS best_mer, round(own_mer - best_mer, 9) AS improvement, id IN (SELECT id FROM mut) AS mutual FROM mis"))
def mislabel_band(spark, sf_dir):
    f = mislabel.with_mutual(_found(spark, sf_dir), ["conv_id"])
    return f.select("id", "best_id", *[F.round(c, 9).alias(c) for c in ("own_mer", "best_mer", "improvement")], "mutual")


@registered(_with(_BAND, 'SELECT id, best_id FROM mut WHERE "index" < best_index'))
def mutual_pairs(spark, sf_dir):
    return mislabel.mutual_pairs(_found(spark, sf_dir), ["conv_id"]).select("id", "best_id")


@registered(_with(_BAND, "SELECT id, best_id, round(own_mer - best_mer, 9) AS improvement FROM mis WHERE id NOT IN (SELECT id FROM mut)"))
def one_way_matches(spark, sf_dir):
    return mislabel.one_way(_found(spark, sf_dir), ["conv_id"]).select("id", "best_id", F.round("improvement", 9).alias("improvement"))


@registered(_with(_BAND, "SELECT round((SELECT coalesce(sum((own_mer - best_mer) * len(tok.r)), 0) FROM mis JOIN tok USING (id)) / (SELECT sum(len(r)) FROM tok), 9) AS mer_impact"))
def mer_impact(spark, sf_dir):
    p = pairs(spark, sf_dir)
    return mislabel.mer_impact(p, _found(spark, sf_dir)).select(F.round("mer_impact", 9).alias("mer_impact"))


def _sources(spark, sf_dir):
    """Documents as rows of speakers (source) and topics (lang)."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return d.select("doc_id", F.translate(F.lower("text"), "kwxyzjqv", "今日我好你係開會").alias("text"), F.col("lang").alias("topic"), F.regexp_extract("source", r"(\d+)$", 1).cast("int").alias("folder"), F.col("source").alias("speaker"))


_FOLDERS = """
fs AS (SELECT doc_id, text, lang AS topic, regexp_extract(source, '(\\d+)$', 1)::INT AS folder, source AS speaker FROM documents),
ft AS (SELECT folder, list_sort(list(DISTINCT topic)) AS signature, count(*) AS n FROM fs GROUP BY folder),
fr AS (SELECT *, row_number() OVER (ORDER BY folder) AS rk, count(*) OVER () AS total, row_number() OVER (PARTITION BY signature ORDER BY folder) AS srk, count(*) OVER (PARTITION BY signature) AS stotal FROM ft),
fp AS (SELECT *, CASE WHEN rk <= greatest(1, round_even(total * 0.7, 0)) THEN 'train' ELSE 'test' END AS split FROM fr),
fz AS (SELECT *, CASE WHEN srk <= CASE WHEN stotal > 1 THEN greatest(1, round_even(stotal * 0.7, 0)) ELSE stotal END THEN 'train' ELSE 'test' END AS split FROM fr)"""


@registered(f"WITH {_FOLDERS} SELECT folder, n, split FROM fp")
def split_positional(spark, sf_dir):
    return splits.positional_split(splits.folder_table(_sources(spark, sf_dir))).select("folder", "n", "split")


@registered(f"WITH {_FOLDERS} SELECT folder, array_to_string(signature, ',') AS signature, split FROM fz")
def split_stratified(spark, sf_dir):
    return splits.stratified_split(splits.folder_table(_sources(spark, sf_dir))).select("folder", F.array_join("signature", ",").alias("signature"), "split")


@registered(f"WITH {_FOLDERS}, tr AS (SELECT folder, row_number() OVER (ORDER BY folder) AS r2, count(*) OVER () AS t2 FROM fp WHERE split = 'train') SELECT fp.folder, CASE WHEN fp.split = 'test' THEN 'test' WHEN r2 <= greatest(1, round_even(t2 * 0.8, 0)) THEN 'train' ELSE 'dev' END AS split FROM fp LEFT JOIN tr USING (folder)")
def dev_carve(spark, sf_dir):
    split = splits.positional_split(splits.folder_table(_sources(spark, sf_dir)))
    return splits.carve_dev(split, 0.2).select("folder", "split")


def _split_rows(spark, sf_dir):
    rows = _sources(spark, sf_dir)
    return splits.split_rows(rows, splits.positional_split(splits.folder_table(rows)))


_DOC_TOKENS = f"""
dt AS (SELECT fp.split, fs.topic, fs.speaker, regexp_extract_all(translate(lower(text), 'kwxyzjqv', '今日我好你係開會'), '{X.TOKEN.replace("'", "''")}', 1) AS toks FROM fs JOIN fp USING (folder)),
dc AS (SELECT split, topic, speaker, len(list_filter(toks, lambda x: regexp_matches(x, '^[{X.CJK}]'))) AS zh, len(list_filter(toks, lambda x: regexp_matches(x, '^[{X.LATIN}]'))) AS en FROM dt),
dm AS (SELECT *, CASE WHEN zh + en > 0 THEN least(zh, en) / (zh + en) ELSE 0.0 END AS cmi FROM dc)"""


@registered(f"WITH {_FOLDERS}, {_DOC_TOKENS} SELECT split, count(*) AS n, round(avg(cmi), 9) AS mean_cmi, round(sum(en) / nullif(sum(zh) + sum(en), 0), 9) AS en_share FROM dm GROUP BY split")
def split_profile(spark, sf_dir):
    p = splits.split_profile(_split_rows(spark, sf_dir))
    return p.select("split", "n", F.round("mean_cmi", 9).alias("mean_cmi"), F.round("en_share", 9).alias("en_share"))


@registered(f"WITH {_FOLDERS}, {_DOC_TOKENS} SELECT split, count(*) AS utterances, count(DISTINCT speaker) AS speakers, sum(zh)::BIGINT AS zh_tokens, sum(en)::BIGINT AS en_tokens, round(avg((en > 0)::INT), 9) AS share_with_english, round(avg(cmi), 9) AS mean_cmi FROM dm GROUP BY split")
def split_summary(spark, sf_dir):
    s = splits.split_summary(_split_rows(spark, sf_dir))
    return s.withColumns({c: F.round(c, 9) for c in ("share_with_english", "mean_cmi")})


@registered(
    f"WITH {_FOLDERS}, x AS (SELECT CASE WHEN topic IN ('en', 'fr') THEN 'train' ELSE 'test' END AS split, topic, count(*) AS c FROM fs WHERE topic <> 'de' OR folder > 4 GROUP BY ALL), "
    "y AS (SELECT split, topic, c / sum(c) OVER (PARTITION BY split) AS share FROM x), z AS (SELECT coalesce(a.topic, b.topic) AS topic, coalesce(a.share, 0) AS l, coalesce(b.share, 0) AS r FROM (SELECT * FROM y WHERE split = 'train') a FULL JOIN (SELECT * FROM y WHERE split = 'test') b USING (topic)) "
    "SELECT topic, round(l, 9) AS left_share, round(r, 9) AS right_share, CASE WHEN l >= 0.05 AND r < 0.01 THEN 'test' ELSE 'train' END AS missing_from FROM z WHERE (l >= 0.05 AND r < 0.01) OR (r >= 0.05 AND l < 0.01)"
)
def topic_coverage_gap(spark, sf_dir):
    """A split along topics, as collection batches would make it, and the gaps it has."""
    rows = _sources(spark, sf_dir).where("topic <> 'de' or folder > 4").withColumn("split", F.when(F.col("topic").isin("en", "fr"), "train").otherwise("test"))
    return splits.topic_gaps(rows).select("topic", F.round("left_share", 9).alias("left_share"), F.round("right_share", 9).alias("right_share"), "missing_from")


def _bins_sql(key: str, bins: int, part: str, order: str, source: str, name: str) -> str:
    over = f"PARTITION BY {part} " if part else ""
    return (
        f"(SELECT * EXCLUDE (rr, nn, bb), bb AS {name} FROM (SELECT *, row_number() OVER ({over}ORDER BY {key}, {order}) - 1 AS rr, count(*) OVER ({over}) AS nn FROM {source}) "
        f"JOIN (SELECT unnest(range(0, {bins})) AS bb) ON rr >= floor(bb * (nn::DOUBLE / {bins})) AND rr < floor((bb + 1) * (nn::DOUBLE / {bins})))"
    )


_DOSE = _with(SCORED, f"SELECT bin, round(min(cmi_ref), 9) AS lo, round(max(cmi_ref), 9) AS hi, count(*) AS n, count(*) FILTER (WHERE foreign_script) AS collapsed FROM {_bins_sql('cmi_ref', 10, '', 'id', 'sc', 'bin')} GROUP BY bin")


@registered(_DOSE)
def dose_response(spark, sf_dir):
    d = collapse.dose_response(scored(spark, sf_dir))
    return d.select(F.col("bin").cast("long").alias("bin"), F.round("lo", 9).alias("lo"), F.round("hi", 9).alias("hi"), "n", "collapsed")


_GRID_SRC = "(SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY n_ref, id) AS o FROM " + _bins_sql("n_ref", 3, "", "id", "(SELECT * FROM sc WHERE n_ref > 0)", "stratum") + ")"


@registered(_with(SCORED + f",\nband AS (SELECT * FROM {_GRID_SRC})", f"SELECT g.stratum, g.cell, count(*) AS n, count(*) FILTER (WHERE foreign_script) AS collapsed, any_value(q.a) AS min_ref, any_value(q.z) AS max_ref FROM {_bins_sql('cmi_ref', 3, 'stratum', 'o', 'band', 'cell')} g JOIN (SELECT stratum, min(n_ref) AS a, max(n_ref) AS z FROM band GROUP BY stratum) q USING (stratum) GROUP BY ALL"))
def length_cmi_grid(spark, sf_dir):
    g = collapse.length_cmi_grid(scored(spark, sf_dir))
    return g.select(*[F.col(c).cast("long").alias(c) for c in ("stratum", "cell", "n", "collapsed", "min_ref", "max_ref")])


@registered(_with(SCORED, f"SELECT arg_min(lo, bin) FILTER (WHERE c > 0) AS onset, coalesce(max(c / n) FILTER (WHERE bin = 9), 0.0) AS top_rate FROM (SELECT bin, round(min(cmi_ref), 9) AS lo, count(*) AS n, count(*) FILTER (WHERE foreign_script) AS c FROM {_bins_sql('cmi_ref', 10, '', 'id', 'sc', 'bin')} GROUP BY bin)"))
def collapse_onset(spark, sf_dir):
    return collapse.onset(scored(spark, sf_dir)).select(F.round("onset", 9).alias("onset"), "top_rate")


@registered(_with(SCORED, "SELECT conv_id, count(*) AS total, count(*) FILTER (WHERE foreign_script) AS collapsed, round(count(*) FILTER (WHERE foreign_script) / count(*), 9) AS rate FROM sc GROUP BY conv_id HAVING count(*) FILTER (WHERE foreign_script) > 0"))
def concentration(spark, sf_dir):
    return collapse.concentration(scored(spark, sf_dir), "conv_id").withColumn("rate", F.round("rate", 9))


@registered(_with(SCORED, "SELECT count(*) AS groups, sum(c)::BIGINT AS collapsed, (SELECT sum(c) FROM (SELECT c FROM g ORDER BY c DESC, conv_id LIMIT 8))::BIGINT AS covered, round((SELECT sum(c) FROM (SELECT c FROM g ORDER BY c DESC, conv_id LIMIT 8)) / sum(c), 9) AS share FROM g").replace("SELECT count(*) AS groups", ", g AS (SELECT conv_id, count(*) FILTER (WHERE foreign_script) AS c FROM sc GROUP BY conv_id HAVING count(*) FILTER (WHERE foreign_script) > 0) SELECT count(*) AS groups", 1))
def top_share(spark, sf_dir):
    return collapse.top_share(collapse.concentration(scored(spark, sf_dir), "conv_id"), "conv_id").withColumn("share", F.round("share", 9))


@registered(_with(SCORED, "SELECT foreign_script, count(*) AS n, round(avg(cmi_ref), 9) AS mean_cmi, round(avg(ref_en), 9) AS mean_en, round(avg(ref_zh), 9) AS mean_zh, round(avg(n_ref), 9) AS mean_len FROM sc GROUP BY foreign_script"))
def group_means(spark, sf_dir):
    m = collapse.group_means(scored(spark, sf_dir))
    return m.withColumns({c: F.round(c, 9) for c in ("mean_cmi", "mean_en", "mean_zh", "mean_len")})


@registered(_with(TOKENS, "SELECT id, len(h) >= 5 AND len(list_filter(hl, lambda x: x = 'other')) / len(h) > 0.30 AS foreign_script, CASE WHEN length(regexp_replace(regexp_replace(hyp, '\\p{M}', '', 'g'), '\\p{Thai}', '', 'g')) < length(regexp_replace(hyp, '\\p{M}', '', 'g')) THEN 'THAI' END AS script FROM tok"))
def foreign_script_flag(spark, sf_dir):
    t = scoring.tokenize_pairs(pairs(spark, sf_dir))
    other = X.count_lang(F.col("hyp_langs"), X.OTHER)
    return t.select("id", X.foreign_script(F.size("hyp_tokens"), other).alias("foreign_script"), X.dominant_script(F.col("hyp")).alias("script"))


@registered(_with(SCORED, f"SELECT 'run' || k AS model, count(*) AS n, count(*) FILTER (WHERE foreign_script) AS collapsed, round(count(*) FILTER (WHERE foreign_script) / count(*), 9) AS rate, any_value(q.onset) AS onset, any_value(q.top_rate) AS top_rate, CASE WHEN count(*) FILTER (WHERE foreign_script AND regexp_matches(hyp, '\\p{{Thai}}')) > 0 THEN 'THAI' ELSE '-' END AS attractor, coalesce(round(count(*) FILTER (WHERE foreign_script AND regexp_matches(hyp, '\\p{{Thai}}')) / nullif(count(*) FILTER (WHERE foreign_script), 0), 9), 0.0) AS attractor_share FROM sc LEFT JOIN (SELECT k, arg_min(lo, bin) FILTER (WHERE c > 0) AS onset, coalesce(max(c / n) FILTER (WHERE bin = 9), 0.0) AS top_rate FROM (SELECT k, bin, round(min(cmi_ref), 9) AS lo, count(*) AS n, count(*) FILTER (WHERE foreign_script) AS c FROM {_bins_sql('cmi_ref', 10, 'k', 'id', 'sc', 'bin')} GROUP BY k, bin) GROUP BY k) q USING (k) GROUP BY k"))
def collapse_by_run(spark, sf_dir):
    s = scored(spark, sf_dir).withColumn("model", F.concat(F.lit("run"), F.col("k").cast("string")))
    return collapse.summarise_runs(s).withColumns({c: F.round(c, 9) for c in ("rate", "onset", "attractor_share")})


_NORM_SQL = r"""
WITH a AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '<\|[^|]*\|>', ' ', 'g') AS t FROM documents),
b AS (SELECT doc_id, regexp_replace(t, '<\s*(?:unk|UNK|noise|NOISE|sil|SIL)\s*>', ' ', 'g') AS t FROM a),
c AS (SELECT doc_id, lower(regexp_replace(t, '[\[(（【][^\])）】]{0,32}[\])）】]', ' ', 'g')) AS t FROM b),
d AS (SELECT doc_id, translate(t, chr(39) || '’-‐‑–', '') AS t FROM c),
e AS (SELECT doc_id, translate(t, '@FROM@', '@TO@') AS t FROM d)
SELECT doc_id, trim(regexp_replace(t, '[@WHITE@]+', ' ', 'g'), ' ') AS text FROM e
""".replace("@FROM@", N.TO_SPACE.replace("'", "''")).replace("@TO@", " " * len(N.TO_SPACE)).replace("@WHITE@", X.WHITE)


@registered(_NORM_SQL)
def normalize_basic(spark, sf_dir):
    """The normaliser without compatibility forms, which the oracle lacks."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return d.select("doc_id", N.normalize(F.col("text"), N.NormalizeConfig(script=None, to_halfwidth=False)).alias("text"))


@registered()
def normalize_full(spark, sf_dir):
    """The normaliser with everything on but script conversion."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return d.select("doc_id", N.normalize(F.col("text"), N.NormalizeConfig(script=None, strip_accents=True, normalize_numbers=True)).alias("text"))


@registered("SELECT doc_id, regexp_replace(coalesce(source, '') || ' ' || lang || '/' || doc_id, '[^\\p{L}\\p{N}_-]', '_', 'g') AS slug, regexp_extract(doc_id || '_ABC_' || lang, '^(\\d+)_[A-Za-z]', 1) AS speaker FROM documents")
def slugs_and_speakers(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return d.select("doc_id", X.slug(F.concat(F.coalesce("source", F.lit("")), F.lit(" "), "lang", F.lit("/"), F.col("doc_id").cast("string"))).alias("slug"), X.speaker_of(F.concat(F.col("doc_id").cast("string"), F.lit("_ABC_"), "lang")).alias("speaker"))


@registered()
def permutation_test(spark, sf_dir):
    return collapse.permutation_test(scored(spark, sf_dir))


@registered("SELECT page_id AS id, regexp_replace(regexp_extract(rtrim(url, '/'), '([^/]*)$', 1), '(.)\\.[^.]+$', '\\1') AS hyp, NULL::VARCHAR AS error FROM pages")
def transcribe_dummy(spark, sf_dir):
    """A recogniser that says the stem of a path, over the urls of pages."""
    p = spark.read.parquet(f"{sf_dir}/pages.parquet").select(F.col("page_id").alias("_pos"), F.col("page_id").cast("string").alias("id"), F.rtrim("url", F.lit("/")).alias("audio"))
    return transcribe(p, EchoRecognizer).select(F.col("id").cast("long").alias("id"), "hyp", "error")


@registered("SELECT min(doc_id) AS token_id, lang || ' ' || source AS token FROM documents GROUP BY lang, source")
def allowed_vocabulary(spark, sf_dir):
    """Vocabulary entries that the zh+en constraint lets through."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    v = d.groupBy(F.concat_ws(" ", "lang", "source").alias("token")).agg(F.min("doc_id").alias("token_id"))
    thai = v.select(F.translate("token", "aeios", "กขคงจ").alias("token"), "token_id")
    return allowed_entries(v.unionByName(thai).withColumn("special", F.lit(False)), "zh+en").select("token_id", "token")


@registered("SELECT doc_id, strip_accents(text) AS text FROM documents")
def accents_stripped(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", N.strip_accents("text").alias("text"))


@registered("SELECT page_id AS id, CASE WHEN url LIKE '%casino%' THEN '' ELSE regexp_replace(regexp_extract(rtrim(url, '/'), '([^/]*)$', 1), '(.)\\.[^.]+$', '\\1') END AS hyp, CASE WHEN url LIKE '%casino%' THEN 'cannot read ' || rtrim(url, '/') END AS error FROM pages")
def failed_batches(spark, sf_dir):
    """A recogniser that fails on some paths: empty hypotheses with the error, and the run goes on."""
    p = spark.read.parquet(f"{sf_dir}/pages.parquet").select(F.col("page_id").alias("_pos"), F.col("page_id").cast("string").alias("id"), F.rtrim("url", F.lit("/")).alias("audio"))
    return transcribe(p, lambda: EchoRecognizer(fail_on="casino", max_failure_rate=1.0)).select(F.col("id").cast("long").alias("id"), "hyp", "error")


@registered(_with(SCORED, _metric_sql("'all' AS model, ") + " UNION ALL " + _metric_sql("'even' AS model, ", where="id % 2 = 0")))
def union_of_runs(spark, sf_dir):
    """Runs of unequal rows and columns side by side."""
    every = scored(spark, sf_dir)
    runs = {"all": every.drop("index"), "even": every.where("id % 2 = 0").withColumn("extra", F.lit(1))}
    return _shown(scoring.compare(runs), "model")
