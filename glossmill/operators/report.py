"""Text and markdown of small results: rendering on the driver."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from . import collapse, inventory, mislabel

#: What each finding means.
MEANINGS = {
    "no_output": "every hypothesis is empty: a broken run, not a recognition result; check the transcription step",
    "short_output": "hypotheses are under a fifth of the reference length; count the empty ones from failed decodes first",
    "foreign_script": "utterances came back in a third script: language identification failed; MER, PIER and insertions follow from it",
    "runaway": "many hypotheses are far longer than their references: the decoder repeats or collapses",
    "insertions": "insertions are high without runaway outputs; look for decoder tags or punctuation that normalisation left",
    "script_mismatch": "zh errors are mostly substitutions: Traditional against Simplified? unify the scripts",
    "english_omitted": "utterances with English came back without any",
    "translated": "English tokens were replaced by Chinese: translation instead of transcription",
    "flattened": "few of the expected switches were produced",
    "switch_errors": "errors gather at the switch points",
    "errors_outnumber_tokens": "more errors than reference tokens: suspect the scoring before the model",
}


def pct(value: float | None, digits: int = 2) -> str:
    return "n/a" if value is None else f"{value * 100:.{digits}f}"


def num(value: float | None, digits: int = 3) -> str:
    return "n/a" if value is None else f"{value:.{digits}f}"


def format_metrics(m: Row, title: str = "") -> str:
    """A run's metrics block, from a row of ``diagnosis(corpus_metrics(...))``."""
    blocks = [
        ("primary", [("MER", m.mer, ""), ("CER_zh", m.cer_zh, f"over {m.ref_zh} zh tokens"), ("WER_en", m.wer_en, f"over {m.ref_en} en tokens"), ("PIER", m.pier, f"over {m.n_poi} switch-region tokens")]),
        ("errors, as shares of reference tokens", [("substitutions", m.sub_rate, m.subs), ("deletions", m.del_rate, m.dels), ("insertions", m.ins_rate, m.ins)]),
        ("code switching", [("en omission", m.en_omission_rate, f"{m.utts_en_omitted}/{m.utts_with_en_ref} utterances"), ("zh omission", m.zh_omission_rate, f"{m.utts_zh_omitted}/{m.utts_with_zh_ref} utterances"), ("en -> zh", m.en_sub_by_zh_rate, f"{m.en_sub_by_zh} tokens"), ("en lost", m.en_lost_rate, f"{m.en_lost} tokens")]),
        ("sanity", [("runaway", m.runaway_rate, f"{m.utts_runaway} utterances"), ("foreign script", m.foreign_script_rate, f"{m.utts_foreign_script} utterances")]),
    ]
    lines = [f"=== {title} ==="] if title else []
    lines.append(f"utterances={m.n_utts}  ref_tokens={m.n_ref_tokens}  hyp_tokens={m.n_hyp_tokens}")
    for name, rows in blocks:
        lines += ["", f"-- {name} --"]
        lines += [f"  {label:<16}{pct(value):>8} %" + (f"   ({note})" if note != "" else "") for label, value, note in rows]
    lines += [f"  {'switch ratio':<16}{num(m.switch_ratio):>8}   ({m.n_switch_hyp} produced / {m.n_switch_ref} expected)", f"  {'length ratio':<16}{num(m.length_ratio):>8}", f"  {'mean CMI':<16}{num(m.mean_cmi_ref):>8}"]
    lines += ["", "-- diagnosis --", *([f"  {MEANINGS[f]}" for f in m.findings] or ["  nothing anomalous"])]
    return "\n".join(lines)


def markdown_table(rows: Iterable[Row]) -> str:
    """Runs side by side, from rows of ``compare``."""
    columns = ["mer", "cer_zh", "wer_en", "pier", "en_omission_rate", "en_sub_by_zh_rate", "ins_rate", "del_rate", "sub_rate", "runaway_rate", "foreign_script_rate"]
    heads = ["Model", "MER %", "CER_zh %", "WER_en %", "PIER %", "EN omit %", "EN->ZH %", "Ins %", "Del %", "Sub %", "Runaway %", "Foreign %", "Len ratio"]
    lines = ["| " + " | ".join(heads) + " |", "|" + "---|" * len(heads)]
    lines += ["| " + " | ".join([str(r["model"]), *[pct(r[c]) for c in columns], num(r["length_ratio"])]) + " |" for r in rows]
    return "\n".join(lines)


def format_worst(rows: Iterable[Row]) -> str:
    return "\n".join(["-- worst utterances --", *[f"  [{r.id}] MER={pct(r.mer)}%  S={r.subs} D={r.dels} I={r.ins}\n    REF: {r.ref}\n    HYP: {r.hyp}" for r in rows]])


def inventory_to_dict(spans: DataFrame, min_count: int = 1) -> dict:
    """All pairs of at least ``min_count``, by direction; deletions, insertions and lost tokens."""
    table = inventory.inventory(spans).where(F.col("count") >= min_count).orderBy(F.desc("count"), "first_seen").collect()
    out: dict = {"substitutions": {}, "substitutions_at_switch": {}, "deletions": {}, "insertions": {}}
    for r in table:
        if r.kind == "sub":
            key = f"{r.ref_lang}->{r.hyp_lang}"
            out["substitutions"].setdefault(key, []).append({"ref": r.ref, "hyp": r.hyp, "count": r["count"]})
            if r.poi_count >= min_count:
                out["substitutions_at_switch"].setdefault(key, []).append({"ref": r.ref, "hyp": r.hyp, "count": r.poi_count})
        else:
            lang, text = (r.ref_lang, r.ref) if r.kind == "del" else (r.hyp_lang, r.hyp)
            out["deletions" if r.kind == "del" else "insertions"].setdefault(lang, []).append({"text": text, "count": r["count"]})
    lost = inventory.lost_tokens(spans).where(F.col("count") >= min_count).orderBy(F.desc("count"), "first_seen").collect()
    out["lost_english"] = [{"token": r.token, "count": r["count"]} for r in lost]
    return out


def format_inventory(spans: DataFrame, n: int = 30, min_count: int = 2) -> str:
    """The most frequent edits in sections."""
    table = inventory.inventory(spans).cache()
    pick = lambda where, by="count": inventory.top(table.where(where), n, min_count, by).collect()
    sections = [
        ("English became Chinese", pick("kind = 'sub' and ref_lang = 'en' and hyp_lang = 'zh'"), "count"),
        ("English became other English", pick("kind = 'sub' and ref_lang = 'en' and hyp_lang = 'en'"), "count"),
        ("Chinese became other Chinese (single characters may be spelling variants)", pick("kind = 'sub' and ref_lang = 'zh' and hyp_lang = 'zh'"), "count"),
        ("at switch points", pick("kind = 'sub' and poi_count > 0", "poi_count"), "poi_count"),
    ]
    lines = []
    for title, rows, by in sections:
        lines += [f"-- {title} --", *([f"  {r[by]:5d}  {r.ref} -> {r.hyp}" for r in rows] or ["  none"]), ""]
    lost = inventory.top(inventory.lost_tokens(spans), n, min_count).collect()
    lines += ["-- lost English tokens --", *([f"  {r['count']:5d}  {r.token}" for r in lost] or ["  none"]), ""]
    lines += ["-- totals by direction --", *[f"  {r.ref_lang} -> {r.hyp_lang}: {r.total} ({r.distinct_pairs} distinct)" for r in inventory.directions(table).collect()]]
    table.unpersist()
    return "\n".join(lines)


def format_mislabels(rows: DataFrame, found: DataFrame, top: int = 20) -> str:
    pairs = mislabel.mutual_pairs(found).orderBy("index").limit(top).collect()
    alone = mislabel.one_way(found).orderBy(F.desc("improvement"), "index").limit(top).collect()
    impact = mislabel.mer_impact(rows, found).first().mer_impact
    lines = [f"-- suspected swaps: {len(pairs)} --", *[f"  {r.id} <-> {r.best_id}  MER {pct(r.own_mer)}% -> {pct(r.best_mer)}%" for r in pairs]]
    lines += [f"-- one-way matches: {len(alone)} --", *[f"  {r.id} fits {r.best_id}  MER {pct(r.own_mer)}% -> {pct(r.best_mer)}%" for r in alone]]
    return "\n".join([*lines, f"share of MER explained: {pct(impact)} points"])


def format_dose_response(rows: DataFrame, key: str, label: str, bins: int = 10, pos: str = "_pos") -> str:
    table = collapse.dose_response(rows, key, bins, pos).orderBy("bin").collect()
    return "\n".join([f"-- collapse rate by {label} ({bins} equal-count bins) --", *[f"  {r.lo:7.3f} - {r.hi:7.3f}  {r.n:6d}  {r.collapsed:9d}  {pct(r.collapsed / r.n):>6}%  {'#' * int(r.collapsed / r.n * 200)}" for r in table]])


def format_runs(rows: Iterable[Row], markdown: bool = False) -> str:
    """Collapse summaries of several runs."""
    heads = ["run", "n", "collapsed", "rate %", "onset CMI", "top bin %", "script", "share %"]
    cells = [[str(r["model"]), str(r.n), str(r.collapsed), pct(r.rate), num(r.onset), pct(r.top_rate), r.attractor, pct(r.attractor_share, 0)] for r in rows]
    if markdown:
        return "\n".join(["| " + " | ".join(heads) + " |", "|" + "---|" * len(heads), *["| " + " | ".join(c) + " |" for c in cells]])
    return "\n".join("  ".join(f"{x:>12}" for x in c) for c in [heads, *cells])
