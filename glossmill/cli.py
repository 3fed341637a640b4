"""Command line: transcribe, score, run, analyze, check-alignment, compare, prepare, collapse, compare-collapse."""

from __future__ import annotations

import argparse
import json
import os
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import normalize as N
from .functions import text as X
from .operators import collapse, inventory, mislabel, pairs, report, scoring, splits, transcribe
from .session import get_session, ship
from .sources import corpus, records


def _source(p: argparse.ArgumentParser) -> None:
    g = p.add_argument_group("data source")
    g.add_argument("--manifest", help="JSONL, JSON, TSV or CSV")
    for key in ("id", "audio", "text"):
        g.add_argument(f"--{key}-key", default=key)
    g.add_argument("--dataset", choices=sorted(corpus.DATASETS), help="read a corpus directory")
    g.add_argument("--dataset-root")
    g.add_argument("--dataset-split", default="test", choices=corpus.SPLITS)
    g.add_argument("--train-folders", type=int, default=112)
    g.add_argument("--train-ratio", type=float, default=0.7)
    g.add_argument("--dev-ratio", type=float, default=0.0)
    g.add_argument("--dataset-stratify", default="none", choices=["none", "topic"])
    g.add_argument("--dataset-encoding", default="auto")
    g.add_argument("--hf-dataset")
    g.add_argument("--hf-config")
    g.add_argument("--hf-split", default="test")
    g.add_argument("--hf-audio-column", default="audio")
    g.add_argument("--hf-text-column", default="text")
    g.add_argument("--hf-id-column")
    g.add_argument("--audio-cache-dir")
    g.add_argument("--limit", type=int, help="the first N utterances only")


def _norm(p: argparse.ArgumentParser) -> None:
    g = p.add_argument_group("normalisation of both sides")
    g.add_argument("--script", default="t2s", choices=["t2s", "s2t", "none"])
    g.add_argument("--keep-case", action="store_true")
    g.add_argument("--keep-punct", action="store_true")
    g.add_argument("--keep-tags", action="store_true")
    g.add_argument("--normalize-numbers", action="store_true")
    g.add_argument("--drop-string", action="append", default=[])


def _metric(p: argparse.ArgumentParser) -> None:
    g = p.add_argument_group("metrics")
    g.add_argument("--poi-window", type=int, default=1)
    g.add_argument("--runaway-ratio", type=float, default=2.0)
    g.add_argument("--worst", type=int, default=20)
    g.add_argument("--out-json")
    g.add_argument("--out-utts")
    g.add_argument("--name")


def _model(p: argparse.ArgumentParser) -> None:
    g = p.add_argument_group("model")
    g.add_argument("--model", required=True, help="an alias, a hub id, or a checkpoint directory")
    g.add_argument("--model-id")
    g.add_argument("--language")
    g.add_argument("--device", default="auto")
    g.add_argument("--dtype", default="auto")
    g.add_argument("--batch-size", type=int, default=1)
    g.add_argument("--max-new-tokens", type=int, default=256)
    g.add_argument("--prompt", help="'anchor' for the built-in one")
    g.add_argument("--script-constraint", choices=sorted(transcribe.CONSTRAINTS))
    g.add_argument("--no-repeat-ngram-size", type=int)
    g.add_argument("--chunk-length-s", type=float)
    g.add_argument("--out")


def build_parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="glossmill", description=__doc__)
    sub = parser.add_subparsers(dest="command", required=True)
    p = sub.add_parser("transcribe")
    _source(p), _model(p)
    p = sub.add_parser("score")
    _source(p), _norm(p), _metric(p)
    p.add_argument("--hyp", required=True)
    p = sub.add_parser("run")
    _source(p), _norm(p), _metric(p), _model(p)
    for name in ("analyze", "check-alignment"):
        p = sub.add_parser(name)
        p.add_argument("--utts", required=True, help="a dump written by score --out-utts")
        p.add_argument("--out-json")
        p.add_argument("--top", type=int, default=30 if name == "analyze" else 20)
        if name == "analyze":
            p.add_argument("--out-text")
            p.add_argument("--min-count", type=int, default=2)
            p.add_argument("--poi-window", type=int, default=1)
            p.add_argument("--allow-test", action="store_true")
        else:
            p.add_argument("--window", type=int, default=5)
            p.add_argument("--min-own-mer", type=float, default=0.5)
            p.add_argument("--ratio", type=float, default=0.5)
            p.add_argument("--max-best-mer", type=float, default=0.5)
    p = sub.add_parser("compare")
    p.add_argument("metrics", nargs="+", help="files written by score --out-json")
    p = sub.add_parser("prepare")
    p.add_argument("--root", required=True)
    p.add_argument("--out", required=True)
    p.add_argument("--train-folders", type=int, default=112)
    p.add_argument("--train-ratio", type=float, default=0.7)
    p.add_argument("--dev-ratio", type=float, default=0.0)
    p.add_argument("--stratify", default="none", choices=["none", "topic"])
    p.add_argument("--encoding", default="auto")
    p.add_argument("--path-prefix")
    p = sub.add_parser("collapse")
    p.add_argument("utts")
    p.add_argument("--manifest")
    p.add_argument("--bins", type=int, default=10)
    p.add_argument("--corpus-name", default="[A-Za-z]", help="what follows the speaker's number in ids (a pattern)")
    p = sub.add_parser("compare-collapse")
    p.add_argument("utts", nargs="+")
    p.add_argument("--bins", type=int, default=10)
    p.add_argument("--markdown", action="store_true")
    p = sub.add_parser("sweep", help="several models over one source, then compare")
    _source(p), _norm(p), _metric(p)
    p.add_argument("--models", nargs="+", required=True)
    p.add_argument("--out-dir", required=True)
    p.add_argument("--batch-size", type=int, default=8)
    p.add_argument("--device", default="auto")
    return parser


def load_records(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """The manifest, the corpus directory or the hub dataset that is named, in this order; an empty one is an error."""
    if a.manifest:
        out = records.load_manifest(spark, a.manifest, a.id_key, a.audio_key, a.text_key)
    elif a.dataset:
        if not a.dataset_root:
            raise SystemExit("--dataset needs --dataset-root")
        warn = lambda m: print(f"[warn] {m}")
        out = corpus.load_dataset(spark, a.dataset, a.dataset_root, a.dataset_split, warn=warn, train_folders=a.train_folders, train_ratio=a.train_ratio, dev_ratio=a.dev_ratio, stratify=a.dataset_stratify, encoding=a.dataset_encoding)
    elif a.hf_dataset:
        out = records.load_hub_dataset(spark, a.hf_dataset, a.hf_split, a.hf_config, a.hf_audio_column, a.hf_text_column, a.hf_id_column, a.audio_cache_dir)
    else:
        raise SystemExit("name a source: --manifest, --dataset or --hf-dataset")
    out = pairs.limit_rows(out, a.limit)
    if not out.take(1):
        raise SystemExit("the source has no rows")
    return out


def normalizer(spark: SparkSession, a: argparse.Namespace):
    config = N.NormalizeConfig(script=None if a.script == "none" else a.script, lowercase=not a.keep_case, remove_punct=not a.keep_punct, remove_tags=not a.keep_tags, normalize_numbers=a.normalize_numbers, drop_strings=tuple(a.drop_string))
    table = N.script_map(spark, config.script) if config.script else None
    return lambda c: N.normalize(c, config, table)


def _plain(m) -> dict:
    return {k: v for k, v in m.asDict(recursive=True).items() if k != "findings"}


def cmd_transcribe(spark: SparkSession, a: argparse.Namespace) -> int:
    options = {k: getattr(a, k) for k in ("model_id", "language", "device", "dtype", "batch_size", "max_new_tokens", "script_constraint", "no_repeat_ngram_size", "chunk_length_s")}
    options["prompt"] = transcribe.ANCHOR_PROMPT if a.prompt == "anchor" else a.prompt
    model = transcribe.build_recognizer(a.model, **options)
    hyps = transcribe.transcribe(load_records(spark, a), lambda: model)
    records.write_jsonl(hyps.withColumn("error", F.col("error")), a.out)
    transcribe.check_failures(records.read_jsonl(spark, a.out, "id string, hyp string, error string"))
    return 0


def cmd_score(spark: SparkSession, a: argparse.Namespace) -> int:
    hyps = records.read_jsonl(spark, a.hyp, "id string, hyp string, text string, error string")
    failed = pairs.failed_transcriptions(hyps).first()
    if failed.n_failed:
        print(f"[warn] {failed.n_failed} failed transcriptions, such as: {failed.first_error}")
    joined = pairs.join_hypotheses(load_records(spark, a), hyps)
    missing = joined.where("missing").count()
    if missing:
        print(f"[warn] {missing} utterances have no hypothesis and score as deleted")
    norm = normalizer(spark, a)
    utts = scoring.score_utterances(joined.select("_pos", "id", norm(F.col("ref")).alias("ref"), norm(F.col("hyp")).alias("hyp")), a.poi_window).persist()
    full = scoring.diagnosis(scoring.corpus_metrics(utts, runaway_ratio=a.runaway_ratio)).first()
    clean = scoring.corpus_metrics_clean(utts, runaway_ratio=a.runaway_ratio).first()
    name = a.name or os.path.basename(a.hyp)
    print(report.format_metrics(full, name))
    if clean.n_utts != full.n_utts:
        print(f"\n-- without {full.n_utts - clean.n_utts} degenerate utterances --")
        for label, key in (("MER", "mer"), ("CER_zh", "cer_zh"), ("WER_en", "wer_en"), ("PIER", "pier"), ("insertions", "ins_rate")):
            print(f"  {label:<12}{report.pct(full[key])} -> {report.pct(clean[key])} %")
    if a.worst:
        print("\n" + report.format_worst(scoring.worst_utterances(utts, a.worst).collect()))
    if a.out_json:
        config = {k: v for k, v in vars(a).items() if isinstance(v, (str, int, float, bool, list, type(None)))}
        records.write_json({"name": name, "config": config, "metrics": _plain(full), "n_failed_transcriptions": failed.n_failed}, a.out_json)
    if a.out_utts:
        records.write_jsonl(utts, a.out_utts)
    utts.unpersist()
    return 0


def cmd_run(spark: SparkSession, a: argparse.Namespace) -> int:
    """Transcribes to the file, then scores the file."""
    if not a.out:
        raise SystemExit("run needs --out")
    a.hyp = a.out
    return cmd_transcribe(spark, a) or cmd_score(spark, a)


def _dump(spark: SparkSession, path: str) -> DataFrame:
    utts = records.read_jsonl(spark, path)
    try:
        pairs.require_columns(utts, "id", "ref", "hyp")
    except ValueError as e:
        raise SystemExit(f"{path}: {e}") from e
    if utts.where("ref is null or hyp is null").take(1):
        raise SystemExit(f"{path}: some rows lack ref or hyp; a dump written by score --out-utts has them")
    return utts


def cmd_analyze(spark: SparkSession, a: argparse.Namespace) -> int:
    utts = _dump(spark, a.utts)
    try:
        pairs.require_not_test(a.utts, a.allow_test)
    except PermissionError as e:
        print(e)
        return 1
    spans = inventory.edits(utts.select("_pos", "id", "ref", "hyp"), a.poi_window).persist()
    text = report.format_inventory(spans, a.top, a.min_count)
    print(text)
    if a.out_text:
        with open(a.out_text, "w", encoding="utf-8") as f:
            f.write(text + "\n")
    if a.out_json:
        records.write_json(report.inventory_to_dict(spans), a.out_json)
    return 0


def cmd_check_alignment(spark: SparkSession, a: argparse.Namespace) -> int:
    rows = _dump(spark, a.utts).select(F.col("_pos").alias("index"), "id", "ref", "hyp")
    found = mislabel.misalignments(rows, a.window, a.min_own_mer, a.ratio, a.max_best_mer).persist()
    print(report.format_mislabels(rows, found, a.top))
    if a.out_json:
        records.write_json([r.asDict() for r in mislabel.with_mutual(found).orderBy("index").collect()], a.out_json)
    return 0


class _Metrics(dict):
    """A metrics file as a row; figures that it lacks are not available."""

    def __missing__(self, key):
        return None


def cmd_compare(spark: SparkSession | None, a: argparse.Namespace) -> int:
    rows = []
    for path in a.metrics:
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        rows.append(_Metrics(data["metrics"], model=data["name"]))
    print(report.markdown_table(rows))
    return 0


def cmd_prepare(spark: SparkSession, a: argparse.Namespace) -> int:
    rows, meta = corpus.prepare(spark, a.root, a.train_folders, a.train_ratio, a.encoding, a.path_prefix, a.stratify, a.dev_ratio)
    rows = rows.persist()
    corpus.write_splits(rows, meta, a.out)
    for r in splits.split_summary(rows).orderBy("split").collect():
        print(f"{r['split']}: {r.utterances} utterances, {r.speakers} speakers, {r.zh_tokens} zh and {r.en_tokens} en tokens, {report.pct(r.share_with_english, 1)} % with English, mean CMI {r.mean_cmi:.3f}")
    for message in meta["problems"] + meta["balance_warnings"]:
        print(f"[warn] {message}")
    return 0


def cmd_collapse(spark: SparkSession, a: argparse.Namespace) -> int:
    rows = records.read_jsonl(spark, a.utts)
    rows = rows.withColumn("speaker", X.speaker_of(F.col("id"), a.corpus_name))
    if a.manifest:
        rows = rows.join(records.read_jsonl(spark, a.manifest).select("id", "topic"), "id", "left")
    rows = rows.persist()
    for r in collapse.group_means(rows).collect():
        print(f"{'collapsed' if r.foreign_script else 'normal'}: n={r.n} CMI={report.num(r.mean_cmi)} en={report.num(r.mean_en)} zh={report.num(r.mean_zh)} length={report.num(r.mean_len)}")
    test = collapse.permutation_test(rows).first()
    print(f"permutation p for CMI: {'n/a' if test.p_value is None else f'{test.p_value:.4g}'}")
    print(report.format_dose_response(rows, "cmi_ref", "CMI", a.bins))
    print(report.format_dose_response(rows, "n_ref", "length", a.bins))
    for r in collapse.length_cmi_grid(rows).orderBy("stratum", "cell").collect():
        print(f"  length {r.min_ref}-{r.max_ref}, cell {r.cell + 1}: {r.collapsed}/{r.n}")
    for key in ("speaker", *(["topic"] if a.manifest else [])):
        groups = collapse.concentration(rows, key)
        share = collapse.top_share(groups, key).first()
        print(f"-- by {key}: {share.groups} with a collapse; the top 8 have {share.covered}/{share.collapsed}")
        for r in groups.orderBy(F.desc("collapsed"), key).limit(8).collect():
            print(f"  {r[key]}: {r.collapsed}/{r.total}")
    return 0


def cmd_compare_collapse(spark: SparkSession, a: argparse.Namespace) -> int:
    runs = None
    for path in a.utts:
        if not os.path.exists(path):
            print(f"[warn] missing: {path}")
            continue
        name = os.path.splitext(os.path.basename(path))[0].replace(".utts", "")
        one = records.read_jsonl(spark, path).withColumn("model", F.lit(name))
        runs = one if runs is None else runs.unionByName(one, allowMissingColumns=True)
    if runs is None:
        raise SystemExit("nothing to compare")
    print(report.format_runs(collapse.summarise_runs(runs, a.bins).orderBy("model").collect(), a.markdown))
    return 0


def cmd_sweep(spark: SparkSession, a: argparse.Namespace) -> int:
    """Runs each model over the same source, and compares them."""
    done = []
    for model in a.models:
        stem = os.path.join(a.out_dir, model.replace("/", "_"))
        options = ["run", "--model", model, "--batch-size", str(a.batch_size), "--device", a.device, "--out", f"{stem}.jsonl", "--out-json", f"{stem}.metrics.json", "--out-utts", f"{stem}.utts.jsonl", "--name", model]
        own = build_parser().parse_args(options)
        for key, value in vars(a).items():
            if key not in ("command", "models", "out_dir", "out_json", "out_utts", "name", "batch_size", "device"):
                setattr(own, key, value)
        cmd_run(spark, own)
        done.append(own.out_json)
    return cmd_compare(spark, argparse.Namespace(metrics=done))


COMMANDS = {"transcribe": cmd_transcribe, "score": cmd_score, "run": cmd_run, "analyze": cmd_analyze, "check-alignment": cmd_check_alignment, "compare": cmd_compare, "prepare": cmd_prepare, "collapse": cmd_collapse, "compare-collapse": cmd_compare_collapse, "sweep": cmd_sweep}


def main(argv: list[str] | None = None) -> int:
    a = build_parser().parse_args(argv)
    if a.command == "compare":
        return cmd_compare(None, a)
    spark = SparkSession.getActiveSession() or get_session()
    ship(spark)
    return COMMANDS[a.command](spark, a)


if __name__ == "__main__":
    sys.exit(main())
