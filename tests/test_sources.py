import json

import pytest
from pyspark.sql import functions as F

from glossmill import cli
from glossmill.functions import normalize as N
from glossmill.operators import pairs
from glossmill.operators.transcribe import EchoRecognizer, UnknownRecognizer, advice_for, build_recognizer, check_failures, family_of, fits, load_checked, transcribe, verify_loaded
from glossmill.sources import corpus, records


def put(path, text, encoding="utf-8"):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(text.encode(encoding))
    return str(path)


def test_jsonl(spark, tmp_path):
    good = put(tmp_path / "a.jsonl", '﻿{"id": 1, "text": "x"}\n\n{"id": "b", "text": null}\n')
    assert [(r._pos, r.id, r.text) for r in records.read_jsonl(spark, good).collect()] == [(0, "1", "x"), (2, "b", None)]
    with pytest.raises(ValueError, match=":2: invalid JSON"):
        records.read_jsonl(spark, put(tmp_path / "b.jsonl", '{"id": 1}\nnope\n'))
    records.write_jsonl(records.read_jsonl(spark, good), str(tmp_path / "new" / "c.jsonl"))
    assert [json.loads(x) for x in open(tmp_path / "new" / "c.jsonl", encoding="utf-8")] == [{"id": "1", "text": "x"}, {"id": "b", "text": None}]


def test_manifests(spark, tmp_path):
    tsv = put(tmp_path / "m.tsv", "id\twav\ttrans\na\t1.wav\t好\n")
    assert records.load_manifest(spark, tsv, audio_key="wav", text_key="trans").first().text == "好"
    no_id = put(tmp_path / "m.jsonl", '{"audio": "1.wav", "text": "x"}\n{"audio": "2.wav"}\n')
    assert [(r.id, r.text) for r in records.load_manifest(spark, no_id).collect()] == [("utt_000000", "x"), ("utt_000001", "")]
    data = put(tmp_path / "m.json", json.dumps({"data": [{"id": "a", "audio": "1", "text": "t"}]}))
    assert records.load_manifest(spark, data).first().id == "a"
    for name, text, error in (("d.jsonl", '{"id": "a", "audio": "1"}\n' * 2, ValueError), ("e.jsonl", '{"id": "a"}\n', KeyError), ("f.xml", "", ValueError)):
        with pytest.raises(error):
            records.load_manifest(spark, put(tmp_path / name, text))


def test_join_keeps_gaps_and_the_last(spark):
    manifest = spark.createDataFrame([(0, "a", "x"), (1, "b", None), (2, "c", "z")], "_pos long, id string, text string")
    hyps = spark.createDataFrame([(0, "a", "old", None), (1, "a", "new", None), (2, "c", None, "boom\nmore"), (3, "extra", "q", None)], "_pos long, id string, hyp string, error string")
    got = [(r.id, r.ref, r.hyp, r.missing) for r in pairs.join_hypotheses(manifest, hyps).orderBy("_pos").collect()]
    assert got == [("a", "x", "new", False), ("b", "", "", True), ("c", "z", "", False)]
    assert tuple(pairs.failed_transcriptions(hyps).first()) == (1, "boom")
    with pytest.raises(KeyError):
        pairs.last_hypotheses(hyps.drop("id"))
    with pytest.raises(ValueError):
        pairs.check_unique_ids(hyps, "here")
    with pytest.raises(PermissionError):
        pairs.require_not_test("x/test.utts.jsonl", False)


def test_normaliser(spark):
    cases = {
        "<|yue|>我 Today 好 Busy 啊！": "我 today 好 busy 啊",
        "don't code-switch": "dont codeswitch",
        "好[noise]（笑聲）啊<unk>": "好 啊",
        "ＡＢＣ　１２": "abc 12",
        None: "",
    }
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    got = df.select("t", N.normalize(F.col("t")).alias("n")).collect()
    assert {r.t: r.n for r in got} == cases
    assert N.fold_numbers("three hundred and fifty apples") == "350 apples"
    assert N.fold_numbers("in twenty twenty six") == "in twenty twenty six"
    assert N.fold_numbers("Five and apples, two thousand") == "5 and apples, 2000"
    one = spark.createDataFrame([("“\"好 呀\"”",)], "t string").select(N.clean_transcript(F.col("t")).alias("c"), N.strip_accents(F.lit("café")).alias("s")).first()
    assert (one.c, one.s) == ("好 呀", "cafe")
    with pytest.raises(ValueError):
        N.NormalizeConfig(script="x")


def test_number_words():
    cases = {
        "twenty-six": "20-6", "two hundred thousand and five": "200005", "million thousand": "1001000", "hundred hundred": "10000", "ninety ten twenty": "120",
        "zero": "0", "one_two three": "one_two 3", "Six and  AND seven, and": "13, and", "five\n six": "11", "": "", "twenty two hundred": "2200", "one two": "3",
        "thousands": "thousands", "nineteen  Twenty": "nineteen twenty",
    }
    assert {t: N.fold_numbers(t) for t in cases} == cases


def test_wrapping_quotes(spark):
    cases = {'"""a"""': "a", ' " “x  y” " ': "x y", '"': '"', '""': "", '" " "': '"', '"a': '"a', '""a"': '"a', "a": "a", None: "", "": "", '"a" b "c"': 'a" b "c'}
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    assert {r.t: r.c for r in df.select("t", N.clean_transcript(F.col("t")).alias("c")).collect()} == cases


def test_script_conversion(spark):
    table = N.script_map(spark, "t2s")
    assert spark.range(1).select(N.convert_script(F.lit("會議學"), table).alias("t")).first().t == "会议学"


def corpus_at(root, folders, text="我哋開meeting", encoding="gb18030"):
    for n, topics in folders.items():
        for i, _ in enumerate(topics, 1):
            put(root / "Audio" / f"{n}_ABC" / f"{n}_{i}.wav", "x")
        put(root / "Text" / f"data_{n}.csv", "Topic,Instance\n" + "".join(f'{t},"""{text}{i}"""\n' for i, t in enumerate(topics)), encoding)
    return str(root)


def test_corpus(spark, tmp_path):
    root = corpus_at(tmp_path / "c", {n: ["A", "B"] for n in (1, 2, 10)})
    put(tmp_path / "c" / "Text" / "data_99.csv", "Topic,Instance\n")
    put(tmp_path / "c" / "Audio" / "2_ABC" / "2_9.wav", "x")
    rows, meta = corpus.prepare(spark, root, prefix="/data/")
    got = rows.orderBy("_pos").collect()
    assert [r.id for r in got] == ["1_ABC_1_1", "1_ABC_1_2", "10_ABC_10_1", "10_ABC_10_2"]
    assert got[0].text == "我哋開meeting0" and got[0].audio == "/data/Audio/1_ABC/1_1.wav" and got[0].topic == "A"
    assert meta["train_folders"] == [1, 2] and meta["test_folders"] == [10]  # the skipped folder still counts
    assert any("data_99" in p for p in meta["problems"]) and any("unsafe" in p for p in meta["problems"])
    corpus.write_splits(rows, meta, str(tmp_path / "out"))
    assert len(open(tmp_path / "out" / "test.jsonl").readlines()) == 2
    assert corpus.load_dataset(spark, "folders", root, "all").count() == 4
    with pytest.raises(KeyError):
        corpus.load_dataset(spark, "nope", root)
    with pytest.raises(FileNotFoundError):
        corpus.discover(spark, str(tmp_path / "none"))


def test_csv_shapes(spark, tmp_path):
    root = corpus_at(tmp_path / "c", {1: ["A"] * 5, 2: [], 3: [], 4: ["A"]})
    put(tmp_path / "c" / "Text" / "data_1.csv", 'n, Instance ,TOPIC\r\n1,"a, ""b""\nc",T\r\n\r\n2,5" long,U\n,,\n3,"  ",V\n4,w\n5,"""x"" y"z,W')
    put(tmp_path / "c" / "Text" / "data_2.csv", "")
    put(tmp_path / "c" / "Text" / "data_3.csv", "a,b\n1,2\n")
    for n in (2, 3):
        put(tmp_path / "c" / "Audio" / f"{n}_ABC" / f"{n}_1.wav", "x")
    rows, _, problems = corpus.read_corpus(spark, root)
    got = {(r.folder, r.row): (r.topic, r.text) for r in rows.collect()}
    assert got == {(1, 1): ("T", 'a, "b" c'), (1, 2): ("U", '5" long'), (1, 5): ("W", '"x" yz'), (4, 1): ("A", "我哋開meeting0")}
    assert [p.split(":")[0] for p in problems] == ["data_1.csv", "data_1.csv", "data_2.csv", "data_3.csv"]
    assert "row 3" in problems[0] and "row 4 has only 2" in problems[1]


def test_encodings():
    for name in ("utf-8-sig", "utf-8", "gb18030"):
        assert corpus.decode("會議".encode(name)) == "會議"
    assert corpus.decode("會議".encode("big5"), "big5") == "會議"


def test_transcription(spark):
    manifest = spark.createDataFrame([(i, f"u{i}", f"/x/{'bad' if i == 3 else i}.wav") for i in range(40)], "_pos long, id string, audio string").coalesce(1)
    got = {r.id: r for r in transcribe(manifest, lambda: EchoRecognizer(fail_on="bad")).collect()}
    assert got["u5"].hyp == "5" and got["u3"].hyp == "" and "cannot read" in got["u3"].error
    with pytest.raises(Exception, match="aborting"):
        transcribe(manifest, lambda: EchoRecognizer(fail_on="/x/")).collect()
    hyps = spark.createDataFrame([(i, "", "out of memory" if i < 5 else None) for i in range(10)], "_pos long, hyp string, error string")
    with pytest.raises(RuntimeError, match="batch-size"):
        check_failures(hyps)


def test_registry(tmp_path, capsys):
    put(tmp_path / "ck" / "config.json", '{"model_type": "whisper"}')
    assert family_of(str(tmp_path / "ck")) == ("whisper", "config.json")
    assert build_recognizer(str(tmp_path / "ck"), language=None).default_language == "yue"
    assert build_recognizer("sensevoice-small", prompt="x").model_id and "does not support prompt" in capsys.readouterr().out
    for name in ("nope", "some/unknown"):
        with pytest.raises(UnknownRecognizer):
            build_recognizer(name)
    assert EchoRecognizer(device="shard").resolve_device_map() == "auto" and EchoRecognizer(device="cuda").resolve_device() == "cuda:0"
    with pytest.raises(RuntimeError):
        verify_loaded({"missing_keys": [f"{i}.weight" for i in range(11)]}, "m")
    verify_loaded({"missing_keys": ["a.weight"]}, "m")

    class Model:
        @classmethod
        def from_pretrained(cls, model_id, output_loading_info=False):
            return (cls(), {"missing_keys": [f"{i}.bias" for i in range(11)], "unexpected_keys": ["thinker.x"]}) if output_loading_info else cls()

    with pytest.raises(RuntimeError, match="thinker.x"):
        load_checked(Model, "m")


def test_prompts_and_language():
    asked = build_recognizer("qwen3-asr-0.6b", prompt="p", language="Cantonese").request(["a.wav"])
    assert asked == {"audio": "a.wav", "language": "Cantonese", "prompt": "p"}
    assert build_recognizer("whisper").options()["language"] == "yue"
    assert "language" not in build_recognizer("whisper", language="").options()
    assert build_recognizer("whisper").model_id == "openai/whisper-large-v3"


def test_advice():
    assert "--batch-size" in advice_for("CUDA Out of Memory") and "cuda:0" in advice_for("Expected ... but found at least two devices")
    assert "manifest" in advice_for(FileNotFoundError("x")) and advice_for("something else") == ""


def test_constraint_markers():
    # the markers of white space have no script; Thai and Latin do
    assert all(fits(x, "zh") for x in ("Ċ", "ĉ", "Ġ好", "▁好", "12", "!", b"\xe5\xa5\xbd"))
    assert not fits("ok", "zh") and not fits("กา", "zh+en") and fits("Ġcafé", "en")


def test_command_line(spark, tmp_path, capsys):
    refs = ["我好busy啊", "今日天氣好好", "我要去返工"]
    m = put(tmp_path / "m.jsonl", "".join(json.dumps({"id": f"{i + 1}_ABC_{i}", "audio": f"{i}.wav", "text": t}, ensure_ascii=False) + "\n" for i, t in enumerate(refs)))
    h = put(tmp_path / "h.jsonl", "".join(json.dumps({"id": f"{i + 1}_ABC_{i}", "hyp": t}, ensure_ascii=False) + "\n" for i, t in enumerate(["我好啊", refs[2], refs[1]])))
    out, utts = str(tmp_path / "o.json"), str(tmp_path / "dev.utts.jsonl")
    assert cli.main(["score", "--manifest", m, "--hyp", h, "--script", "none", "--out-json", out, "--out-utts", utts]) == 0
    assert json.load(open(out))["metrics"]["n_utts"] == 3
    assert cli.main(["analyze", "--utts", utts, "--min-count", "1"]) == 0
    assert cli.main(["check-alignment", "--utts", utts, "--out-json", str(tmp_path / "s.json")]) == 0
    assert cli.main(["compare", out, out]) == 0
    assert cli.main(["collapse", utts]) == 0
    assert cli.main(["compare-collapse", utts, str(tmp_path / "none"), "--markdown"]) == 0
    text = capsys.readouterr().out
    assert "busy" in text and "suspected swaps: 1" in text and "| Model |" in text and "missing:" in text
    assert cli.main(["run", "--manifest", m, "--model", "echo", "--out", str(tmp_path / "e.jsonl"), "--script", "none"]) == 0
    assert cli.main(["analyze", "--utts", put(tmp_path / "test.jsonl", '{"id": "1", "ref": "a", "hyp": "b"}\n')]) == 1
    with pytest.raises(SystemExit):
        cli.main(["analyze", "--utts", m])


def test_the_normaliser_holds_a_few_texts_at_a_time(spark, monkeypatch):
    from pyspark.util import PythonEvalType

    from glossmill.functions import batches

    made, own = [], batches.arrow_function
    monkeypatch.setattr(N, "arrow_function", lambda kernel, kind: made.append(own(kernel, kind)) or made[-1])
    config = N.NormalizeConfig(script=None, strip_accents=True, normalize_numbers=True)
    rows = spark.createDataFrame([(i, None if i == 5 else f"Café Ｔwenty one [x] {i}") for i in range(1201)], "id long, t string").coalesce(1)
    done = rows.select("id", N.normalize(F.col("t"), config).alias("t"), N.strip_accents("t").alias("s")).collect()
    assert {r.id: r.t for r in done} == {i: "" if i == 5 else f"cafe 21 {i}" for i in range(1201)}
    assert done[0].s == "Cafe Twenty one [x] 0" and [r.id for r in done if r.s is None] == [5]
    assert [f.evalType for f in (*made, N.strip_accents)] == [PythonEvalType.SQL_SCALAR_ARROW_UDF] * 2
