"""PII, token counts, quality, URLs: exact parts by brute force, and awkward inputs."""

import hashlib
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from glossmill.llm import pii, quality, token_counts, url_rules

AWKWARD = [None, "", " \n\t ", "a", "a " * 20_000, "\U00020000é ß x", "1" * 20_000, "a@" * 3000, "9.9." * 5000, "the same line\n" * 50]
TABLE = "doc_id long, text string, kind string, words int, row int, score int, n_tokens int"


def table(spark, texts):
    """With columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, "k", 1, 2, 3, 4) for i, t in enumerate(texts)], TABLE)


def luhn(d):
    return sum(int(c) if i % 2 == 0 else int(c) * 2 - 9 * (int(c) > 4) for i, c in enumerate(reversed(d))) % 10 == 0


def base_spans(t):
    """The four patterns as they are stated."""
    out = []
    patterns = (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")
    for kind, p in zip(pii.BASE, patterns):
        for m in re.finditer(p, t or ""):
            d = re.sub("[^0-9]", "", m[0])
            if (kind == "ip" and any(int(x) > 255 for x in m[0].split("."))) or (kind == "card" and not (14 <= len(d) <= 19 and luhn(d))) or (kind == "phone" and not 10 <= len(d) <= 15):
                continue
            out.append((m.start(), pii.KINDS.index(kind), kind, m.end()))
    return [(k, s, e) for s, _, k, e in sorted(out)]


PII = [
    "write to jo.doe+x@mail.example.com or a@b.c_d@e.f. now",
    "ip 10.0.0.1 and 1.2.3.4.5.6.7.8 and 999.1.1.1 and 001.002.003.0004",
    "card 4111 1111 1111 1111 or 4111-1111-1111-1111, 4111111111111112 no; 12 3",
    "\U00020000 call +1 (212) 555-0101, +44 20 7946 0958 or +1 2",
    'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" by Dr. Anna Smith',
    "4111 1111 1111 1111 4111 1111 1111 1111",
]


def test_base_spans_equal_the_patterns(spark):
    texts = PII + AWKWARD[:6] + ["a@b.c" * 200, "+1 555 123 4567 " * 200, "9.9." * 500]
    got = {r.doc_id: r for r in pii.find_spans(table(spark, texts)).collect()}
    for i, t in enumerate(texts):
        assert [(x.kind, x.s, x.e) for x in got[i].base] == base_spans(t), t
        assert {(x.kind, x.s, x.e) for x in got[i].base} <= {(x.kind, x.s, x.e) for x in got[i].spans}
    assert got[len(PII)].base == [] == got[len(PII)].spans


def test_very_long_texts_do_not_overflow(spark):
    rows = pii.find_spans(table(spark, AWKWARD + ["x." * 50_000 + "@" + "a." * 50_000])).collect()
    assert len(rows) == len(AWKWARD) + 1
    assert pii.find_spans(spark.createDataFrame([], TABLE)).collect() == []


def test_secrets_are_added_and_decoys_are_not(spark):
    texts = [f'so token = "{hashlib.sha1(str(i).encode()).hexdigest()}" it is' for i in range(30)] + [f"order {10**15 + i * 7919} came" for i in range(30)] + PII
    spans = {r.doc_id: [x.kind for x in r.spans] for r in pii.find_spans(table(spark, texts)).collect()}
    assert all(spans[i] == ["secret"] for i in range(30))


def test_expectation_maximisation_and_classifier():
    rows = [("secret", "y-yyy-", 90), ("secret", "y--y--", 40), ("secret", "n--nn-", 100), ("secret", "n---nn", 50)]
    post, _ = pii.estimate_reliabilities(rows)
    assert post["secret", "y-yyy-"] > 0.9 > 0.1 > post["secret", "n---nn"]
    assert pii.estimate_reliabilities([])[0] == {}
    # nothing but true secrets of three kinds beside base candidates: known truths keep the sides from changing places
    rows = [("ip", "yy.-y-", 1300), ("ip", "yn.-y-", 40), ("card", "yyy-y-", 900), ("card", "yn--y-", 800), ("email", "y.y-y-", 1200), ("phone", "yy.-y-", 1200)]
    post, _ = pii.estimate_reliabilities(rows + [("secret", "y.-yy-", 380), ("secret", "y.y-y-", 360), ("number", "yn--y-", 800)])
    assert all(post["secret", v] > 0.9 for v in ("y.-yy-", "y.y-y-")) and post["number", "yn--y-"] < 0.1
    assert all(post[k, v] == (v[1] != "n") for k, v, _ in rows)


def test_classifier_decides_by_the_span():
    # hex of 40 characters in quotes against short lower-case words with a digit; votes are not among its features
    cells = [("secret", "530512", 95.0, 100), ("secret", "530411", 88.0, 90), ("secret", "210131", 2.0, 80), ("secret", "110130", 4.0, 60)]
    weights = pii.train_classifier(cells)
    z = lambda f: weights[("secret",)] + sum(weights.get(("secret", j, v), 0.0) for j, v in enumerate(f))
    assert z("530512") > 0 and z("530511") > 0 and z("210131") < 0 and z("110131") < 0
    assert pii.train_classifier([]) == {}


def test_classifier_finds_spans_it_has_not_learned_from(spark):
    texts = [f'so token = "{hashlib.sha1(str(i).encode()).hexdigest()}" it is' if i % 2 else f"order number {10**15 + i * 7919} and wordy-thing-{i}x came" for i in range(90)]
    out = pii.find_spans(table(spark, texts), learn=F.col("doc_id") % 3 != 0)
    got = {r.doc_id: [x.kind for x in r.spans if x.kind in pii.ADDED] for r in out.collect()}
    assert all(got[i] == (["secret"] if i % 2 else []) for i in range(0, 90, 3))


def test_span_features_and_entropy(spark):
    import math

    rows = [("aaaa", "x ", ""), ("abab", "The Word: ", " b"), ("A1b2C3d4E5f6G7h8I9", "", '"'), ("", "", "-")]
    df = spark.createDataFrame(rows, "word string, before string, after string")
    got = df.select("word", pii.entropy(F.col("word")).alias("h"), pii.span_features(F.struct("word", "before", "after")).alias("f")).collect()
    for r in got:
        want = -sum(c / len(r.word) * math.log2(c / len(r.word)) for c in Counter(r.word).values())
        assert r.h == pytest.approx(want) and len(r.f) == len(pii.FEATURES)
        assert all(int(c, 16) < n for c, n in zip(r.f, pii.FEATURES.values()))


def test_many_matches_in_one_text(spark):
    text = " ".join(f"a{i}@b.com 1.2.3.{i % 256}" for i in range(2000))
    row = pii.find_spans(table(spark, [text])).first()
    assert [(x.kind, x.s, x.e) for x in row.base] == base_spans(text)


def test_gazetteers_are_an_input(spark):
    terms = spark.createDataFrame([("names", "Zebedee"), ("names", "Zebedee"), ("titles", "Lord")], "list string, term string")
    own = pii.gazetteers_of(terms)
    assert own["names"] == ["Zebedee"] and own["domains"] == pii.GAZETTEERS["domains"]
    found = pii.candidates(table(spark, ["Dear Zebedee Smith and James Smith, Lord Byron"]), own).first()
    assert [x.kind for x in found.more] == ["name", "name"]
    with pytest.raises(ValueError):
        pii.gazetteers_of(spark.createDataFrame([("other", "x")], "list string, term string"))


def brute_quality(t):
    t = t or ""
    w = [x for x in re.split("[ \t-\r]+", t) if x]
    seen = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {j for i in range(len(w) - 2) if seen[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in t.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered)


def test_quality(spark):
    good = [" ".join(f"word{(i * 31 + j * 17) % 97}" for j in range(120)) for i in range(40)]
    junk = [" ".join(f"x{(i * 7 + j) % 89}%%%" for j in range(120)) for i in range(40)]
    texts = AWKWARD + good + junk + ["a a a a b", "x y z x y z\nx y z"]
    labels = spark.createDataFrame([(len(AWKWARD) + i, 1, 0) for i in range(40)] + [(None, 1, 0), (10**9, 1, 0)], "doc_id long, quality int, toxic int")
    rows = {r.doc_id: r for r in quality.judge(table(spark, texts), labels).collect()}
    for i, t in enumerate(texts):
        r = rows[i]
        n, *_, repeats = brute_quality(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute_quality(t)
        assert r.base_failed == (n < 50 or 100 * repeats > 50 * n) and (not r.kept or not r.base_failed)
    assert all(rows[len(AWKWARD) + i].kept for i in range(40))
    assert not any(rows[len(AWKWARD) + 40 + i].kept for i in range(40))
    assert quality.judge(spark.createDataFrame([], TABLE), labels.limit(0)).collect() == []


@pytest.mark.parametrize("broadcast_ids", [0, 1000])
def test_quality_scores_equal_plain_ones(spark, broadcast_ids):
    import math

    texts = [" ".join(f"w{(i * j) % (5 + i % 3)}" for j in range(i % 9)) for i in range(40)] + [None, ""]
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, texts[3]), (None, "w1 w2")]
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(20)] + [(1, 1, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    n = 64
    # the buckets are Spark's hash; what is made of them is counted here
    words = quality.words_of(F.coalesce("text", F.lit("")))
    own = [r.b for r in docs.select(quality.let(words, lambda w: quality.buckets_of(w, n)).alias("b")).collect()]
    raw, target = Counter(), Counter()
    for (d, _), b in zip(rows, own):
        raw.update(b)
        if d is not None and d < 20 and d % 2 == 1:
            target.update(b)
    share = {x: (raw[x] + 1) / (raw.total() + n) for x in range(n)}
    ratio = {x: math.log((target[x] + n * share[x]) / (target.total() + n) / share[x]) for x in range(n)}
    got = quality.judge(docs, labels, buckets=n, broadcast_ids=broadcast_ids, min_words=0).collect()
    want = sorted((d is None, d or 0, round(sum(ratio[x] for x in b) / max(1, len(b)), 6)) for (d, _), b in zip(rows, own))
    assert sorted((r.doc_id is None, r.doc_id or 0, round(r.score, 6)) for r in got) == want
    assert all(r.kept == (not r.base_failed and r.score >= -0.04) for r in got)


def test_token_counts_equal_the_library(spark):
    tokenizers = pytest.importorskip("tokenizers")
    public = pytest.importorskip("public_tokenizers")
    path = public.path("byte_bpe_50k.json")
    library = tokenizers.Tokenizer.from_file(path)
    texts = AWKWARD + ["it's 's'sX we'll've", "\n\n \n x  y", "<|endoftext|>a<|endoftext|> b", "don't!'s 'RE 12½³ é  ü", " " * 3000 + "x", "-" * 777, "中文 и русский"]
    got = {r.doc_id: r for r in token_counts.count_tokens(table(spark, texts), path, 1024).collect()}
    for i, t in enumerate(texts):
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        assert (got[i].n_tokens, got[i].n_bytes, got[i].over_limit) == (n, len((t or "").encode()), n > 1024), t
    assert token_counts.count_tokens(spark.createDataFrame([], TABLE), path, 1).collect() == []


def test_every_code_point_counts_as_in_the_library():
    tokenizers = pytest.importorskip("tokenizers")
    public = pytest.importorskip("public_tokenizers")
    path = public.path("byte_bpe_50k.json")
    library, own = tokenizers.Tokenizer.from_file(path), token_counts.Counter(path)
    codes = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    # each one before and after letters, numbers, spaces, itself and other signs
    texts = ["".join(f"a{chr(c)}b {chr(c)}{chr(c)}1{chr(c)} 2.{chr(c)}\n" for c in codes[i : i + 64]) for i in range(0, len(codes), 64)]
    want = [len(x.ids) for x in library.encode_batch(texts, add_special_tokens=False)]
    assert [i for i, (a, b) in enumerate(zip(own(texts), want)) if a != b] == []


def test_lexicon_annotations_add_up_to_plain_bpe():
    import random

    # a small vocabulary of overlapping merges, each of tokens that stand side by side until then, as training makes them
    r = random.Random(6)
    merges = []

    def plain(word):
        """Merging by rank."""
        parts = [bytes([b]) for b in word]
        rank = {p: i for i, p in enumerate(merges)}
        while found := [rank[p] for p in zip(parts, parts[1:]) if p in rank]:
            pair, out, i = merges[min(found)], [], 0
            while i < len(parts):
                whole = tuple(parts[i : i + 2]) == pair
                out.append(b"".join(parts[i : i + 2]) if whole else parts[i])
                i += 1 + whole
            parts = out
        return parts

    while len(merges) < 60:
        parts = plain(bytes(r.choice(b"abc") for _ in range(30)))
        i = r.randrange(len(parts) - 1)
        if len(parts[i] + parts[i + 1]) <= 9 and len(plain(parts[i] + parts[i + 1])) == 2 and parts[i] + parts[i + 1] not in [a + b for a, b in merges]:
            merges.append((parts[i], parts[i + 1]))
    for most in (50, 10**6):
        lexicon = token_counts.Lexicon(merges, most)
        for _ in range(1500):
            word = bytes(r.choice(b"abc") for _ in range(r.randint(1, 40)))
            assert lexicon.count(word) == len(plain(word))


def test_chunk_maps_compose_to_the_sequential_run():
    import numpy as np

    rng = np.random.default_rng(1)
    for n in (0, 1, 5, 700):
        sym = rng.integers(0, 8, n).astype(np.uint8)
        if n:
            sym[0] += 8
        state, starts = token_counts.FRESH, []
        for i, s in enumerate(sym.tolist()):
            if token_counts.BEGINS[state * 16 + s]:
                starts.append(i)
            state = int(token_counts.STEP[state * 16 + s])
        for chunk in (1, 7, 256):
            assert token_counts.pretoken_starts(sym, chunk).tolist() == starts


URLS = [None, "", "no scheme", "http://EXAMPLE.com", "https://www.example.com/en/x?y#z", "http://a.example.com/en/", "http://example.com/en", "ftp://b.net/es/1", "http://b.net/fr/?q=/", "http://x.org?://y.com/", "http://notexample.com/en/", "://com/", "http://h.com#f/../en", "http://net/es/\nhttp://x.com"]
RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]


def brute_url(u):
    if "://" not in (u or ""):
        return "", "", None
    rest = u.split("://", 1)[1]
    host = re.split("[/?#]", rest, maxsplit=1)[0]
    path = re.split("[?#]", rest[len(host) :], maxsplit=1)[0]
    host = "".join(c.lower() if c.isascii() else c for c in host)
    fits = [r for _, r in RULES if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith("/" + r.split("/", 1)[1])]
    return host, path, max(fits, key=len, default=None)


def test_fixed_url_rules(spark):
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(URLS)], "page_id long, url string, tokens string")
    labels = spark.createDataFrame([], "page_id long, bad boolean")
    got = {r.page_id: r for r in url_rules.filter_urls(pages, labels, RULES).collect()}
    for i, u in enumerate(URLS):
        host, path, rule = brute_url(u)
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule), u
        assert got[i].verdict == (dict((r, v) for v, r in RULES)[rule] if rule else "allow")
    assert url_rules.filter_urls(pages.limit(0), labels, RULES).collect() == []


def test_mined_rules_block(spark):
    pages = spark.createDataFrame([(i, f"http://{'casino' if i % 4 == 0 else 'site'}{i % 3}.org/p{i % 5}/x") for i in range(200)], "page_id long, url string")
    labels = spark.createDataFrame([(i, i % 4 == 0) for i in range(0, 120)], "page_id long, bad boolean")
    got = {r.page_id: r.verdict for r in url_rules.filter_urls(pages, labels, RULES).collect()}
    assert all((v == "block") == (i % 4 == 0) for i, v in got.items())


def mined_by_brute_force(rows, least, confidence, lift):
    """Every combination of tokens, whatever its size, and the rules without a part as sure."""
    import itertools

    rate = sum(b for _, b in rows) / len(rows)
    held = Counter(c for t, b in rows for n in range(1, len(t) + 1) for c in itertools.combinations(sorted(t), n))
    bad = Counter(c for t, b in rows if b for n in range(1, len(t) + 1) for c in itertools.combinations(sorted(t), n))
    rules = {c: bad[c] / held[c] for c in bad if bad[c] >= least and bad[c] / held[c] >= confidence and bad[c] / held[c] / rate >= lift}
    return rules, held, bad


def test_mining_equals_brute_force(spark):
    import random

    r = random.Random(3)
    rows = []
    for i in range(300):
        own = {x for x in "abcdef" if r.random() < 0.4} | ({"x", "y1", "z"} if r.random() < 0.3 else set())
        rows.append((own, {"a", "b"} <= own or ("x" in own and r.random() < 0.5) or r.random() < 0.05))
    rules, held, bad = mined_by_brute_force(rows, 8, 0.6, 1.5)
    df = spark.createDataFrame([(i, sorted(t), b) for i, (t, b) in enumerate(rows)], "row long, tokens array<string>, bad boolean")
    got = url_rules.combinations(df, 8)
    found = {tuple(x["items"]): (x.bad, x.n) for x in got.collect()}
    # of x, y1 and z, which always go together, the first shortest stands for all
    want = {c: (bad[c], held[c]) for c in bad if bad[c] >= 8 and not {"y1", "z"} & set(c)}
    assert found == want == {tuple(x["items"]): (x.bad, x.n) for x in url_rules.combinations(df, 8, most_sent=0).collect()}
    mined = url_rules.prune(got.where("confidence >= 0.6 and lift >= 1.5"))
    assert (("a", "b"), 1.0) in [(t, round(c, 9)) for t, c in mined] and all(not (set(a) < set(b) and ca >= cb) for a, ca in mined for b, cb in mined)
    fires = lambda t, known: max((c for k, c in known if set(k) <= t), default=0.0)
    assert all(fires(t, mined) == pytest.approx(fires(t, [(k, c) for k, c in rules.items()])) for t, _ in rows)


@pytest.mark.parametrize("max_rules", [1, 1000])
def test_verdicts_of_repeated_and_contradicting_rows(spark, max_rules):
    urls = [f"http://{'bad' if i % 4 == 1 else 'good'}{i % 3}.org/{'a' if i % 3 else 'b'}/{i}" for i in range(120)]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)] + [(1, urls[1]), (None, urls[1]), (None, None)], "page_id long, url string")
    labels = spark.createDataFrame([(i, i % 4 == 1) for i in range(120)] + [(0, True), (0, None), (None, True)], "page_id long, bad boolean")
    got = url_rules.filter_urls(pages, labels, RULES, max_rules=max_rules).collect()
    assert len(got) == 123
    assert all((x.verdict == "block") == x.host.startswith("bad") for x in got)


def test_labels_come_from_the_document_that_a_page_shows(spark):
    from glossmill.llm.queries import page_labels

    pages = spark.createDataFrame([(1, "http://a.com/en/7.html"), (2, "http://a.com/en/8/?page=9"), (3, "http://a.com/en/x"), (4, None), (5, "https://a.com/de/7#top"), (6, "http://a.com/en/12x")], "page_id long, url string")
    labels = spark.createDataFrame([(7, 0, 0), (8, 1, 0), (9, 0, 1), (12, 0, 0)], "doc_id long, quality int, toxic int")
    assert {(r.page_id, r.bad) for r in page_labels(pages, labels).collect()} == {(1, True), (2, False), (5, True)}


def test_inverted_index_finds_what_a_scan_finds():
    rules = [(("a", "b"), 0.9), (("c",), 0.7), (("a", "d"), 0.8)]
    index = url_rules.invert(rules)
    assert sum(map(len, index.values())) == 3
    for own in ({"a", "b"}, {"c", "a"}, {"d"}, {"a", "d", "b"}):
        scan = {c for t, c in rules if set(t) <= own}
        assert {c for t in own for need, c in index.get(t, ()) if need <= own} == scan
