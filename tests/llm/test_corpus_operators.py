"""Near duplicates, line dedup, decontamination, toxicity and the pipeline, against brute force."""

import random
from collections import Counter, defaultdict

import pytest
import xxhash
from pyspark.sql import functions as F

from glossmill.llm import decontaminate, line_dedup, simhash_dedup, toxicity
from glossmill.llm.components import components

TABLE = "doc_id long, text string, fp int, node int, key string, n_lines int"


def table(spark, rows):
    return spark.createDataFrame([(i, t, 1, 2, "k", 3) for i, t in rows], TABLE)


def prose(seed, n):
    r = random.Random(seed)
    return " ".join("".join(r.choice("aeioustrn") for _ in range(r.randint(2, 7))) for _ in range(n))


def union_find(nodes, links):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


def test_components(spark):
    links = [(i, i + 1) for i in range(100, 140)] + [(0, i) for i in range(1, 60, 3)] + [(7, 7), (5, 900), (900, 5)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "u long, v long")).collect()}
    want = union_find({x for p in links for x in p}, links)
    assert got == {k: v for k, v in want.items() if k != 7 or want[7] != 7}
    assert components(spark.createDataFrame([], "u long, v long")).collect() == []


def brute_fingerprint(t):
    w = "".join(c.lower() if c.isascii() else c for c in t or "").encode().split()
    shingles = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [b" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def near_rows():
    rows = []
    for s in range(12):
        words = prose(s, 150).split()
        for c in range(4):
            own = list(words)
            for k in range(c):
                own[(k * 53 + s) % 150] = f"new{k}"
            rows.append((len(rows), " ".join(own)))
    return rows + [(100, None), (101, ""), (102, " \n"), (103, "one"), (104, "One"), (105, rows[0][1]), (105, rows[0][1]), (106, "x " * 30_000)]


@pytest.mark.parametrize("most", [1000, 3])
def test_near_duplicates_equal_brute_force(spark, most):
    rows = near_rows()
    prints = {i: brute_fingerprint(t) for i, t in rows}
    ids = sorted(prints)
    want = union_find(ids, [(a, b) for a in ids for b in ids if a < b and (prints[a] ^ prints[b]).bit_count() <= 3])
    got = simhash_dedup.near_duplicates(table(spark, rows), 3, 3, most=most).collect()
    assert len(got) == len(rows)
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got} == {i: (f"{prints[i]:016x}", want[i]) for i in ids}


def test_near_duplicates_of_nothing_and_of_nulls(spark):
    assert simhash_dedup.near_duplicates(table(spark, [])).collect() == []
    got = simhash_dedup.near_duplicates(table(spark, [(None, "a b c d"), (3, "a b c d")])).collect()
    assert {(r.doc_id, r.component_id) for r in got} == {(None, None), (3, 3)}


def test_block_keys_meet_within_the_radius(spark):
    r = random.Random(5)
    rows = []
    for i in range(300):
        a = r.getrandbits(64)
        b = a
        for bit in r.sample(range(64), r.randint(0, 3)):
            b ^= 1 << bit
        rows.append((i, a - (1 << 64) * (a >> 63), b - (1 << 64) * (b >> 63)))
    df = spark.createDataFrame(rows, "i int, a long, b long")
    met = df.select(F.arrays_overlap(simhash_dedup.block_keys("a", 3), simhash_dedup.block_keys("b", 3)).alias("m"))
    assert met.where("not m").count() == 0


def test_bk_tree_finds_what_a_scan_finds():
    r = random.Random(2)
    tree, held = simhash_dedup.BKTree(), []
    for _ in range(400):
        v = r.getrandbits(12)
        assert sorted(tree.search_insert(v, 3)) == sorted(((x ^ v).bit_count(), k) for k, x in enumerate(held) if (x ^ v).bit_count() <= 3)
        held.append(v)


def test_similar_groups_are_verified(spark):
    rows = near_rows() + [(200 + i, prose(100 + i, 60)) for i in range(30)]
    sets = {}
    for i, t in rows:
        w = (t or "").lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    alike = lambda a, b: (not a and not b) or bool(a | b) and len(a & b) >= 0.8 * len(a | b)
    want = union_find(sorted(sets), [(a, b) for a in sets for b in sets if a < b and alike(sets[a], sets[b])])
    got = {r.doc_id: r.component_id for r in simhash_dedup.similar_groups(table(spark, rows)).collect()}
    assert got == want
    assert simhash_dedup.similar_groups(table(spark, [])).collect() == []


def brute_groups(rows, words=5, least=0.8):
    sets = {}
    for i, t in rows:
        w = t.split()
        sets[i] = {tuple(w[k : k + words]) for k in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)}
    return union_find(sorted(sets), [(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b])])


@pytest.mark.parametrize("most", [1000, 30])
def test_similar_groups_hold_families_at_the_threshold(spark, most):
    # most of the trees' tightest links fail here; pairs that they leave out hold the groups together
    r, rows = random.Random(1), []
    base = prose(900, 204).split()
    for c in range(100):
        own = list(base)
        for at in r.sample(range(5, 200), r.randint(2, 5)):
            own[at] = f"x{c}y{at}"
        rows.append((c, " ".join(own)))
    want = brute_groups(rows)
    assert len(set(want.values())) == 43
    got = {x.doc_id: x.component_id for x in simhash_dedup.similar_groups(table(spark, rows), most=most).collect()}
    assert got == want


def test_similar_groups_take_no_account_of_repeats(spark):
    # one shingle set, give or take the seams, with a line once and 40 times
    rows = []
    for c in range(10):
        line = prose(700 + c, 12)
        rows += [(2 * c, f"{prose(600 + c, 200)} {line} {line}"), (2 * c + 1, f"{prose(600 + c, 200)} {' '.join([line] * 40)}")]
    assert all(simhash_dedup.fingerprint(a[1], 5) != simhash_dedup.fingerprint(b[1], 5) for a, b in zip(rows[::2], rows[1::2]))
    got = {x.doc_id: x.component_id for x in simhash_dedup.similar_groups(table(spark, rows)).collect()}
    assert got == brute_groups(rows) == {i: i - i % 2 for i in range(20)}


def test_similar_groups_of_rows_that_share_a_doc_id(spark):
    # the rows of one doc_id are one document, which is near whatever any of them is near
    a, b, c = (prose(8000 + i, 90) for i in range(3))
    near = lambda t: " ".join(["changed", *t.split()[1:]])
    rows = [(5, a), (5, b), (5, b), (7, near(a)), (9, near(b)), (11, c), (None, a), (12, None), (13, ""), (14, near(c))]
    got = [(x.doc_id, x.component_id) for x in simhash_dedup.similar_groups(table(spark, rows)).collect()]
    assert sorted(got, key=str) == sorted([(5, 5)] * 3 + [(7, 5), (9, 5), (11, 11), (14, 11), (12, 12), (13, 12), (None, None)], key=str)


def test_similar_groups_hold_short_texts(spark):
    # 5 shingles against 4: a similarity of exactly 0.8, often over 16 bits apart
    rows = [(2 * c + k, " ".join(prose(3000 + c, 9).split()[: 9 - k])) for c in range(80) for k in (0, 1)]
    apart = [(simhash_dedup.fold(a) ^ simhash_dedup.fold(b)).bit_count() for a, b in ([simhash_dedup.shingle_hashes(t.encode(), 5) for _, t in rows[i : i + 2]] for i in range(0, 160, 2))]
    assert max(apart) > 16
    got = {x.doc_id: x.component_id for x in simhash_dedup.similar_groups(table(spark, rows)).collect()}
    assert got == brute_groups(rows) == {i: i - i % 2 for i in range(160)}


def brute_lines(rows, min_chars, min_docs):
    strip = " \t\n\x0b\x0c\r"
    key = lambda x: "".join(c.lower() if c.isascii() else c for c in x.strip(strip))
    held = defaultdict(set)
    for d, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= min_chars:
                held[key(line)].add(d)
    last = {k: max((d for d in ds if d is not None), default=None) for k, ds in held.items() if len(ds) >= min_docs}
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (key(x) in last and last[key(x)] != d)]
        out.append((d, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=str)


@pytest.mark.parametrize("broadcast_keys,batches", [(1000, 3), (0, 7)])
def test_lines_equal_brute_force(spark, broadcast_keys, batches):
    r = random.Random(9)
    pool = [("Ünïcode " if i % 3 else "") + f"shared line number {i} " + "x" * (12 + i) for i in range(12)]
    rows = []
    for d in range(80):
        lines = [r.choice(pool) if r.random() < 0.5 else f"own line {d} {k} " + "y" * 40 for k in range(r.randint(0, 6))]
        rows.append((d, "\n".join(x.upper() if r.random() < 0.2 and x.isascii() else f" \t{x}\r" if r.random() < 0.2 else x for x in lines)))
    rows += [(500, None), (501, ""), (502, "\n\n"), (7, rows[7][1]), (None, pool[5]), (None, pool[6]), (503, (pool[5] + "\n") * 2000)]
    out = line_dedup.dedup_lines(table(spark, rows), 40, 5, batches=batches, buckets=4, broadcast_keys=broadcast_keys)
    assert out.columns == ["doc_id", "fp", "node", "key", "kept_text", "n_lines", "n_dropped"]
    assert sorted(((x.doc_id, x.kept_text, x.n_lines, x.n_dropped) for x in out.collect()), key=str) == brute_lines(rows, 40, 5)


def test_line_runs_hold_each_key_once_and_compact(spark):
    runs = line_dedup.LineRuns(spark, 4, fanout=2)
    total = Counter()
    for b in range(5):
        keys = [(k, k * 2) for k in range(b * 3, b * 3 + 8)]
        total.update(keys)
        runs.add(spark.createDataFrame([(*k, 1, b) for k in keys], "hi long, lo long, n_docs long, last_doc long"))
    held = [(r.hi, r.lo) for run in runs.runs() for r in run.collect()]
    assert len(held) == len(set(held)) == len(total)
    assert all(len(level) < 2 for level in runs.levels)
    assert {(r.hi, r.lo): r.n_docs for r in runs.counts(2).collect()} == {k: n for k, n in total.items() if n >= 2}


def test_line_runs_stay_between_calls(spark, tmp_path):
    # one table in one call, and its parts one after the other with the index reopened each time
    r = random.Random(31)
    pool = [f"a shared line, the number of which is {i} " + "z" * 20 for i in range(8)]
    rows = [(d, "\n".join(r.choice(pool) for _ in range(r.randint(1, 4)))) for d in range(60)]
    root = f"file://{tmp_path}/index"
    index = line_dedup.LineRuns(spark, 3, fanout=2, root=root)
    for a in range(0, 60, 12):
        part = line_dedup.dedup_lines(table(spark, rows[a : a + 12]), 40, 5, batches=1, index=index)
        want = [x for x in brute_lines(rows[: a + 12], 40, 5) if a <= x[0] < a + 12]
        assert sorted(((x.doc_id, x.kept_text, x.n_lines, x.n_dropped) for x in part.collect()), key=str) == want
        for run in index.runs():  # as a new session finds it
            spark.sql(f"DROP TABLE IF EXISTS glossmill_scratch.{run._scratch.rpartition('/')[2]}")
        index = line_dedup.LineRuns.open(spark, root)
        assert index.batches == a // 12 + 1 and all(len(level) < 2 for level in index.levels)


def test_heavy_lines_are_sent_and_light_ones_joined(spark):
    heavy, rows = "the one line that is in every document of them all", []
    for d in range(60):
        rows.append((d, f"{heavy}\n{'light line number ' + str(d % 10) + ' of the ten that there are'}\nown {d}"))
    got = line_dedup.dedup_lines(table(spark, rows), 30, 5, broadcast_keys=3)
    assert sorted(((x.doc_id, x.kept_text, x.n_lines, x.n_dropped) for x in got.collect()), key=str) == brute_lines(rows, 30, 5)


def test_scratch_tables_are_dropped(spark):
    from glossmill.llm import _common

    before = len(_common._SCRATCH[spark.sparkContext.applicationId])
    line_dedup.dedup_lines(table(spark, [(i, "x" * 50) for i in range(9)])).collect()
    assert [p for p, _ in _common._SCRATCH[spark.sparkContext.applicationId][before:]] and len(_common._SCRATCH[spark.sparkContext.applicationId]) == before + 1
    _common.drop_scratch(spark)
    assert _common._SCRATCH[spark.sparkContext.applicationId] == []
    assert not [t for t in spark.catalog.listTables("default") if not t.isTemporary]


def test_lines_of_nothing(spark):
    assert line_dedup.dedup_lines(table(spark, [])).collect() == []


def brute_leaks(docs, items, k, least):
    plain = lambda t: "".join(c.lower() if c.isascii() and c.isalnum() else c if not c.isascii() else " " for c in t or "").encode().split()
    cut = lambda w, n: [tuple(w[i : i + n]) for i in range(len(w) - n + 1)]
    import math

    own = {i: plain(t) for i, t in items if plain(t)}
    bags = {i: Counter(cut(w, min(k, len(w)))) for i, w in own.items()}
    df = Counter(s for b in bags.values() for s in b)
    weight = lambda s: math.log1p(len(bags) / df[s]) if df[s] else math.log1p(len(bags))
    out = set()
    for d, t in docs:
        w = plain(t)
        for i, bag in bags.items():
            size = min(len(own[i]), len(w))
            for a in range(len(w) - size + 1 if w else 0):
                window = Counter(cut(w[a : a + size], min(k, size)))
                inner = sum(weight(s) * min(n, bag[s]) for s, n in window.items())
                whole = sum(weight(s) * n for s, n in window.items()) + sum(weight(s) * n for s, n in bag.items()) - inner
                if inner >= least * whole - 1e-12:
                    out.add((d, i))
    return out


def test_leaks_equal_brute_force(spark):
    items = [(i, prose(50 + i, n)) for i, n in enumerate([12, 30, 30, 45, 3, 60])] + [(90, None), (91, ""), (92, prose(51, 30))]
    docs = []
    for d in range(30):
        passage = (items[d % 6][1] or "").split()
        if d % 3 == 1:
            passage[len(passage) // 2] = "changed"
        if d % 5 == 4:
            passage = passage[: len(passage) // 2]
        docs.append((d, f"{prose(d, 20)}\n{' '.join(passage).upper() if d % 2 else ', '.join(passage)}.\n{prose(d + 500, 15)}"))
    docs += [(100, None), (101, ""), (102, "two words"), (3, docs[3][1]), (103, (items[1][1] + " ") * 40)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    for max_words in (10_000, 20):
        got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(table(spark, docs), bench, max_words=max_words).collect()}
        if max_words == 10_000:
            assert got == brute_leaks(docs, items, 5, 0.8)
        assert {(0, 0), (15, 3)} <= got
    assert decontaminate.contaminated(table(spark, []), bench).collect() == []
    assert decontaminate.contaminated(table(spark, docs), bench.limit(0)).collect() == []


def test_leaks_do_not_depend_on_the_parts(spark):
    # items share much with one another, so weights of one part alone would differ
    common = prose(1, 60).split()
    items = [(i, " ".join(prose(50 + i, 12).split() + common[(i * 3) % 30 :][: 20 + i % 3])) for i in range(24)]
    docs = []
    for d in range(48):
        words = items[d % 24][1].split()
        for at in (d % 3, -1 - d % 2)[: 1 + d % 2]:
            words[at] = f"changed{d}"
        docs.append((d, f"{prose(d + 900, 9)} {' '.join(words)} {prose(d + 990, 9)}"))
    bench = spark.createDataFrame(items, "item_id long, text string")
    whole, split = ({(r.doc_id, r.item_id): (r.similarity, r.first_word) for r in decontaminate.contaminated(table(spark, docs), bench, max_words=n).collect()} for n in (10_000, 200))
    assert set(whole) == brute_leaks(docs, items, 5, 0.8) and set(split) == set(whole)
    assert all(split[p] == (pytest.approx(whole[p][0]), whole[p][1]) for p in whole)


def test_leaks_over_sixteen_bits_apart_are_found(spark):
    import numpy as np

    items = [(i, prose(5000 + i, 50)) for i in range(400)]
    index = decontaminate.ItemIndex(items, 5, 16)
    docs = []
    for i, text in items:
        words = text.split()
        words[2] = f"changed{i}"
        words[-2] = f"other{i}"
        s = decontaminate.shingles(decontaminate.text_words(*decontaminate.text_buffer(decontaminate.pa.array([" ".join(words)], "large_string")))[0], 5)
        own = decontaminate.pack((decontaminate.signs(s) * index.weigh(s)[:, None]).sum(0, keepdims=True))[0]
        if int(np.bitwise_count(own ^ index.prints[i])) > 16:
            assert index.similarity(s, i) >= 0.8 and i not in index.match(decontaminate.text_words(*decontaminate.text_buffer(decontaminate.pa.array([" ".join(words)], "large_string")))[0], 0.8)
            docs.append((i, " ".join(words)))
    assert docs
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontaminate.contaminated(table(spark, docs), bench).collect()} == {(i, i) for i, _ in docs}


def test_multi_index_misses_none_within_the_radius():
    import numpy as np

    index = decontaminate.ItemIndex([(i, prose(i, 40)) for i in range(30)], 5, 16)
    group = index.groups[40]
    rng = np.random.default_rng(0)
    prints = group.prints[rng.integers(0, 30, 500)] ^ np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, (14, 500), dtype=np.uint64), axis=0)
    window, item = group.within(prints)
    brute = {(w, i) for w in range(500) for i in range(30) if int(prints[w] ^ group.prints[i]).bit_count() <= 16}
    assert set(zip(window.tolist(), item.tolist())) == brute


def test_prefix_buckets_lose_no_similar_pair():
    import numpy as np

    # items that share much; windows near and far; small pages, so that buckets are multi-indexes, and large ones
    items = []
    for i in range(90):
        own = prose(70 + i // 3, 40).split()
        if i % 3:
            own[(2, 37)[i % 3 - 1]] = f"x{i}"
        items.append((i, " ".join(own)))
    index = decontaminate.ItemIndex(items, 5, 64)
    words = lambda t: decontaminate.text_words(*decontaminate.text_buffer(decontaminate.pa.array([t], "large_string")))[0]
    r, text = random.Random(8), []
    for i in range(0, 90, 3):
        own = items[i][1].split()
        for _ in range(r.randint(0, 3)):
            own[r.randrange(40)] = f"y{r.random()}"
        text += own + prose(400 + i, 9).split()
    s = decontaminate.shingles(words(" ".join(text)), 5)
    n = 36
    brute = {(a, i) for a in range(len(s) - n + 1) for i in range(90) if index.similarity(s[a : a + n], i) >= 0.8}
    assert len(brute) > 20
    starts = np.arange(len(s) - n + 1)
    prints = np.array([decontaminate.pack((decontaminate.signs(s[a : a + n]) * index.weigh(s[a : a + n])[:, None]).sum(0, keepdims=True))[0] for a in starts], np.uint64)
    for page in (1, 64):
        group = decontaminate._Group(index, np.arange(90), page)
        row, item = group.candidates(s, starts, n, prints)
        assert brute <= set(zip(starts[row].tolist(), item.tolist())) and bool(group.large) == (page == 1)
        assert group.compared < 0.25 * len(starts) * 90


def toxic_rows():
    import zlib

    rows, labels = [], []
    for d in range(900):
        bad = d % 9 == 0
        words = prose(d, 40).split()
        if bad:
            words[3:3] = random.Random(d).sample(["vilest", "scoundrel", "wretch", "blackguard"], 2)
        rows.append((d, " ".join(words)))
        if d % 2 == 0:
            labels.append((d, 1, int(bad)))
    return rows, labels, lambda d: zlib.crc32(str(d).encode()) % 3 == 1


def test_toxicity_on_held_out_rows(spark):
    rows, labels, held = toxic_rows()
    out = toxicity.score_toxicity(table(spark, rows + [(5000, None), (5001, ""), (None, "x"), (5002, "y " * 30_000)]), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert out.columns == ["doc_id", "text", "fp", "node", "key", "n_lines", "held_out", "score", "predicted"]
    got = {r.doc_id: r for r in out.collect()}
    assert all(got[d].held_out == held(d) for d, _ in rows)
    bad = [got[d].predicted for d, _ in rows if held(d) and d % 9 == 0]
    good = [got[d].predicted for d, _ in rows if held(d) and d % 9]
    assert sum(bad) >= 0.9 * len(bad) and sum(good) <= 0.02 * len(good)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got.values())
    assert got[5000].score == got[5001].score and got[5000].predicted == 0


def test_held_out_labels_are_not_used(spark):
    rows, labels, held = toxic_rows()
    flipped = [(d, q, 1 - t if held(d) else t) for d, q, t in labels]
    score = lambda own: {r.doc_id: r.score for r in toxicity.score_toxicity(table(spark, rows), spark.createDataFrame(own, "doc_id long, quality int, toxic int")).collect()}
    assert score(labels) == score(flipped)


def test_toxicity_risk_and_slope_equal_plain_ones():
    import numpy as np

    rng = np.random.default_rng(4)
    positive = rng.random(60) < 0.4

    def plain(z, prior):
        """Kiryo et al., equation 6, term by term."""
        up, down = [float(np.log1p(np.exp(-x))) for x in z], [float(np.log1p(np.exp(x))) for x in z]
        mean = lambda v, mark: sum(x for x, p in zip(v, positive) if p == mark) / int((positive == mark).sum())
        negative = mean(down, False) - prior * mean(down, True)
        return (prior * mean(up, True) + negative if negative >= 0 else -negative), negative

    signs = set()
    for gap, prior in ((3.0, 0.2), (3.0, 0.5), (-3.0, 0.5), (0.0, 0.3)):
        z = rng.normal(np.where(positive, gap, -gap), 1.0)
        value, slope = toxicity.risk(z, positive, prior)
        want, negative = plain(z, prior)
        signs.add(negative >= 0)
        assert value == pytest.approx(want)
        for i in range(0, 60, 7):
            step = np.zeros(60)
            step[i] = 1e-5
            assert slope[i] == pytest.approx((plain(z + step, prior)[0] - plain(z - step, prior)[0]) / 2e-5, abs=1e-7)
    assert signs == {True, False}  # with and without the correction


def test_toxicity_learns_from_long_texts(spark):
    # the confirmed texts are all over 100,000 characters: what tells them apart is found all the same
    rows, labels = [], []
    for d in range(180):
        words = prose(d % 7, 16_000).split() if d % 3 == 0 else prose(d, 40).split()
        if d % 3 == 0:
            words[len(words) - 5] = "scoundrel"
        rows.append((d, " ".join(words)))
        labels.append((d, 1, int(d % 3 == 0)))
    rows += [(1000, "a scoundrel by name " + prose(5000, 40)), (1001, "nobody by name " + prose(5000, 40))]
    got = {r.doc_id: r.score for r in toxicity.score_toxicity(table(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).where("doc_id >= 1000").collect()}
    assert got[1000] > got[1001]


def test_toxicity_of_repeated_rows(spark):
    rows, labels, _ = toxic_rows()
    out = toxicity.score_toxicity(table(spark, rows + rows[:90]), spark.createDataFrame(labels + labels[:40] + [(0, 1, None)], "doc_id long, quality int, toxic int")).collect()
    scores = defaultdict(set)
    for r in out:
        scores[r.doc_id].add(r.score)
    assert len(out) == 990 and all(len(s) == 1 for s in scores.values())


def test_toxicity_without_examples(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r.predicted for r in toxicity.score_toxicity(table(spark, [(1, "a")]), none).collect()] == [0]
    assert toxicity.score_toxicity(table(spark, []), none).collect() == []


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    rows, labels, _ = toxic_rows()
    shared = "This line stands in a good many of the documents, word for word."
    rows = [(d, f"{shared}\n{t}" if d % 7 == 0 else t) for d, t in rows]
    item = prose(9999, 40)
    rows += [(2000, prose(1, 200)), (2001, prose(1, 200)), (2002, prose(1, 199)), (2003, f"{prose(3, 30)} {item} {prose(4, 30)}")]
    docs = spark.createDataFrame([(d, t, "en", f"src{d % 20}", len(t)) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    seen = {"": {d for d, _ in rows}}
    now = docs
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path / name)
        stage(spark, now, str(tmp_path)).write.parquet(path)
        now = spark.read.parquet(path)
        if name != "mixing":
            assert now.columns == corpus_pipeline.COLUMNS
        seen[name] = {r.doc_id for r in now.select("doc_id").collect()}
        if name == "line dedup":
            assert [r.doc_id for r in now.where(F.contains("text", F.lit(shared))).collect()] == [max(d for d in seen["toxicity"] if d % 7 == 0 and d < 900)]
            assert now.where("n_chars <> length(text)").count() == 0
    gone = seen[""] - seen["toxicity"]
    assert len([d for d in gone if d % 9 == 0]) >= 90 and len([d for d in gone if d % 9]) <= 18
    assert seen["toxicity"] == seen["line dedup"]
    assert {2001, 2002} <= seen["line dedup"] - seen["near dedup"] and 2000 in seen["near dedup"]
    assert seen["near dedup"] - seen["decontamination"] == {2003}
    assert now.columns == ["doc_id", "domain", "lang", "source", "n_tokens", "copies"] and seen["mixing"] <= seen["decontamination"]
    whole = {r.doc_id: r.copies for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert whole == {r.doc_id: r.copies for r in now.collect()}
