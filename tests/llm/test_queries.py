"""The registered queries themselves, on the driver's smallest tables: columns and digests against plain versions."""

import hashlib
import zlib
from pathlib import Path

import pytest

from glossmill.llm.oracle import ORACLE_SQL
from glossmill.llm.queries import QUERIES, URL_RULES

from .test_corpus_operators import brute_fingerprint, brute_leaks, union_find
from .test_text_operators import base_spans, brute_quality, brute_url

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no driver tables here")


@pytest.fixture(scope="module")
def docs(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}


def rows(spark, name, columns):
    out = QUERIES[name](spark, str(DATA))
    assert out.columns[: len(columns)] == columns
    return out.collect()


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_its_oracle(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{DATA}/documents.parquet'")
    want, got = con.sql(ORACLE_SQL[name]).df(), QUERIES[name](spark, str(DATA)).toPandas()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    plain = lambda f: sorted(map(repr, f[columns].astype(object).itertuples(index=False, name=None)))
    assert plain(got) == plain(want)


def test_op1(spark, docs):
    got = rows(spark, "op1_pii", ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"])
    assert len(got) == len(docs)
    for r in got:
        spans = base_spans(docs[r.doc_id])
        said = ",".join(f"{k}:{s}:{e}" for k, s, e in spans)
        assert r.base_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == x for k, *_ in spans) for x in ("email", "ip", "card", "phone")]
        assert set(filter(None, said.split(","))) <= set(r.spans.split(","))


def test_op2(spark, docs):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    some = {r.doc_id for r in QUERIES["op2_decontaminate"](spark, str(DATA)).collect()}
    # brute force is slow: the documents found, and the shortest of the others
    checked = sorted(docs, key=lambda d: (d not in some, len(docs[d])))[: len(some) + 25]
    want = brute_leaks([(d, docs[d][:4000] if d not in some else docs[d]) for d in checked if len(docs[d]) < 4000], items, 5, 0.8)
    got = {(r.doc_id, r.item_id) for r in rows(spark, "op2_decontaminate", ["doc_id", "item_id", "similarity"])}
    assert {p for p in got if p[0] in checked and len(docs[p[0]]) < 4000} == want


def test_op3(spark, docs):
    prints = {d: brute_fingerprint(t) for d, t in docs.items()}
    ids = sorted(docs)
    want = union_find(ids, [(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if (prints[a] ^ prints[b]).bit_count() <= 3])
    got = rows(spark, "op3_simhash_dedup", ["doc_id", "fingerprint", "component_id"])
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got} == {d: (f"{prints[d]:016x}", want[d]) for d in ids}


def test_op5(spark):
    urls = {r.page_id: r.url for r in spark.read.parquet(f"{DATA}/pages.parquet").collect()}
    got = rows(spark, "op5_url_rules", ["page_id", "host", "path", "rule", "verdict"])
    assert len(got) == len(urls)
    verdict = {rule: v for v, rule in URL_RULES}
    for r in got:
        assert (r.host, r.path, r.rule) == brute_url(urls[r.page_id])
        assert r.verdict == verdict[r.rule] if r.rule else r.verdict in ("allow", "block")


def test_op6(spark, docs):
    tokenizers, public = pytest.importorskip("tokenizers"), pytest.importorskip("public_tokenizers")
    library = tokenizers.Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    for r in rows(spark, "op6_token_counts", ["doc_id", "n_bytes", "n_tokens", "over_limit"]):
        n = len(library.encode(docs[r.doc_id], add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(docs[r.doc_id].encode()), n, n > 1024)


def test_op7(spark, docs):
    for r in rows(spark, "op7_quality", ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]):
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute_quality(docs[r.doc_id])
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) and not (r.kept and r.base_failed)


def test_op8(spark, docs):
    got = rows(spark, "op8_toxicity", ["doc_id", "held_out", "score", "predicted"])
    assert len(got) == len(docs)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)


def test_op10(spark, docs):
    tokens = {d: len(t.encode().split()) for d, t in docs.items()}
    got = rows(spark, "op10_mixing", ["doc_id", "domain", "lang", "source", "n_tokens", "copies"])
    assert all(r.n_tokens == tokens[r.doc_id] and 1 <= r.copies <= 4 for r in got)
    # leaves of a few documents each: prefixes end before the budgets do (test_mixing has the exact rows)
    assert 0 < sum(r.n_tokens * r.copies for r in got) <= 0.5 * sum(tokens.values())
