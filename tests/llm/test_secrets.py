import hashlib
import re

from pyspark.sql import functions as F

from tarmac.llm.secrets import RULES, joined, op8_secrets, redacted, scanned, trigram_query


def brute(text):
    text = text or ""
    found = []
    for i, r in enumerate(RULES):
        for m in re.finditer(r.regex, text):
            if len(m.group(r.counted)) >= r.least:
                found.append((m.start(), i, m.end()))
    return sorted(found)


TEXTS = [
    None,
    "",
    "token = abcdefgh1 é token: short",
    'é𝄞 PassWord" = "abc.def/ghi=" passwd:xxxxxxxx',
    "token=token=abcdefghij api_key=0123456789 APIKEY : '12345678'",
    "AKIA" + "A" * 12 + " AKIAAKIA1 " + "0" * 31 + "g" + "a" * 32 + "AKIAZZZZZZZZZZZZ",
    "ghp_" + "a" * 36 + " xoxb-1234567890123456 -----BEGIN RSA PRIVATE KEY-----",
    ("secret: " + "deadbeef" * 5 + " ") * 3000,
    "tok oken ecr api key sec",
    "AKIA" + "A" * 12 + " AKIAAKIA1 " + "0" * 31 + "g" + "a" * 32 + "AKIAZZZZZZZZZZZZ",
]


def test_trigram_queries():
    assert trigram_query(r"[0-9a-f]+") is None
    assert trigram_query("AKIA[A-Z0-9]+") == [frozenset({"aki", "kia"})]
    assert frozenset({"tok", "oke", "ken"}) in trigram_query(RULES[0].regex)
    for r in RULES:
        asked = trigram_query(r.regex)
        for text in TEXTS:
            for m in re.finditer(r.regex, text or ""):
                assert asked is None or any(all(t in m.group().lower() for t in c) for c in asked)


def test_spans_match_brute_force(spark):
    rows = [(i, t, "x") for i, t in enumerate(TEXTS)] + [(None, TEXTS[4], "x"), (3, TEXTS[6], "y"), (3, TEXTS[6], "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, rules string").withColumn("posted", F.lit(1))
    got = scanned(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        assert [tuple(s) for s in r.secret_spans] == brute(r.text), r.doc_id
    assert scanned(docs.limit(0)).count() == 0


def test_redaction_leaves_no_secret(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    for r in redacted(docs).collect():
        assert not brute(r.text)
        if not brute(TEXTS[r.doc_id]):
            assert r.text == TEXTS[r.doc_id]


def test_query(spark, sf):
    got = {r.doc_id: r for r in op8_secrets(spark, sf).collect()}
    for d in spark.read.parquet(f"{sf}/documents.parquet").collect():
        all_spans, r = brute(d.text), got[d.doc_id]
        say = lambda x: ",".join(f"{RULES[k].kind}:{s}:{e}" for s, k, e in x)
        assert r.spans == say(all_spans)
        assert r.base_sha256 == hashlib.sha256(say([x for x in all_spans if x[1] < 3]).encode()).hexdigest()
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(x[1] == k for x in all_spans) for k in range(3)]


def test_a_text_of_more_than_a_megabyte(spark):
    """Secrets at the start, at the end and every few thousand characters between."""
    filler = "wörd und mehr, 12 ab " * 200
    text = "token=abcdefgh123 " + "".join(f"{filler}password: geheim{i:04d}x AKIA{'B' * 16} " for i in range(260)) + "f" * 40
    assert len(text) > 1 << 20
    docs = spark.createDataFrame([(1, text), (None, text), (None, "token=abcdefgh123"), (None, "none here")], "doc_id long, text string")
    got = scanned(docs).collect()
    assert sorted(len(r.secret_spans) for r in got) == sorted(len(brute(t)) for t in (text, text, "token=abcdefgh123", "none here"))
    assert all([tuple(s) for s in r.secret_spans] == brute(r.text) for r in got)
    assert all(not brute(r.text) for r in redacted(docs).collect())
