import hashlib
import re

from matricula.llm import pii, queries
from tests.conftest import SF

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(value):
    digits = [int(c) for c in value if c.isdigit()]
    doubled = [d if i % 2 == 0 else 2 * d - 9 * (d > 4) for i, d in enumerate(reversed(digits))]
    return 13 <= len(digits) <= 19 and sum(doubled) % 10 == 0


VALID = {
    "email": lambda v: True,
    "ip": lambda v: all(int(x) <= 255 for x in v.split(".")),
    "card": luhn,
    "phone": lambda v: 9 <= sum(c.isdigit() for c in v) <= 15,
}


def expected(text):
    out, counts = [], []
    for kind, pattern in BASE.items():
        found = [m for m in re.finditer(pattern, text or "", re.ASCII) if VALID[kind](m[0])]
        counts.append(len(found))
        out += [f"{kind}:{m.start()}:{m.end()}" for m in found]
    return (*counts, hashlib.sha256(",".join(out).encode()).hexdigest()), ",".join(out)


def same(docs, rows):
    want = sorted((d, *expected(t)[0]) for d, t in docs)
    assert sorted((r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in rows) == want


def test_query(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    same(docs, queries.op5_pii(spark, SF).collect())


TRICKY = [
    "a@b.c@d.e x_a@b.com_q@r.st foo@bar @x.y a@b..c a@-.-",
    "1.2.3.4.5.6.7.8 256.1.1.1 0000255.1.2.3 1.2.3 1..2.3.4 99999999999.1.1.1",
    "4111 1111 1111 1111 4111-1111-1111-1112 4111  1111 1111 1111 41111111111111114111",
    "+1 (415) 555-0100 +1( +12 ++12345678901 +1234567890123456 +49 30 1234567.",
    "é😀 mail: x@y.zz 😀+1 202 555 0170",
    "IBAN GB82 WEST 1234 5698 7654 32 and GB82 WEST 1234 5698 7654 33, DE89370400440532013000",
    "9" * 30000,
    "1 " * 20000,
    "a." * 20000 + "@",
    "x@" + "y." * 9000 + "z",
    "+1" + " (" * 20000,
    " ".join(f"u{i}@host{i % 7}.org, 10.0.{i % 300}.1;" for i in range(16_000)),
]


def test_tricky_texts(spark):
    docs = list(enumerate(TRICKY))
    rows = pii.report(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    same(docs, rows)
    by_id = {r.doc_id: r for r in rows}
    assert by_id[5].spans.count("iban") == 2
    assert "iban:5:32" in by_id[5].spans and ":0.90" in by_id[5].scores
    for k, text in docs:
        assert by_id[k].spans.startswith(expected(text)[1])


def test_odd_rows_and_redaction(spark, odd_docs, no_docs):
    same([(r.doc_id, r.text) for r in odd_docs.collect()], pii.report(odd_docs).collect())
    assert pii.report(no_docs).collect() == []
    out = pii.redact(spark.createDataFrame([(1, "mail x@y.zz or 1.2.3.4!", "k"), (2, None, "k")], "doc_id long, text string, spans string")).orderBy("doc_id").collect()
    assert [r.text for r in out] == ["mail <email> or <ip>!", None]
    assert pii.redact(odd_docs).count() == odd_docs.count()


def test_whole_words_nearby_decide(spark):
    texts = ["the login host is 10.0.0.1 here", "shipped hotels 10.0.0.1 repay", "call +1 202 555 0170", "total +1 202 555 0170"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    scores = {r.doc_id: r.scores for r in pii.report(docs).collect()}
    assert [scores[i].split(":")[-1] for i in range(4)] == ["0.70", "0.60", "0.80", "0.70"]
    out = [r.text for r in pii.redact(docs, 0.7).orderBy("doc_id").collect()]
    assert out == ["the login host is <ip> here", texts[1], "call <phone>", "total <phone>"]
    assert [r.text for r in pii.redact(docs, 2.0).orderBy("doc_id").collect()] == texts


def test_ibans_among_capitals(spark):
    texts = ["iban GB82WEST12345698765432 OK", "GB82 WEST 1234 5698 7654 32 AND MORE", "GB82WEST12345698765432 DE89370400440532013000 X", "GB82WEST123456987654321", "GB00WEST12345698765432", "XX82WEST12345698765432"]
    rows = {r.doc_id: r.spans for r in pii.report(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [rows[i] for i in range(6)] == ["iban:5:27", "iban:0:27", "iban:0:22,iban:23:45", "", "", ""]


def test_redaction_with_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "mail x@y.zz", "kept", 3)], "doc_id long, text string, __email string, __IBAN int")
    assert [tuple(r) for r in pii.redact(docs).collect()] == [(1, "mail <email>", "kept", 3)]
