"""Personal data: the base kinds against the plain patterns, checksums, context, and long texts."""

import random
import re
import time

from leadloom.llm import pii

PLAIN = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def plain(text):
    def fits(kind, found):
        digits = re.sub("[^0-9]", "", found)
        return {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in found.split(".")), "card": 16 <= len(digits) <= 19 and pii.luhn(digits), "phone": 8 <= len(digits) <= 15}[kind]

    return [(kind, *m.span()) for kind, p in PLAIN.items() for m in p.finditer(text) if fits(kind, m[0])]


def test_base_spans_are_those_of_the_plain_patterns():
    rng = random.Random(1)
    bits = ["a", "@", ".", "1", "23", "256", " ", "-", "+", "(", ")", "b.c", "@x.y", "_", "%", "0", "é", "4111 1111 1111 1111", "1.2.3.4", "00000001", "٣"]
    for _ in range(20_000):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(0, 30)))
        assert pii.base_spans(text) == plain(text), text
        assert [x[:3] for x in pii.spans(text) if x[4]] == sorted(plain(text), key=lambda x: (pii.KINDS.index(x[0]), x[1]))


def test_checksums_and_context():
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112")
    assert pii.mod97("GB82WEST12345698765432") and not pii.mod97("GB82WEST12345698765433")
    kinds = lambda t: [(k, b) for k, _, _, _, b in pii.spans(t)]
    assert kinds("IBAN: GB82 WEST 1234 5698 7654 32") == [("iban", False)]
    for text in ("IBAN DE89 3704 0044 0532 0130 00 BIC COBADEFF", "IBAN DE89 3704 0044 0532 0130 00 2024 paid", "bank GB82 WEST 1234 5698 7654 32 OK", "konto DE89370400440532013000, DE89 3704 0044"):
        assert kinds(text) == [("iban", False)]
    assert kinds("IBAN DE89 3704 0044 0532 0130 01") == kinds("IBAN DE893704004405320130001") == kinds("IBAN ZZ82 WEST 1234 5698 7654 32") == []
    assert [(k, s, e) for k, s, e, _, _ in pii.spans("amex card 3782 822463 10005 2024 ok")] == [("card", 10, 27)]
    assert kinds("amex card 3782 822463 10005") == [("card", False)]
    assert kinds("code 3782 822463 10005") == []
    assert kinds("call (212) 555-0100 now") == [("phone", False)]
    assert kinds("row (212) 555-0100 now") == []
    assert kinds("ssn 123-45-6789") == [("nin", False)]
    alone, told = (pii.spans(t)[0][3] for t in ("4111111111111111", "visa 4111111111111111"))
    assert alone < told


def test_long_texts_take_linear_time():
    began = time.time()
    for x in ("a" * 300_000, "1" * 300_000, "1 " * 150_000, "@" * 300_000, "1." * 100_000, "+1" * 100_000, "a." * 150_000 + "@", "AB12 " * 50_000):
        pii.spans(x)
    assert time.time() - began < 20


def test_rows(spark):
    rows = [(1, None, 0), (2, "", 0), (3, "mail é.a@b.cd +1 (736) 555-2678", 0), (3, "mail é.a@b.cd +1 (736) 555-2678", 0), (None, "1.2.3.4", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans long")
    found = {(r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.spans) for r in pii.digests(docs).collect()}
    assert found == {(1, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, ""), (3, 1, 0, 0, 1, "email:6:13,phone:14:31"), (None, 0, 1, 0, 0, "ip:0:7")}
    assert pii.digests(docs).where("doc_id = 3").count() == 2
    assert pii.digests(docs.limit(0)).count() == 0
