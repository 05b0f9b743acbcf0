"""Personal data: patterns propose spans, checksums confirm them, words nearby adjust their score.

Base kinds (always reported): email; ip with parts up to 255; card, 16 to 19 digits that pass Luhn;
phone in international form with 8 to 15 digits. Added kinds, where no base span lies: iban (cut by its country's
length, mod 97), card of 13 to 15 digits that passes Luhn (the shortest head of whole digit groups), phone in national form, and nin (three groups of 3, 2 and 4
digits). A span's score is its pattern's prior, plus what its checksum adds, plus CONTEXT for a fitting
word within NEARBY characters before it or half of that after it; added spans need a score of THRESHOLD.

All scans are linear in the text: patterns either start at a rare character or can't start within a
run that they have refused. Cases: null and empty texts have no spans; texts are read whole; offsets
are code points, ends exclusive; repeated rows are treated alike; an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
IBAN_HEAD = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?= ?[A-Z0-9])")
NATIONAL = re.compile(r"(?<![0-9+])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])")
NIN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
DIGIT, DIGITS = re.compile(r"[0-9]"), re.compile(r"[0-9]+")

# Characters of an account number by its country (ISO 13616).
IBAN_LENGTHS = dict(
    x.split()
    for x in (
        "AD 24,AE 23,AL 28,AT 20,AZ 28,BA 20,BE 16,BG 22,BH 22,BI 27,BR 29,BY 28,CH 21,CR 22,CY 28,CZ 24,DE 22,DJ 27,DK 18,DO 28,EE 20,EG 29,ES 24,FI 18,FK 18,FO 18,FR 27,GB 22,GE 22,GI 23,GL 18,GR 27,GT 28,HR 21,HU 28,IE 22,"
        "IL 23,IQ 23,IS 26,IT 27,JO 30,KW 30,KZ 20,LB 28,LC 32,LI 21,LT 20,LU 20,LV 21,LY 25,MC 27,MD 24,ME 22,MK 19,MN 20,MR 27,MT 31,MU 30,NI 28,NL 18,NO 15,OM 23,PK 24,PL 28,PS 29,PT 25,QA 29,RO 24,RS 22,RU 33,SA 24,SC 31,"
        "SD 18,SE 24,SI 19,SK 24,SM 27,SO 23,ST 25,SV 28,TL 23,TN 24,TR 26,UA 29,VA 22,VG 24,XK 20,YE 30"
    ).split(",")
)
IBAN_BODY = {country: re.compile(rf"(?: ?[A-Z0-9]){{{int(n) - 4}}}(?![A-Za-z0-9])") for country, n in IBAN_LENGTHS.items()}

KINDS = ("email", "ip", "card", "phone", "iban", "nin")
PRIOR = {"email": 0.6, "ip": 0.5, "card": 0.2, "phone": 0.4, "iban": 0.2, "nin": 0.3}
CHECKED, CONTEXT, NEARBY, THRESHOLD = 0.4, 0.3, 60, 0.6
#: Words that speak for a kind.
WORDS = {
    "email": ("mail", "contact", "correo", "courriel"),
    "ip": ("ip", "host", "server", "address", "adresse"),
    "card": ("card", "visa", "mastercard", "amex", "credit", "debit", "carte", "karte", "tarjeta"),
    "phone": ("phone", "tel", "call", "mobile", "fax", "telefon", "téléphone", "teléfono", "handy"),
    "iban": ("iban", "bank", "account", "konto", "compte", "cuenta"),
    "nin": ("ssn", "social", "security", "insurance", "tax"),
}
NEAR = {kind: re.compile(r"\b(?:" + "|".join(words) + r")\b", re.IGNORECASE) for kind, words in WORDS.items()}


def luhn(digits: str) -> bool:
    """The card checksum: every second digit from the right is doubled."""
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(2 * int(d) - 9 * (d > "4") for d in even)) % 10 == 0


def mod97(code: str) -> bool:
    """The account-number checksum: the first four characters go to the end, letters count from 10."""
    return int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1


def only_digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Each at sign takes all local characters before it, back to the last match, if a domain follows."""
    free, at = 0, text.find("@")
    while at >= 0:
        before = text[free:at]
        start = free + len(before.rstrip(LOCAL))
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            free = m.end()
            at = text.find("@", free)
        else:
            free = at + 1  # an at sign is no local character
            at = text.find("@", free)


def ibans(text: str) -> Iterator[tuple[int, int]]:
    """Account numbers as long as their country has them, whatever word or number follows."""
    free = 0
    for m in IBAN_HEAD.finditer(text):
        body = IBAN_BODY.get(m[0][:2])
        found = body.match(text, m.end()) if body and m.start() >= free else None
        if found and mod97(text[m.start() : found.end()].replace(" ", "")):
            yield m.start(), found.end()
            free = found.end()


def short_cards(text: str) -> Iterator[tuple[int, int]]:
    """Card numbers of 13 to 15 digits: of a run of digit groups the shortest head of whole groups that passes."""
    for m in CARD.finditer(text):
        if m.end() - m.start() < 13 or (16 <= len(d := only_digits(m[0])) <= 19 and luhn(d)):
            continue
        digits = ""
        for g in DIGITS.finditer(m[0]):
            digits += g[0]
            if len(digits) > 15:
                break
            if len(digits) >= 13 and luhn(digits):
                yield m.start(), m.start() + g.end()
                break


def base_spans(text: str) -> list[tuple[str, int, int]]:
    out = [("email", s, e) for s, e in emails(text)] if "@" in text else []
    if DIGIT.search(text):
        if "." in text:
            out += [("ip", *m.span()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
        out += [("card", *m.span()) for m in CARD.finditer(text) if m.end() - m.start() >= 16 and 16 <= len(d := only_digits(m[0])) <= 19 and luhn(d)]
        if "+" in text:
            out += [("phone", *m.span()) for m in PHONE.finditer(text) if 8 <= len(only_digits(m[0])) <= 15]
    return out


def score(text: str, kind: str, start: int, end: int, checked: bool) -> float:
    nearby = text[max(0, start - NEARBY) : start] + " " + text[end : end + NEARBY // 2]
    return round(min(1.0, PRIOR[kind] + CHECKED * checked + CONTEXT * bool(NEAR[kind].search(nearby))), 2)


def spans(text: str) -> list[tuple[str, int, int, float, bool]]:
    """(kind, start, end, score, base) of a text, by kind, then start."""
    base = base_spans(text)
    out = [(k, s, e, score(text, k, s, e, k == "card"), True) for k, s, e in base]
    if DIGIT.search(text):
        taken = sorted((s, e) for _, s, e in base)
        proposed = [("iban", *x, True) for x in ibans(text)] + [("card", *x, True) for x in short_cards(text)]
        proposed += [("nin", *m.span(), False) for m in NIN.finditer(text)]
        proposed += [("phone", *m.span(), False) for m in NATIONAL.finditer(text)]
        at = 0
        for kind, s, e, checked in sorted(proposed, key=lambda x: (x[1], KINDS.index(x[0]))):
            while at < len(taken) and taken[at][1] <= s:
                at += 1
            if at < len(taken) and taken[at][0] < e or (p := score(text, kind, s, e, checked)) < (THRESHOLD if kind != "card" else THRESHOLD + 0.1):
                continue
            out.append((kind, s, e, p, False))
            taken.insert(at, (s, e))
    return sorted(out, key=lambda x: (KINDS.index(x[0]), x[1]))


FOUND = "array<struct<kind:string,start:long,end:long,score:double,base:boolean>>"


def find(docs: DataFrame) -> DataFrame:
    """doc_id and spans of every document."""
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64()), ("base", pa.bool_())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[dict(zip(("kind", "start", "end", "score", "base"), x, strict=True)) for x in spans(t.as_py() or "")] for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, kind)], ["doc_id", "spans"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id long, spans {FOUND}")


def digests(docs: DataFrame) -> DataFrame:
    """The counts of base spans, their digest, and all spans as text."""
    told = lambda a: F.array_join(F.transform(a, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    base = F.filter("spans", lambda x: x["base"])

    def count(kind: str):
        return F.size(F.filter(base, lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(kind) for kind in ("email", "ip", "card", "phone")]
    return find(docs).select("doc_id", *counts, F.sha2(told(base), 256).alias("base_sha256"), told(F.col("spans")).alias("spans"))
