"""Alignment against whole-text encodings by both libraries, and the monoid's laws."""

import hashlib
import random
from collections import Counter
from functools import reduce

import pytest

from leadloom.llm import alignment
from leadloom.llm.alignment import Closed, Fragment, Tokens
from leadloom.llm.queries import BYTE_BPE, PIECE_BPE

TEXTS = [
    "", None, " ", "the cat sat on it's mat", "a\n\n  b\tc ", "x\r\ny;\r\n\r\n z\r", "it's I'LL don't x\x1cy \x85z　w", "Ünïcödé 字漢字 🙂 naïve", "▁ inside", "a <s> b</s> <0x0A> <|endoftext|>",
    "word " * 400, "nospace" * 300, "a1b2-c3!!" * 200, "字漢。かな" * 150, " lead  trail  ", "\n".join(f"line {k}: value={k * k};" for k in range(300)), "\x00\x01 nul", "é" * 700, "1234567890" * 90, "tab\tsep\tvalues\n" * 80,
]


def wanted(texts):
    """Groups by encoding each whole text at once and walking over all its bytes."""
    al = alignment.Aligner.of(BYTE_BPE, PIECE_BPE)
    docs, links = [], Counter()
    for text in texts:
        if not text:
            docs.append(None)
            continue
        whole = (" " + text).encode()
        a, b = al.a.encode(" " + text, add_special_tokens=False).ids, al.b.encode(text)
        if b"".join(al.a_bytes[x] for x in a) != whole or b"".join(al.b_bytes[x] for x in b) != whole:
            docs.append(None)
            continue
        of = []
        for ids, size in ((a, lambda x: len(al.a_bytes[x])), (b, lambda x: len(al.b_bytes[x]))):
            of.append([k for k, x in enumerate(ids) for _ in range(size(x))])
        pairs = sorted(set(zip(*of, strict=True)))
        ends = [{k for k in range(1, len(whole) + 1) if k == len(whole) or o[k] != o[k - 1]} for o in of]
        cuts = sorted(ends[0] & ends[1])
        groups = []
        for x, y in zip([0, *cuts], cuts, strict=False):
            groups.append("|".join(",".join(str(ids[k]) for k in dict.fromkeys(o[x:y])) for ids, o in zip((a, b), of, strict=True)))
        found = [(a[i], b[j]) for i, j in pairs]
        links.update(found)
        docs.append((len(a), len(b), len(groups), found, ";".join(groups)))
    most = {}
    for (_, y), n in links.items():
        most[y] = max(most.get(y, 0), n)
    out = []
    for d in docs:
        if d is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
        else:
            a, b, groups, found, text = d
            out.append((a, b, groups, len(found), sum(links[p] == most[p[1]] for p in found), sum(links[p] for p in found), hashlib.sha256(text.encode()).hexdigest()))
    return out


def rows(df):
    return sorted([(r.doc_id, (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256)) for r in df.collect()], key=str)


SCHEMA = "doc_id long, text string, n_a int, copies string, digest long, state int"


@pytest.mark.parametrize(("chunk", "fan", "hot"), [(1 << 15, 16, 1 << 17), (40, 2, 50), (7, 3, 1 << 17)])
def test_alignment_equals_whole_encodings(spark, chunk, fan, hot):
    """In one chunk, and in so small ones that words, runs and tokens lie across them; with few and all pairs frequent."""
    texts = [*TEXTS, "word " * 400, "the cat sat on it's mat"]
    ids = [*range(len(TEXTS)), 10, None]
    docs = spark.createDataFrame([(i, t, 1, "x", 2, 3) for i, t in zip(ids, texts, strict=True)], SCHEMA).repartition(3)
    found = alignment.align(docs, BYTE_BPE, PIECE_BPE, chunk=chunk, fan=fan, hot=hot)
    assert rows(found) == sorted(zip(ids, wanted(texts), strict=True), key=str)


def test_empty_table(spark):
    assert alignment.align(spark.createDataFrame([], SCHEMA), BYTE_BPE, PIECE_BPE).count() == 0


def test_chunks_compose_to_the_whole():
    al, rng = alignment.Aligner.of(BYTE_BPE, PIECE_BPE), random.Random(5)
    bits = ["the", "ing", " ", " ", "\n", "\r\n", "x1", "it's", "é", "字", "。", "🙂", "!!", "\t", "  ", "<s>", "0x", "Zürich", "'", ";"]
    for _ in range(120):
        text = " " + "".join(rng.choice(bits) for _ in range(rng.randint(1, 120)))
        whole = al.run(al.unit.findall(text), 0, 1).whole()
        for size in (3, 10, 31):
            parts = [al.fragment(*x) if x[0] else Fragment() for x in al.chunks(text, size)]
            found = reduce(Fragment.__add__, parts, Fragment()).whole()
            assert (found.groups, found.n_a, found.n_b, found.n_groups) == (whole.groups, whole.n_a, whole.n_b, whole.n_groups)
            assert found.codes.tolist() == whole.codes.tolist() and found.counts.tolist() == whole.counts.tolist()


def state(f):
    closed: Closed = f.closed
    return f.prefix, f.first, closed.groups, closed.n_a, closed.n_b, closed.codes.tolist(), closed.counts.tolist(), f.last, f.suffix, f.same


def test_monoid_laws():
    rng = random.Random(6)
    for _ in range(300):
        cuts = sorted(rng.sample(range(1, 60), 12))
        a, b = (sorted(rng.sample(cuts, 8)) for _ in range(2))
        tokens = [Tokens([k % 5 for k in a], a, [k % 7 for k in b], b)]
        for at in sorted(rng.sample(range(1, 60), 3)):
            last = tokens.pop()
            for keep in (lambda x, at=at: x <= at, lambda x, at=at: x > at):
                i, j = ([k for k, x in enumerate(e) if keep(x)] for e in (last.a_ends, last.b_ends))
                tokens.append(Tokens([last.a[k] for k in i], [last.a_ends[k] for k in i], [last.b[k] for k in j], [last.b_ends[k] for k in j]))
        w, x, y, z = map(Fragment.of, tokens)
        assert state((w + x) + (y + z)) == state(w + (x + (y + z))) == state(((w + x) + y) + z) == state(Fragment.of(reduce(Tokens.__add__, tokens)))
        assert state(w + Fragment()) == state(w) == state(Fragment() + w)
