"""Cross-tokenizer alignment by an associative monoid of fragments.

Two tokenizers cut a text into tokens A and B. Where tokens of both end at one byte, a group ends. A fragment is what a byte range
of a text knows of its groups: an open prefix (the tokens up to its first common end, whose group may have begun before), the closed groups
in between, and an open suffix (the tokens behind its last common end). Two neighbouring fragments compose by grouping suffix and prefix
anew; that is associative and the empty fragment is its identity, so fragments can be composed in any bracketing.

Texts up to CHUNK characters are one fragment, made and closed in the task that reads them, without a shuffle. Longer texts are cut
at about every CHUNK characters, for each tokenizer at the next place that its merges can't cross. These places differ, so a
chunk's A and B tokens cover slightly different ranges. Chunks are dealt over tasks, encoded there, and their
fragments composed in a tree, FAN neighbours at a time, by one shuffle per level.

Within a fragment, both tokenizers always cut between a word and the white space behind it (but for white space that a piece of B's
vocabulary holds behind something else), so groups are kept per such word in a dictionary of bounded size.

An id pair's links are added up over the corpus by Spark. Pairs with at least 1 / HOT of all links, of which there can't be more than
HOT, are broadcast to the documents' pairs; all other pairs are joined by shuffle, and none of them is a hot key.

Cases: null and empty texts, and texts whose A or B bytes aren't those of space + text (U+2581 in the text, bytes that aren't UTF-8), have no
tokens: zeros and an empty groups_sha256. Special tokens' strings are plain text. Rows that repeat a doc_id count, each with its own text;
a null doc_id is an id like others. Texts are read whole; the longest run that no tokenizer cuts must fit a task. Ties for a B id's highest
count are all best. Columns besides doc_id and text aren't read. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import json
import os
import pickle
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadloom.llm.common import Memory, as_bytes, written

#: Characters of a chunk; fragments composed by one task of the tree.
CHUNK, FAN = 1 << 15, 16
#: Pairs with at least this share of all links are broadcast.
HOT = 1 << 17
#: Words whose groups a worker keeps at least.
KEPT_WORDS = 150_000


# --- the monoid ---------------------------------------------------------------------------------------------------


@dataclass
class Tokens:
    """Neighbouring tokens of both sides: ids, and the bytes of the text at which they end."""

    a: list[int] = field(default_factory=list)
    a_ends: list[int] = field(default_factory=list)
    b: list[int] = field(default_factory=list)
    b_ends: list[int] = field(default_factory=list)

    def __add__(self, other: Tokens) -> Tokens:
        return Tokens(self.a + other.a, self.a_ends + other.a_ends, self.b + other.b, self.b_ends + other.b_ends)

    def split(self) -> tuple[list[Tokens], Tokens]:
        """The groups up to each common end, and the tokens behind the last one."""
        out, i, j, i0, j0 = [], 0, 0, 0, 0
        while i < len(self.a) and j < len(self.b):
            x, y = self.a_ends[i], self.b_ends[j]
            i += x <= y
            j += y <= x
            if x == y:
                out.append(Tokens(self.a[i0:i], self.a_ends[i0:i], self.b[j0:j], self.b_ends[j0:j]))
                i0, j0 = i, j
        return out, Tokens(self.a[i0:], self.a_ends[i0:], self.b[j0:], self.b_ends[j0:])

    def linked(self) -> list[int]:
        """The tokens' links, as a << 32 | b, if they are one group: two tokens are linked if their bytes overlap."""
        out, i, j = [], 0, 0
        while i < len(self.a) and j < len(self.b):
            out.append(self.a[i] << 32 | self.b[j])
            x, y = self.a_ends[i], self.b_ends[j]
            i += x <= y
            j += y <= x
        return out

    def text(self) -> bytes:
        return f"{','.join(map(str, self.a))}|{','.join(map(str, self.b))}".encode()


@dataclass
class Closed:
    """Groups that are complete: their text, their numbers of tokens, and how often each pair is linked (sorted codes, counts)."""

    groups: bytes = b""
    n_a: int = 0
    n_b: int = 0
    n_groups: int = 0
    codes: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    counts: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))

    @staticmethod
    def of(groups: list[Tokens]) -> Closed:
        codes, counts = np.unique(np.array([x for g in groups for x in g.linked()], np.int64), return_counts=True)
        return Closed(b";".join(g.text() for g in groups), sum(len(g.a) for g in groups), sum(len(g.b) for g in groups), len(groups), codes, counts)

    def __add__(self, other: Closed) -> Closed:
        if not self.n_groups or not other.n_groups:
            return self if self.n_groups else other
        codes, at = np.unique(np.concatenate([self.codes, other.codes]), return_inverse=True)
        counts = np.zeros(len(codes), np.int64)
        np.add.at(counts, at, np.concatenate([self.counts, other.counts]))
        return Closed(self.groups + b";" + other.groups, self.n_a + other.n_a, self.n_b + other.n_b, self.n_groups + other.n_groups, codes, counts)


@dataclass
class Fragment:
    """first and last: the common ends known (None: there is none, and all tokens are in prefix). same: the tokens' bytes are the text's."""

    prefix: Tokens = field(default_factory=Tokens)
    first: int | None = None
    closed: Closed = field(default_factory=Closed)
    last: int | None = None
    suffix: Tokens = field(default_factory=Tokens)
    same: bool = True

    @staticmethod
    def of(tokens: Tokens, same: bool = True) -> Fragment:
        groups, rest = tokens.split()
        if not groups:
            return Fragment(tokens, same=same)
        return Fragment(groups[0], groups[0].a_ends[-1], Closed.of(groups[1:]), groups[-1].a_ends[-1], rest, same)

    def __add__(self, other: Fragment) -> Fragment:
        same = self.same and other.same
        middle = Fragment.of((self.prefix if self.first is None else self.suffix) + other.prefix)
        if self.first is None and other.first is None:
            middle.same = same
            return middle
        if self.first is None:
            # other may know that it begins at a common end, one of whose two tokens stands before self.
            first = other.first if middle.first is None else middle.first
            return Fragment(middle.prefix, first, middle.closed + other.closed, other.last, other.suffix, same)
        if middle.first is None:
            if other.first is None:
                return Fragment(self.prefix, self.first, self.closed, self.last, middle.prefix, same)
            return Fragment(self.prefix, self.first, self.closed + other.closed, other.last, other.suffix, same)
        between = self.closed + Closed.of([middle.prefix]) + middle.closed
        if other.first is None:
            return Fragment(self.prefix, self.first, between, middle.last, middle.suffix, same)
        return Fragment(self.prefix, self.first, between + other.closed, other.last, other.suffix, same)

    def whole(self) -> Closed | None:
        """All groups of a text whose fragments are composed; None if it has no tokens or its bytes differ from them."""
        if not self.same or self.first is None or self.suffix.a or self.suffix.b:
            return None
        return (Closed.of([self.prefix]) if self.prefix.a else Closed()) + self.closed


# --- the tokenizers -----------------------------------------------------------------------------------------------

#: White space that both tokenizers' rules know as such.
_BLANKS = " \t\n\x0b\x0c\r"
#: A never joins an ASCII letter with what isn't one, nor a word with the white space behind it.
_A_CUT = re.compile(r"(?<=[A-Za-z])(?=[\x00-@\[-`{-\x7f])|(?<=\S)(?=[ \t\n\x0b\x0c\r])")


# Fixed value: where a byte-level tokenizer cuts a text before it merges.
_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Behind an id of B where another follows in its group, and at the group's end; _SHOWN writes them as the result has them.
_NEXT, _END = b".", b";"
_SHOWN = bytes.maketrans(_NEXT, b",")


def byte_alphabet() -> dict[str, int]:
    """The characters that stand for bytes in a byte-level vocabulary: printable Latin-1 for itself, the others from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [x for x in range(256) if x not in set(printable)]
    return {chr(x): x for x in printable} | {chr(256 + k): x for k, x in enumerate(others)}


class Aligner:
    """Encodes texts with a byte-level tokenizer file (A) and a piece model (B) and gives fragments."""

    _of: dict[tuple[str, str], Aligner] = {}

    def __init__(self, a_path: str, b_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        alphabet = byte_alphabet()
        self.a_bytes = {k: bytes(map(alphabet.__getitem__, x)) if set(x) <= alphabet.keys() else x.encode() for x, k in self.a.get_vocab().items()}
        self.ranked = self._by_ranks(a_path)
        pieces = [self.b.id_to_piece(k) for k in range(self.b.vocab_size())]
        self.b_bytes = [bytes([int(x[3:5], 16)]) if self.b.is_byte(k) else x.replace("▁", " ").encode() for k, x in enumerate(pieces)]
        a_all = [self.a_bytes[k] for k in range(len(self.a_bytes))]
        self.a_parts, self.b_parts = (np.array([*x, None], object)[:-1] for x in (a_all, self.b_bytes))
        self.a_sizes, self.b_sizes = (np.array([len(y) for y in x], np.int64) for x in (a_all, self.b_bytes))
        # An id with what stands behind it, within its side of a group and at its end: A's, then B's.
        names = [b"%d%s" % (k, end) for n, marks in ((len(a_all), (b",", b"|")), (len(self.b_bytes), (_NEXT, _END))) for k in range(n) for end in marks]
        self.names, self.name_sizes = np.array([*names, None], object)[:-1], np.array([len(x) for x in names], np.int64)
        plain = [x for k, x in enumerate(pieces) if not (self.b.is_byte(k) or self.b.is_control(k) or self.b.is_unknown(k))]
        #: Merges of B only make pieces of its vocabulary, so they can't cross two neighbours that no piece has.
        self.joined = {x + y for p in plain for x, y in zip(p, p[1:], strict=False)}
        # A line end is in no piece: behind it, B encodes a text as if it stood alone, without the space that it adds to a whole text.
        if any("\n" in x for x in plain):
            raise ValueError("a piece holds a line end")
        self.lead = len(self.b.encode("\n"))
        held = {x[1] for x in self.joined if not (x[0].isspace() or x[0] == "▁")}
        self.blanks = "".join(x for x in _BLANKS if (x if x != " " else "▁") not in held)
        start = re.escape(self.blanks)
        self.unit = re.compile(rf"\s+\S*(?:[^\S{start}]\s*\S*)*")
        self.cut = re.compile(rf"(?<=\S)(?=[{start}])")
        self.words = Memory(self._closed_words, KEPT_WORDS)

    @classmethod
    def of(cls, a_path: str, b_path: str) -> Aligner:
        if (a_path, b_path) not in cls._of:
            cls._of[a_path, b_path] = cls(a_path, b_path)
        return cls._of[a_path, b_path]

    def _by_ranks(self, path: str):
        """The same tokenizer as an encoder by ranks, which is several times as fast; None if the file isn't of that kind.

        Its merges must make ids in ascending order from byte tokens on; then the lowest merge is the lowest id, and no pair
        but a merge's own can make that merge's token.
        """
        import tiktoken

        with open(path, encoding="utf-8") as file:
            held = json.load(file)
        model, cut = held["model"], held["pre_tokenizer"] or {}
        made = [model["vocab"]["".join(x.split(" ") if isinstance(x, str) else x)] for x in model["merges"]]
        plain = held["normalizer"] is None and model["type"] == "BPE" and not any(model[k] for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
        if not plain or made != list(range(256, 256 + len(made))) or (cut.get("type"), cut.get("use_regex"), cut.get("add_prefix_space")) != ("ByteLevel", True, False):
            return None
        ranks = {self.a_bytes[k]: k for k in model["vocab"].values()}
        return tiktoken.Encoding("a", pat_str=_WORDS, mergeable_ranks=ranks, special_tokens={})

    def _a_ids(self, texts: list[str]) -> list[list[int]]:
        if self.ranked:
            return [self.ranked.encode_ordinary(t) for t in texts]
        return [x.ids for x in self.a.encode_batch_fast(texts, add_special_tokens=False)]

    def _b_ids(self, texts: list[str]) -> list[list[int]]:
        return [x[self.lead :] for x in self.b.encode(["\n" + t for t in texts], num_threads=1)]

    def _ends(self, ids: list[int], of, base: int) -> tuple[list[int], bytes]:
        parts = [of[x] for x in ids]
        return (np.cumsum([len(x) for x in parts], dtype=np.int64) + base).tolist(), b"".join(parts)

    def tokens(self, a_ids: list[int], a_text: str, a_base: int, b_ids: list[int], b_text: str, b_base: int) -> tuple[Tokens, bool]:
        a_ends, a_bytes = self._ends(a_ids, self.a_bytes, a_base)
        b_ends, b_bytes = self._ends(b_ids, self.b_bytes, b_base)
        return Tokens(a_ids, a_ends, b_ids, b_ends), a_bytes == a_text.encode() and b_bytes == b_text.encode()

    def _closed_words(self, words: list[str]) -> list[tuple[bytes, bytes]]:
        """Of each word between two common ends: the groups' text, each group with _END behind and B's ids with _NEXT behind, and the links. No text: the bytes differ.

        Words that end in what isn't white space can be encoded side by side.
        """
        out: dict[str, tuple] = {}
        solid = [w for w in words if not w[-1].isspace() and w[0] in self.blanks]
        for k in range(0, len(solid), 512):
            self._close(solid[k : k + 512], out)
        for w in words:
            if w not in out:
                self._close([w], out)
        return [out[w] for w in words]

    def _close(self, words: list[str], out: dict[str, tuple]) -> None:
        text = "".join(words)
        a, b = (np.array(x[0], np.int64) for x in (self._a_ids([text]), self._b_ids([text])))
        stops = np.cumsum([len(w.encode()) for w in words])
        data = text.encode()
        if b"".join(self.a_parts[a].tolist()) != data or b"".join(self.b_parts[b].tolist()) != data:
            half = len(words) // 2
            if not half:
                out[text] = (b"", b"")
                return
            self._close(words[:half], out)
            self._close(words[half:], out)
            return
        a_ends, b_ends = np.cumsum(self.a_sizes[a]), np.cumsum(self.b_sizes[b])
        # Each stretch between two neighbouring ends is the overlap of one A with one B token: a link.
        ends = np.sort(np.concatenate([a_ends, b_ends]), kind="stable")
        twice = np.append(ends[1:] == ends[:-1], False)
        common, ends = ends[twice], ends[~twice]
        links = (a[np.searchsorted(a_ends, ends)] << 32 | b[np.searchsorted(b_ends, ends)]).tobytes()
        # The groups' tokens in order, A before B. What follows a token is told by the place of the next.
        at = np.concatenate([np.searchsorted(common, a_ends) * 2, np.searchsorted(common, b_ends) * 2 + 1])
        order = np.argsort(at, kind="stable")
        at, ids = at[order], np.concatenate([a, b + len(self.a_sizes)])[order] * 2
        ids[np.append(at[1:] != at[:-1], True)] += 1
        names = b"".join(self.names[ids].tolist())
        tokens = np.searchsorted(a_ends, stops, "right") + np.searchsorted(b_ends, stops, "right")
        name_stops = np.cumsum(self.name_sizes[ids])[tokens - 1].tolist()
        link_stops = (np.searchsorted(ends, stops, "right") * 8).tolist()
        n = k = 0
        for w, n2, k2 in zip(words, name_stops, link_stops, strict=True):
            out[w] = (names[n:n2], links[k:k2])
            n, k = n2, k2

    def run(self, words: list[str], first: int, last: int) -> Fragment:
        """The fragment of words between two common ends, first and last: it has closed groups alone."""
        groups, links = zip(*self.words.values(words), strict=True)
        text, links = b"".join(groups), np.frombuffer(b"".join(links), np.int64)
        codes, counts = np.unique(links, return_counts=True)
        n_b, n_groups = text.count(_NEXT) + text.count(_END), text.count(_END)
        closed = Closed(text[:-1].translate(_SHOWN), len(links) + n_groups - n_b, n_b, n_groups, codes, counts)
        return Fragment(Tokens(), first, closed, last, Tokens(), all(groups))

    def fragment(self, text: str, base: int, a_from: int, a_to: int, b_from: int, b_to: int) -> Fragment:
        """Of a chunk: A's part of text from a_from to a_to and B's from b_from to b_to; base is the byte at which text begins."""

        def edge(a_start: int, a_end: int, b_start: int, b_end: int) -> Fragment:
            a_text, b_text = text[a_start:a_end], text[b_start:b_end]
            at = [base + len(text[:x].encode()) for x in (a_start, b_start)]
            return Fragment.of(*self.tokens(self._a_ids([a_text])[0], a_text, at[0], self._b_ids([b_text])[0], b_text, at[1]))

        low, high = max(a_from, b_from), min(a_to, b_to)
        starts = not low and text[0] in self.blanks  # both cut in front of the slice
        found = None if starts else self.cut.search(text, low, high)
        if low >= high or not (starts or found):
            return edge(a_from, a_to, b_from, b_to)
        first = found.start() if found else 0
        words = self.unit.findall(text, first, high)
        if high < len(text) and not self.cut.match(text, high):
            words.pop()  # it goes on behind the chunk's common range
        last = first + sum(map(len, words))
        if not words:
            return edge(a_from, a_to, b_from, b_to)
        out = self.run(words, base + len(text[:first].encode()), base + len(text[:last].encode()))
        if (a_from, b_from) != (first, first):
            out = edge(a_from, first, b_from, first) + out
        if (a_to, b_to) != (last, last):
            out = out + edge(last, a_to, last, b_to)
        return out

    def chunks(self, text: str, size: int) -> Iterator[tuple[str, int, int, int, int, int]]:
        """Arguments of fragment for the chunks of a text."""
        a_cuts, b_cuts = [0], [0]
        for low in range(size, len(text), size):
            a = a_cuts[-1]
            if a < low:
                found = _A_CUT.search(text, low)
                a = found.start() if found else len(text)
            b = b_cuts[-1]
            if b < low:
                b = next((p for p in range(low, len(text)) if text[p - 1 : p + 1].replace(" ", "▁") not in self.joined), len(text))
            a_cuts.append(a)
            b_cuts.append(b)
        a_cuts.append(len(text))
        b_cuts.append(len(text))
        at = base = 0
        for k in range(len(a_cuts) - 1):
            start, end = min(a_cuts[k], b_cuts[k]), max(a_cuts[k + 1], b_cuts[k + 1])
            base += len(text[at:start].encode())
            at = start
            yield text[start:end], base, a_cuts[k] - start, a_cuts[k + 1] - start, b_cuts[k] - start, b_cuts[k + 1] - start


# --- on Spark -----------------------------------------------------------------------------------------------------

_RESULT = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<struct<a:int,b:int,n:int>>"
_LINKS = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32()), ("n", pa.int32())]))


def _result(found: list[Closed | None]) -> list[pa.Array]:
    """The columns of _RESULT."""
    numbers = [[getattr(x, name) if x else 0 for x in found] for name in ("n_a", "n_b", "n_groups")]
    numbers.append([x.n_a + x.n_b - x.n_groups if x else 0 for x in found])
    digests = [hashlib.sha256(x.groups).hexdigest() if x else "" for x in found]
    offsets = np.concatenate([[0], np.cumsum([len(x.codes) if x else 0 for x in found])]).astype(np.int32)
    codes, counts = (np.concatenate([np.zeros(0, np.int64), *[getattr(x, name) for x in found if x]]) for name in ("codes", "counts"))
    values = pa.StructArray.from_arrays([pa.array((y).astype(np.int32)) for y in (codes >> 32, codes & 0xFFFFFFFF, counts)], fields=list(_LINKS.value_type))
    return [*(pa.array(x, pa.int64()) for x in numbers), pa.array(digests, pa.string()), pa.ListArray.from_arrays(offsets, values)]


_NAMES = ["n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs"]


def _decoded(data: bytes) -> str | None:
    """Space and the text, or None where there is nothing to encode."""
    try:
        return " " + data.decode() if data else None
    except UnicodeDecodeError:
        return None


def _sliced(batches: Iterator[pa.RecordBatch], rows: int = 64) -> Iterator[pa.RecordBatch]:
    """Batches of few rows, so that a task holds the results of few."""
    for batch in batches:
        for k in range(0, batch.num_rows, rows):
            yield batch.slice(k, rows)


def _short(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """The result of texts of one chunk."""

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner.of(a_path, b_path)
        for batch in _sliced(batches):
            texts = [_decoded(x.as_py()) for x in batch.column("text")]
            found = [aligner.run(aligner.unit.findall(t), 0, 1).whole() if t else None for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *_result(found)], ["doc_id", *_NAMES])

    return docs.select("doc_id", as_bytes().alias("text")).mapInArrow(align, f"doc_id long, {_RESULT}")


_CHUNKS = "doc_id long, digest string, copies long, no long, n long, text string, base long, a_from int, a_to int, b_from int, b_to int"
_STATE = "doc_id long, digest string, copies long, no long, n long, state binary"
_ID = ["doc_id", "digest", "copies", "n"]


def _long(docs: DataFrame, a_path: str, b_path: str, chunk: int, fan: int) -> DataFrame:
    """The result of longer texts, and how many rows have it. Rows equal in doc_id and text are aligned once."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner.of(a_path, b_path)
        for batch in batches:
            for row in range(batch.num_rows):
                head = {c: batch.column(c)[row].as_py() for c in ("doc_id", "digest", "copies")}
                text = _decoded(batch.column("text")[row].as_py())
                rows = list(aligner.chunks(text, chunk)) if text else [("", 0, 0, 0, 0, 0)]
                out = [head | {"no": k, "n": len(rows)} | dict(zip(("text", "base", "a_from", "a_to", "b_from", "b_to"), x, strict=True)) for k, x in enumerate(rows)]
                yield pa.RecordBatch.from_pylist(out, schema)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner.of(a_path, b_path)
        for batch in _sliced(batches):
            columns = [batch.column(c).to_pylist() for c in ("text", "base", "a_from", "a_to", "b_from", "b_to")]
            states = [pickle.dumps(aligner.fragment(*x) if x[0] else Fragment()) for x in zip(*columns, strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "digest", "copies", "no", "n")), pa.array(states, pa.binary())], names)

    def composed(rows: pa.Table) -> tuple[dict, Fragment]:
        """The neighbours of one task in order, composed, and what they have in common."""
        rows = rows.sort_by("no")
        head = {c: rows.column(c)[0].as_py() for c in rows.column_names if c != "state"}
        return head, reduce(Fragment.__add__, (pickle.loads(x.as_py()) for x in rows.column("state")))

    def level(rows: pa.Table) -> pa.Table:
        head, whole = composed(rows)
        return pa.table([[x] for x in (head["doc_id"], head["digest"], head["copies"], head["up"], head["n"], pickle.dumps(whole))], schema=states)

    def close(rows: pa.Table) -> pa.Table:
        head, whole = composed(rows)
        return pa.table([pa.array([head["doc_id"]], pa.int64()), pa.array([head["copies"]], pa.int64()), *_result([whole.whole()])], names=["doc_id", "copies", *_NAMES])

    names = ["doc_id", "digest", "copies", "no", "n", "state"]
    schema = pa.schema([("doc_id", pa.int64()), ("digest", pa.string()), *((c, pa.int64()) for c in ("copies", "no", "n")), ("text", pa.string()), ("base", pa.int64()), *((c, pa.int32()) for c in ("a_from", "a_to", "b_from", "b_to"))])
    states = pa.schema([("doc_id", pa.int64()), ("digest", pa.string()), *((c, pa.int64()) for c in ("copies", "no", "n")), ("state", pa.binary())])
    once = docs.select("doc_id", as_bytes().alias("text")).groupBy("doc_id", F.sha2("text", 256).alias("digest")).agg(F.count("*").alias("copies"), F.first("text").alias("text"))
    parts = once.mapInArrow(cut, _CHUNKS).repartition("doc_id", "digest", "no").mapInArrow(encode, _STATE)
    parts, _ = written(parts, "fragments")
    most = parts.agg(F.max("n")).first()[0] or 0
    while most > fan:
        parts = parts.withColumn("up", F.floor(F.col("no") / fan)).groupBy(*_ID, "up").applyInArrow(level, _STATE)
        most = -(-most // fan)
    # The last level closes the texts too: a further operator behind it would double the Python workers of a task.
    return parts.groupBy(*_ID).applyInArrow(close, f"doc_id long, copies long, {_RESULT}")


def aligned(docs: DataFrame, a_path: str, b_path: str, chunk: int = CHUNK, fan: int = FAN) -> DataFrame:
    """uid, doc_id, copies, n_a, n_b, n_groups, n_links, groups_sha256 and pairs (a, b, n) of every text, as a written table."""
    is_long = F.coalesce(F.length("text") > chunk, F.lit(False))
    short = _short(docs.where(~is_long), a_path, b_path).select(F.monotonically_increasing_id().alias("uid"), F.lit(1).cast("long").alias("copies"), "doc_id", *_NAMES)
    long = _long(docs.where(is_long), a_path, b_path, chunk, fan).select((-1 - F.monotonically_increasing_id()).alias("uid"), "copies", "doc_id", *_NAMES)
    return written(short.unionAll(long), "aligned")[0]


def pair_counts(found: DataFrame) -> DataFrame:
    """a, b, links corpus-wide, and whether no other pair of this b has more, as a written table."""
    pairs = found.select("copies", F.explode("pairs").alias("p")).select("p.a", "p.b", (F.col("p.n") * F.col("copies")).alias("n"))
    counts, _ = written(pairs.groupBy("a", "b").agg(F.sum("n").alias("links")), "pairs")
    return written(counts.join(counts.groupBy("b").agg(F.max("links").alias("most")), "b").select("a", "b", "links", (F.col("links") == F.col("most")).alias("best")), "counts")[0]


def align(docs: DataFrame, a_path: str, b_path: str, chunk: int = CHUNK, fan: int = FAN, hot: int = HOT) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of every document."""
    found = aligned(docs, a_path, b_path, chunk, fan)
    counts = pair_counts(found)
    total = counts.agg(F.sum("links")).first()[0] or 0
    frequent, rest = (counts.where(F.lit(float(hot)) * F.col("links") >= total), counts.where(F.lit(float(hot)) * F.col("links") < total))
    pairs = found.select("uid", F.explode("pairs").alias("p")).select("uid", "p.a", "p.b", "p.n")
    sums = [F.sum(F.when(F.col("best"), F.col("n")).otherwise(0)).alias("n_best"), F.sum(F.col("n") * F.col("links")).alias("count_sum")]
    by_frequent = pairs.join(F.broadcast(frequent), ["a", "b"]).groupBy("uid").agg(*sums)
    by_rest = pairs.join(F.broadcast(frequent.select("a", "b")), ["a", "b"], "left_anti").hint("merge").join(rest, ["a", "b"]).groupBy("uid").agg(*sums)
    scores = by_frequent.unionAll(by_rest).groupBy("uid").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    return (
        found.drop("pairs")
        .join(scores, "uid", "left")
        .select(
            "doc_id", "n_a", "n_b", "n_groups", "n_links",
            *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_best", "count_sum")],
            "groups_sha256", F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("copy"),
        )
        .drop("copy")
    )
