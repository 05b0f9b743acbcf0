"""Language-model scoring by a hierarchical Pitman-Yor model.

Symbols are the DICTIONARY most frequent training words, one symbol for all rarer words, and the end of
a text. Every preceding symbol has a context restaurant; its dishes are the symbols that follow, and all
context restaurants share one parent, whose customers are their tables and whose base is uniform. Tables
are sampled by Gibbs: in a sweep, every dish of every restaurant gets a new number of tables, drawn given all
its customers and the restaurant's mass for the dish. Totals of tables are those of the last sweep, at first
one table for every pair, so all restaurants are sampled at once. After BURN_IN sweeps the predictive probabilities of SAMPLES
sweeps are averaged. A rare word is its symbol's probability times the word's smoothed share of the rare
training words, so probabilities of all words sum to one.

How the work is split: documents are read once, in chunks. (Previous, next) pairs of a chunk are dealt to parts by a hash of
the pair, as compressed postings (pair, place of the document in its chunk, times), with about PART_TOKENS tokens in a
part on average; a pair has one posting per document at most, and the part of the most frequent pair holds all of its postings.
A part is counted, sampled and scored by itself, and gives sums by chunk and place. What all parts need is bounded by the dictionary:
tables by context and by symbol. The exact unigram base score needs every word's count: counts of
dictionary words travel with the dictionary, those of other words come by a join.

Cases: null and empty texts consist of the end alone; a null doc_id counts as empty text for the split;
repeated rows are scored one by one; without training rows all probabilities are the base measure's; an
empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math
import uuid
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadloom.llm.common import as_bytes, new_path, released, tokens, written

#: The most words with a symbol of their own: the bound of what is broadcast and gathered on the driver.
DICTIONARY = 1 << 18
BURN_IN, SAMPLES = 2, 3
#: Numbers of tables are drawn from their whole distribution up to so many customers; above, by so many proposals.
WHOLE, PROPOSALS = 128, 40
#: From so many expected tables on, or proposed ones, their number is drawn as a normal variable.
NORMAL, MOST_PROPOSED = 1000, 50_000
CONCENTRATION = 1.0
PART_TOKENS = 2_000_000
CHUNK_DOCS, CHUNK_TOKENS = 4096, 500_000
SHIFT = np.int64(1 << 20)
#: Pairs whose probabilities are computed at once.
AT_ONCE = 1 << 17


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 10 == 0


def pressed(*arrays: np.ndarray) -> bytes:
    """Arrays as bytes: of each its kind and length, then all contents."""
    head = [f"{a.dtype.str}:{len(a)}" for a in arrays]
    return zstandard.compress(";".join(head).encode() + b"\n" + b"".join(np.ascontiguousarray(a).tobytes() for a in arrays), 1)


def unpressed(data: bytes) -> list[np.ndarray]:
    raw = zstandard.decompress(data)
    at = raw.index(b"\n")
    out, head = [], raw[:at].decode()
    at += 1
    for kind, n in (x.split(":") for x in head.split(";")):
        out.append(np.frombuffer(raw, kind, int(n), at).copy())
        at += out[-1].nbytes
    return out


# ---------------------------------------------------------------- counts and dictionary


def word_counts(docs: DataFrame) -> DataFrame:
    """word, c: how often every word occurs in the training texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])

        for batch in batches:
            for text in batch.column("text"):
                counts.update(tokens(text.as_py()))
                if len(counts) > 400_000:
                    yield out()
                    counts.clear()
        if counts:
            yield out()

    rows = docs.where(~held_out(F.col("doc_id"))).select(as_bytes().alias("text")).mapInArrow(run, "word binary, n long")
    return rows.groupBy("word").agg(F.sum("n").alias("c"))


class Dictionary:
    """Words with a symbol of their own, and their counts; symbols are places, then RARE, END and (as a context) START."""

    _ids: dict[str, dict[bytes, int]] = {}

    def __init__(self, words: list[bytes], counts: np.ndarray, rare: int, rare_types: int, texts: int):
        self.key, self.blob, self.n = uuid.uuid4().hex, b"\n".join(words), len(words)
        self.counts, self.rare_tokens, self.rare_types, self.texts = counts, rare, rare_types, texts
        self.RARE, self.END, self.START = self.n, self.n + 1, self.n + 2

    @property
    def ids(self) -> dict[bytes, int]:
        if self.key not in self._ids:
            self._ids.clear()
            self._ids[self.key] = {w: k for k, w in enumerate(self.blob.split(b"\n"))} if self.n else {}
        return self._ids[self.key]

    def encode(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.ids.get, words, repeat(self.RARE)), np.int64, len(words))

    @property
    def context_counts(self) -> np.ndarray:
        """How many training symbols follow each symbol."""
        return np.concatenate([self.counts, [self.rare_tokens, 0, self.texts]]).astype(np.float64)


def dictionary_of(counts: DataFrame, texts: int, size: int) -> Dictionary:
    """Words above a count that at most size words reach; counts are compared on a scale of sixteenths of a doubling."""
    step = F.floor(F.log2("c") * 16).cast("int")
    scale = sorted(((r.step, r.words) for r in counts.groupBy(step.alias("step")).agg(F.count("*").alias("words")).collect()), reverse=True)
    least, total = None, 0
    for s, n in scale:
        total += n
        if total > size:
            break
        least = s
    chosen = counts.where(step >= least) if least is not None else counts.limit(0)
    table = chosen.toArrow()
    order = np.argsort(-table["c"].to_numpy(), kind="stable") if len(table) else []
    words = [table["word"][int(k)].as_py() for k in order]
    kept = table["c"].to_numpy()[order].astype(np.int64) if len(table) else np.zeros(0, np.int64)
    rest = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("tokens"), F.count("*").alias("types")).first()
    return Dictionary(words, kept, int(rest.tokens - kept.sum()), int(rest.types - len(words)), texts)


# ---------------------------------------------------------------- passes over the documents


DOCUMENT = pa.schema(
    [("rid", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("known", pa.int64()), ("base", pa.float64()), ("n_rare", pa.int64())]
    + [("rare", pa.list_(pa.struct([("word", pa.binary()), ("n", pa.int64())])))]
)


def chunks(docs: DataFrame, shared, parts: int) -> DataFrame:
    """part, chunk, payload: chunks of documents as they are read, in one pass.

    A part from 0 on gets the pairs of a chunk that are dealt to it, with the places in the chunk of the documents they occur in;
    a part below 0 gets what is known of the documents themselves (DOCUMENT): what dictionary words give, and rare words with
    counts. Training documents have the first places in a chunk, so a payload holds their number and no document's id.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d = shared.value
        logs = np.log10(np.concatenate([d.counts, [0, d.texts]]) + 0.1)
        number, held, rows = TaskContext.get().partitionId() << 24, 0, []

        def out() -> pa.RecordBatch:
            rows.sort(key=lambda r: r[1])
            place = np.repeat(np.arange(len(rows)), [len(r[2]) - 1 for r in rows])
            key = np.concatenate([r[2][:-1] * SHIFT + r[2][1:] for r in rows])
            order = np.lexsort((place, key))
            key, place = key[order], place[order]
            first = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (place[1:] != place[:-1])]))
            times = np.diff(np.concatenate([first, [len(key)]]))
            key, place = key[first], place[first]
            part = part_of(key, parts)
            order = np.argsort(part, kind="stable")
            key, place, times, part = key[order], place[order], times[order], part[order]
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(part)) + 1, [len(part)]])
            trained = np.array([sum(not r[1] for r in rows)], np.uint16)
            numbers, payloads = [-1 - number % (2**31 - 1)], [documents_of(number)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                k = key[a:b]
                numbers.append(int(part[a]))
                payloads.append(pressed((k >> 20).astype(np.uint32), (k & (SHIFT - 1)).astype(np.uint32), place[a:b].astype(np.uint16), times[a:b].astype(np.uint32), trained))
            return pa.RecordBatch.from_arrays([pa.array(numbers, pa.int32()), pa.array([number] * len(numbers), pa.int64()), pa.array(payloads, pa.binary())], ["part", "chunk", "payload"])

        def documents_of(chunk: int) -> bytes:
            columns = [[] for _ in DOCUMENT]
            for k, (doc_id, out_, line, rare) in enumerate(rows):
                ids = line[1:-1]
                own = ids != d.RARE
                values = (chunk << 16 | k, doc_id, out_, len(ids) + 1, int(own.sum()) + (d.texts > 0), float(logs[ids[own]].sum() + logs[d.END]), len(ids) - int(own.sum()), rare)
                for column, value in zip(columns, values, strict=True):
                    column.append(value)
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, DOCUMENT, options=pa.ipc.IpcWriteOptions(compression="zstd")) as stream:
                stream.write_batch(pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, DOCUMENT, strict=True)], schema=DOCUMENT))
            return sink.getvalue().to_pybytes()

        for batch in batches:
            for doc_id, out_, text in zip(batch.column("doc_id").to_pylist(), batch.column("held_out").to_pylist(), batch.column("text"), strict=True):
                words = tokens(text.as_py())
                ids = d.encode(words)
                rare = Counter([words[k] for k in np.flatnonzero(ids == d.RARE)])
                rows.append((doc_id, out_, np.concatenate([[d.START], ids, [d.END]]), [{"word": w, "n": c} for w, c in rare.items()]))
                held += len(words) + 1
                if len(rows) >= CHUNK_DOCS or held >= CHUNK_TOKENS:
                    yield out()
                    number, held = number + 1, 0
                    rows.clear()
        if rows:
            yield out()

    return docs.mapInArrow(run, "part int, chunk long, payload binary")


def document_rows(parts_table: DataFrame) -> DataFrame:
    """The documents of all chunks; rid is a document's chunk and place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in batch.column("chunks"):
                for x in chunk.values.field("payload"):
                    yield from pa.ipc.open_stream(x.as_py())

    rows = parts_table.where("part < 0").select("chunks")
    return rows.mapInArrow(run, "rid long, doc_id long, held_out boolean, n_tokens long, known long, base double, n_rare long, rare array<struct<word:binary,n:long>>")


def part_of(key: np.ndarray, parts: int) -> np.ndarray:
    x = key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return ((x >> np.uint64(32)) % np.uint64(parts)).astype(np.int64)


# ---------------------------------------------------------------- seating


def summed(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the sum of the values of each."""
    order = np.argsort(keys, kind="stable")
    keys, values = keys[order], values[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(values, first) if len(first) else values


def decoded(payload: bytes) -> tuple[np.ndarray, ...]:
    """Pairs, places of documents, times, and the number of training documents."""
    u, w, place, times, trained = unpressed(payload)
    return u.astype(np.int64) * SHIFT + w, place.astype(np.int64), times.astype(np.int64), int(trained[0])


def pair_counts(payloads: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of a part in order, and their training counts (0 for pairs of held-out documents alone)."""
    keys, counts = [], []
    for payload in payloads:
        key, place, times, trained = decoded(payload)
        k, c = summed(key, times * (place < trained))
        keys.append(k)
        counts.append(c)
    return summed(np.concatenate(keys), np.concatenate(counts)) if keys else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def seated(c: np.ndarray, mass: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A seating for reseated: about as many tables as expected, of nearly equal sizes."""
    t = np.clip(np.round(mass * np.log1p(c / mass)), 1, c).astype(np.int64)
    small, rest = c // t, c % t
    sizes = np.repeat(small, t)
    place = np.arange(len(sizes)) - np.repeat(np.cumsum(t) - t, t)
    return t, sizes + (place < np.repeat(rest, t))


def reseated(rng: np.random.Generator, c: np.ndarray, t: np.ndarray, sizes: np.ndarray, mass: np.ndarray, discount: float, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Gibbs steps: in each round one customer of every dish leaves and is seated again. All c are at least 2. The tests hold drawn to it."""
    if not len(c):
        return t, sizes
    t, sizes = t.copy(), sizes.copy()
    for _ in range(rounds):
        first = np.cumsum(t) - t
        upto = np.concatenate([[0], np.cumsum(sizes)])
        left = np.searchsorted(upto, upto[first] + (rng.random(len(c)) * c).astype(np.int64), side="right") - 1
        sizes[left] -= 1
        weights = np.concatenate([[0.0], np.cumsum(np.where(sizes > 0, sizes - discount, 0.0))])
        total = weights[first + t] - weights[first]
        fresh = rng.random(len(c)) * (mass + total) < mass
        joined = np.searchsorted(weights, weights[first] + rng.random(len(c)) * total, side="right") - 1
        joined = np.clip(joined, first, first + t - 1)
        joined = np.where(sizes[joined] > 0, joined, left)  # for sums at an edge
        sizes[joined[~fresh]] += 1
        emptied = sizes[left] == 0
        sizes = np.insert(sizes, (first + t)[fresh], 1)
        sizes = sizes[sizes > 0]
        t = t - emptied + fresh
    return t, sizes


_log_gamma = np.frompyfunc(math.lgamma, 1, 1)


def stirling_logs(most: int, discount: float) -> np.ndarray:
    """[c, t]: log of the weight of all seatings of c customers at t tables, a table of n weighing (1 - d)(2 - d)...(n - 1 - d)."""
    logs = np.full((most + 1, most + 1), -np.inf)
    logs[0, 0] = 0.0
    for c in range(most):
        joined = c - discount * np.arange(1, most + 1)
        logs[c + 1, 1:] = np.logaddexp(logs[c, :-1], logs[c, 1:] + np.log(np.where(joined > 0, joined, 1.0)))
    return logs


def drawn(rng: np.random.Generator, c: np.ndarray, mass: np.ndarray, discount: float) -> np.ndarray:
    """The number of tables of every dish, t with weight mass^t times that of all seatings of its c customers at t tables."""
    t = np.minimum(c, 1)
    few = np.flatnonzero((c > 1) & (c <= WHOLE))
    if len(few):
        logs = stirling_logs(int(c[few].max()), discount)
        few = few[np.argsort(c[few], kind="stable")]
        for group in np.split(few, np.flatnonzero(np.diff(c[few])) + 1):
            n = int(c[group[0]])
            for at in range(0, len(group), 1 << 16):
                rows = group[at : at + (1 << 16)]
                w = logs[n, 1 : n + 1] + np.log(mass[rows])[:, None] * np.arange(1, n + 1)
                w = np.cumsum(np.exp(w - w.max(axis=1, keepdims=True)), axis=1)
                t[rows] = 1 + (w < (rng.random(len(rows)) * w[:, -1])[:, None]).sum(axis=1)
    many = np.flatnonzero(c > WHOLE)
    if len(many):
        t[many] = _drawn_many(rng, c[many], mass[many], discount)
    return t


def _drawn_many(rng: np.random.Generator, c: np.ndarray, mass: np.ndarray, discount: float) -> np.ndarray:
    """drawn for dishes with many customers, at a cost that follows the tables.

    A dish's tables are a Poisson number, of mean mass / d, of sizes with chance d (1 - d)...(n - 1 - d) / n!, given that
    the sizes add up to c. Each size n may be thinned by z^n, which is the same for all that add up to c; z = 1 - e makes
    c the mean. One table, picked by size, is what the others leave of c. The others are proposed from the thinned
    process, and taken or not by the chance of what they leave (Metropolis).
    """
    low, high = np.full(len(c), -700.0), np.zeros(len(c))
    for _ in range(60):  # of log e
        middle = (low + high) / 2
        above = np.log(mass) + np.log(-np.expm1(middle)) + (discount - 1) * middle > np.log(c)
        low, high = np.where(above, middle, low), np.where(above, high, middle)
    e = np.exp((low + high) / 2)
    rate = mass / discount
    mean = -rate * np.expm1(discount * np.log(e))
    spread = c + c * (1 - discount) * (1 - e) / e
    normal = (mean > NORMAL) | (rate > MOST_PROPOSED)
    t = np.round(mean + rng.standard_normal(len(c)) * np.sqrt(np.maximum(mean - c * (c / spread), 0.0)))
    t = np.clip(t, 1, c).astype(np.int64)
    left = np.flatnonzero(~normal)
    if not len(left):
        return t
    c, rate, thin = c[left], rate[left], np.log1p(-e[left])

    def weight(s: np.ndarray) -> np.ndarray:
        rest = np.maximum(c - s, 1.0)
        return np.where(s < c, (_log_gamma(rest - discount) - _log_gamma(rest)).astype(np.float64) - s * thin, -np.inf)

    others = np.zeros(len(c), np.int64)  # at first all customers are at one table
    now = weight(np.zeros(len(c)))
    for _ in range(PROPOSALS):
        n = rng.poisson(rate)
        dish = np.repeat(np.arange(len(c)), n)
        p = rng.beta(discount, 1 - discount, len(dish))
        with np.errstate(divide="ignore"):
            sizes = np.ceil(np.log(1 - rng.random(len(dish))) / np.log1p(-p))
        sizes = np.clip(np.nan_to_num(sizes, nan=1.0, posinf=2.0**60), 1.0, c[dish])
        kept = np.log(1 - rng.random(len(dish))) < sizes * thin[dish]
        dish, sizes = dish[kept], sizes[kept]
        then = weight(np.bincount(dish, sizes, len(c)))
        taken = np.log(1 - rng.random(len(c))) < then - now
        others = np.where(taken, np.bincount(dish, minlength=len(c)), others)
        now = np.where(taken, then, now)
    t[left] = others + 1
    return t


class Totals:
    """Tables by context and by symbol over all parts, and the parent restaurant's seating: bounded by the dictionary."""

    def __init__(self, by_context: np.ndarray, by_symbol: np.ndarray, discount: float):
        self.by_context, self.by_symbol, self.discount = by_context.astype(np.float64), by_symbol.astype(np.int64), discount

    def seat(self, rng: np.random.Generator, before: Totals | None) -> Totals:
        """Samples the parent's tables and sets its predictive probabilities."""
        m = self.by_symbol
        n = len(m)
        n1, n2 = int((m == 1).sum()), int((m == 2).sum())
        d0 = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
        many = np.flatnonzero(m > 1)
        t = np.minimum(m, 1)
        if len(many):
            mass = np.full(len(many), (CONCENTRATION + d0 * (before.root_tables if before else len(many))) / n)
            t[many] = drawn(rng, m[many], mass, d0)
        self.root_tables = int(t.sum())
        self.base = (m - d0 * t + (CONCENTRATION + d0 * self.root_tables) / n) / (CONCENTRATION + m.sum())
        return self

    def mass(self, u: np.ndarray, w: np.ndarray) -> np.ndarray:
        return (CONCENTRATION + self.discount * self.by_context[u]) * self.base[w]


def tables_of(u: np.ndarray, w: np.ndarray, t: np.ndarray, symbols: int) -> bytes:
    """Tables by context and by symbol, as differences from nothing: places and values."""
    a, b = summed(u, t)
    c, d = summed(w, t)
    return pressed(a.astype(np.uint32), b.astype(np.int64), c.astype(np.uint32), d.astype(np.int64))


def gathered(rows: DataFrame, symbols: int, contexts: int, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """The sums of all rows' tables, added up in a tree of tasks; the driver gets at most 16 rows."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_context, by_symbol = np.zeros(contexts, np.int64), np.zeros(symbols, np.int64)
        for batch in batches:
            for x in batch.column("tables"):
                a, b, c, d = unpressed(x.as_py())
                by_context[a] += b
                by_symbol[c] += d
        a, c = np.flatnonzero(by_context), np.flatnonzero(by_symbol)
        yield pa.RecordBatch.from_arrays([pa.array([pressed(a.astype(np.uint32), by_context[a], c.astype(np.uint32), by_symbol[c])], pa.binary())], ["tables"])

    rows, n = rows.select("tables"), parts
    while n > 16:
        n = -(-n // 32)
        rows = rows.repartition(n).mapInArrow(add, "tables binary")
    by_context, by_symbol = np.zeros(contexts, np.int64), np.zeros(symbols, np.int64)
    for r in rows.collect():
        a, b, c, d = unpressed(bytes(r.tables))
        by_context[a] += b
        by_symbol[c] += d
    return by_context, by_symbol


# ---------------------------------------------------------------- the model over all parts


def started(parts_table: DataFrame, symbols: int) -> DataFrame:
    """Per part: state (pairs seen twice or more, with counts), tables of pairs seen once, one table for each of the others, and how many were seen once and twice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                key, c = pair_counts([x.as_py() for x in batch.column("chunks")[k].values.field("payload")])
                one, many = key[c == 1], c > 1
                once, least = (tables_of(x >> 20, x & (SHIFT - 1), np.ones(len(x), np.int64), symbols) for x in (one, key[many]))
                row = [batch.column("part")[k].as_py(), pressed(key[many], c[many]), once, least, len(one), int((c == 2).sum())]
                kinds = (pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, kinds, strict=True)], ["part", "state", "tables", "least", "n1", "n2"])

    return parts_table.where("part >= 0").select("part", "chunks").mapInArrow(run, "part int, state binary, tables binary, least binary, n1 long, n2 long")


def swept(states: DataFrame, shared, sweep: int, symbols: int) -> DataFrame:
    """One sweep of Gibbs sampling over all parts; from the end of the burn-in tables are added up for averages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = shared.value
        for batch in batches:
            for k in range(batch.num_rows):
                part, state = batch.column("part")[k].as_py(), unpressed(batch.column("state")[k].as_py())
                key, c = state[:2]
                u, w = key >> 20, key & (SHIFT - 1)
                added = state[2] if len(state) > 2 else np.zeros(len(c), np.int64)
                t = drawn(np.random.default_rng([1, sweep, part]), c, totals.mass(u, w), totals.discount)
                if sweep >= BURN_IN:
                    added = added + t
                row = [part, pressed(key, c, added), tables_of(u, w, t, symbols)]
                yield pa.RecordBatch.from_arrays([pa.array([v], x) for v, x in zip(row, (pa.int32(), pa.binary(), pa.binary()), strict=True)], ["part", "state", "tables"])

    return states.select("part", "state").mapInArrow(run, "part int, state binary, tables binary")


class Predictor:
    """Averaged predictive probabilities of pairs, from the samples' totals."""

    def __init__(self, samples: list[Totals], context_counts: np.ndarray):
        self.samples, self.context_counts, self.discount = samples, context_counts, samples[0].discount

    def probability(self, u: np.ndarray, w: np.ndarray, c: np.ndarray, t: np.ndarray) -> np.ndarray:
        """t: the average number of tables of each pair."""
        mass = sum(s.mass(u, w) for s in self.samples) / len(self.samples)
        return (c - self.discount * t + mass) / (CONCENTRATION + self.context_counts[u])

    def logs(self, key: np.ndarray, c: np.ndarray, t: np.ndarray) -> np.ndarray:
        """log10 of the probabilities of a part's pairs, some at a time: what is computed on the way isn't held for the whole part."""
        out = np.empty(len(key))
        for first in range(0, len(key), AT_ONCE):
            s = slice(first, first + AT_ONCE)
            out[s] = np.log10(self.probability(key[s] >> 20, key[s] & (SHIFT - 1), c[s], t[s]))
        return out


def part_scores(parts_table: DataFrame, states: DataFrame, shared) -> DataFrame:
    """rid, pairs: the sum of log probabilities of each document's pairs.

    A part gives one row for each chunk of documents, with the sums of those it holds pairs of; a chunk's rows meet
    in one group, which is bounded by the chunk's tokens.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        predictor = shared.value
        for batch in batches:
            for k in range(batch.num_rows):
                listed = batch.column("chunks")[k].values
                payloads = [x.as_py() for x in listed.field("payload")]
                key, c = pair_counts(payloads)
                t = np.minimum(c, 1).astype(np.float64)
                known, _, added = unpressed(batch.column("state")[k].as_py())
                t[np.searchsorted(key, known)] = added / len(predictor.samples)
                logs = predictor.logs(key, c, t)
                del c, t, known, added
                for chunk, payload in zip(listed.field("chunk").to_pylist(), payloads, strict=True):
                    pairs, place, times, _ = decoded(payload)
                    sums = np.bincount(place, weights=logs[np.searchsorted(key, pairs)] * times)
                    has = np.unique(place)
                    yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), pa.array([pressed(has.astype(np.uint16), sums[has])], pa.binary())], ["chunk", "sums"])

    def gather(rows: pd.DataFrame) -> pd.DataFrame:
        found = [unpressed(x) for x in rows["sums"]]
        places, sums = summed(np.concatenate([r for r, _ in found]).astype(np.int64), np.concatenate([s for _, s in found]))
        return pd.DataFrame({"rid": (int(rows["chunk"].iloc[0]) << 16) + places, "pairs": sums})

    rows = parts_table.join(states.select("part", "state"), "part").mapInArrow(run, "chunk long, sums binary")
    return rows.groupBy("chunk").applyInPandas(gather, "rid long, pairs double")


def score(docs: DataFrame, dictionary: int = DICTIONARY, part_tokens: int = PART_TOKENS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score and perplexity of every document."""
    spark, sc = docs.sparkSession, docs.sparkSession.sparkContext
    counts, counts_path = written(word_counts(docs), "words")
    texts = docs.where(~held_out(F.col("doc_id"))).count()
    d = dictionary_of(counts, texts, dictionary)
    shared = sc.broadcast(d)
    train_tokens = int(d.counts.sum()) + d.rare_tokens + texts
    types = d.n + d.rare_types + (texts > 0)
    symbols, contexts = d.n + 2, d.n + 3

    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), as_bytes().alias("text"))
    parts = max(1, -(-int(train_tokens * 1.15) // part_tokens))
    table, location = f"lm_{uuid.uuid4().hex}", new_path(spark, "parts")
    dealt = chunks(rows, shared, parts).groupBy("part").agg(F.collect_list(F.struct("chunk", "payload")).alias("chunks"))
    # Bucketed by part, so that later joins with small states don't move the postings again. All that is read of the
    # documents is in this one table, so places in chunks mean the same to every later job.
    buckets = max(1, min(parts, 10_000))
    dealt.write.bucketBy(buckets, "part").option("path", location).saveAsTable(table)
    parts_table = spark.table(table)
    sums, _ = written(document_rows(parts_table), "sums")
    # The share of rare words: every word's count comes by a join with all counts but the dictionary's.
    rare = sums.select("rid", F.explode("rare").alias("r")).select("rid", F.col("r.word").alias("word"), F.col("r.n").alias("n"))
    logs = rare.join(counts, "word", "left").groupBy("rid").agg(
        F.sum(F.col("n") * F.log10(F.coalesce("c", F.lit(0)) + 0.1)).alias("rare_base"), F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("rare_known")
    )
    logs, _ = written(logs, "rare")

    states, state_path = written(started(parts_table, symbols), "states")
    once = gathered(states, symbols, contexts, parts)
    seen = states.agg(F.coalesce(F.sum("n1"), F.lit(0)).alias("n1"), F.coalesce(F.sum("n2"), F.lit(0)).alias("n2")).first()
    discount = seen.n1 / (seen.n1 + 2 * seen.n2) if seen.n1 and seen.n2 else 0.5
    rng, samples = np.random.default_rng(0), []
    least = gathered(states.select(F.col("least").alias("tables")), symbols, contexts, parts)
    totals = Totals(once[0] + least[0], once[1] + least[1], discount).seat(rng, None)
    for sweep in range(BURN_IN + SAMPLES):
        after, after_path = written(swept(states, sc.broadcast(totals), sweep, symbols), "states")
        released(spark, state_path)
        states, state_path = after, after_path
        more = gathered(states, symbols, contexts, parts)
        totals = Totals(once[0] + more[0], once[1] + more[1], discount).seat(rng, totals)
        if sweep >= BURN_IN:
            samples.append(totals)
    predictor = sc.broadcast(Predictor(samples, d.context_counts))
    found, _ = written(part_scores(parts_table, states, predictor), "scores")
    spark.sql(f"DROP TABLE {table}")
    released(spark, location, state_path, counts_path)

    rare_base, rare_known = F.coalesce("rare_base", F.lit(0.0)), F.coalesce("rare_known", F.lit(0))
    whole = F.log10(F.lit(train_tokens + 0.1 * (types + 1)))
    rare_whole = F.log10(F.lit(d.rare_tokens + 0.1 * (d.rare_types + 1)))
    value = F.col("pairs") + rare_base - F.col("n_rare") * rare_whole
    return (
        sums.join(logs, "rid", "left")
        .join(found, "rid", "left")
        .select(
            "doc_id",
            "held_out",
            "n_tokens",
            (F.col("known") + rare_known).alias("n_known"),
            F.lit(train_tokens).cast("long").alias("train_tokens"),
            (F.col("base") + rare_base - F.col("n_tokens") * whole).alias("base_score"),
            value.alias("score"),
            F.pow(F.lit(10.0), -value / F.col("n_tokens")).alias("perplexity"),
        )
    )
