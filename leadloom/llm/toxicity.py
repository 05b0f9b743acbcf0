"""Toxicity by compression distance: zstandard dictionaries of toxic and of ordinary text.

The ordinary dictionary is trained on ordinary texts. The toxic one is that dictionary with a part in front that is
trained on toxic texts, so that the two differ by what toxic text alone offers: what both know costs the same with both, and
chance matches don't blur the difference. A text is cut to windows of consecutive whole words, WINDOW bytes or a
little more each, and every window is compressed with both. Its difference in bytes has a calibrated weight, the log ratio of the
difference's frequencies in toxic and in ordinary documents. A document's evidence is the largest sum of weights over any
STRETCH consecutive windows, so that the length of an otherwise ordinary text can't cancel a toxic passage. A
logistic curve through a calibrated cut makes the evidence a score.

Toxic texts are narrowed for training to words that are over-represented in them, counted once per
document and once per pair of neighbours, so that copies and one long document don't count often: a dictionary of a few
thousand bytes would else be filled with what all texts have most of.

Fitted on a bounded sample: TRAIN_DOCS documents of each label, TRAIN_CHARS of each (both are
parameters), chosen by a digest of doc_id among rows that are not held out; a third of it is kept for weights and the cut. Scoring
covers all rows and whole texts.

Cases: null and empty texts have no windows, so no evidence, and get the score of that, which is below the cut; a null toxic label
is no label; of repeated labels of a document the largest counts; without examples of both kinds every score is 0; a word longer than
a window is cut to pieces of WINDOW bytes; repeated rows are scored alike; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadloom.llm.common import as_bytes, tokens

TRAIN_DOCS = 3000
TRAIN_CHARS = 20_000
SHARED_BYTES, CLASS_BYTES = 110_000, 4096
#: Bytes of a window, windows that are compressed in one call, and the level.
WINDOW, BATCH, LEVEL = 48, 8192, 9
#: Windows whose weights are summed, about three thousand bytes of text.
STRETCH = 64
#: Differences in bytes are told apart from the lowest to the highest of these.
LOWEST, HIGHEST = -8, 15
#: How many times as frequent in toxic documents a word must be to be trained on.
RATIO = 10
CUT_SCORE = 0.7


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 3; rows at 1 are held out. A null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3


def _dictionary(size: int, samples: list[bytes]) -> bytes:
    import zstandard

    try:
        return zstandard.train_dictionary(size, samples, k=64, d=6).as_bytes()[-size:]
    except zstandard.ZstdError:  # too few samples to train on: they are the dictionary
        return b"".join(dict.fromkeys(samples))[-size:]


def _overrepresented(toxic: list[list[bytes]], ordinary: list[list[bytes]]) -> set[bytes]:
    def documents_with(docs: list[list[bytes]]) -> Counter:
        seen, found = set(), Counter()
        for words in docs:
            here = set()
            for k, w in enumerate(words):
                if w not in here and (key := (words[k - 1] if k else b"", w, words[k + 1] if k + 1 < len(words) else b"")) not in seen:
                    seen.add(key)
                    here.add(w)
            found.update(here)
        return found

    a, b = documents_with(toxic), documents_with(ordinary)
    least = max(3 if len(toxic) < 60 else 5, 0.01 * len(toxic))
    return {w for w, n in a.items() if n >= least and n / len(toxic) >= RATIO * (b[w] + 1) / len(ordinary)}


def windows(words: list[bytes]) -> list[bytes]:
    """Consecutive words in windows of at least WINDOW bytes (the last may be shorter), each within spaces."""
    out, held, size = [], [], 0
    for word in words:
        for at in range(0, len(word), WINDOW):
            held.append(word[at : at + WINDOW])
            size += len(held[-1]) + 1
            if size >= WINDOW:
                out.append(b" " + b" ".join(held) + b" ")
                held, size = [], 0
    if held:
        out.append(b" " + b" ".join(held) + b" ")
    return out


@dataclass
class Model:
    """Both dictionaries, the weights of differences, and the curve: evidence of cut has CUT_SCORE, width is its slope."""

    toxic: bytes
    ordinary: bytes
    weights: list[float] | None = None
    cut: float = 0.0
    width: float = 2.0

    def scorer(self) -> Scorer:
        return Scorer(self)


class Scorer:
    def __init__(self, model: Model):
        import zstandard as z

        how = z.ZstdCompressionParameters.from_level(LEVEL, write_content_size=0, write_checksum=0, write_dict_id=0, min_match=4)

        def compressor(content: bytes):
            d = z.ZstdCompressionDict(content, dict_type=z.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(compression_params=how)
            return z.ZstdCompressor(dict_data=d, compression_params=how)

        self.model = model
        self.toxic, self.ordinary = compressor(model.toxic), compressor(model.ordinary)
        self.weights = np.array(model.weights) if model.weights else None

    def compare(self, words: list[bytes]) -> np.ndarray:
        """For each window by how many bytes the toxic dictionary makes it shorter, counted from LOWEST."""
        found, cut = [], windows(words)
        for at in range(0, len(cut), BATCH):
            part = cut[at : at + BATCH]
            sizes = (np.fromiter((len(x) for x in c.multi_compress_to_buffer(part)), np.int64, len(part)) for c in (self.ordinary, self.toxic))
            found.append(np.clip(next(sizes) - next(sizes), LOWEST, HIGHEST) - LOWEST)
        return np.concatenate(found) if found else np.zeros(0, np.int64)

    def evidence(self, words: list[bytes]) -> float:
        """The largest sum of weights over STRETCH consecutive windows (all, if there are fewer)."""
        total = np.concatenate([[0.0], np.cumsum(self.weights[self.compare(words)])])
        n = min(STRETCH, len(total) - 1)
        return float((total[n:] - total[: len(total) - n]).max())

    def score(self, text: bytes) -> float:
        x = math.log(CUT_SCORE / (1 - CUT_SCORE)) + (self.evidence(tokens(text)) - self.model.cut) / self.model.width
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, x))))


def fit(sample: list[tuple[bytes, int]]) -> Model | None:
    """A model from (text, toxic) pairs. Every third document is kept for the calibration of the cut."""
    docs = [(tokens(text), toxic) for text, toxic in dict.fromkeys(sample)]
    part = {t: [w for w, y in docs if y == t] for t in (0, 1)}
    if not part[0] or not part[1]:
        return None
    kept = {t: ws[::3] if len(ws) >= 9 else ws for t, ws in part.items()}
    used = {t: [w for k, w in enumerate(ws) if k % 3] if len(ws) >= 9 else ws for t, ws in part.items()}
    marked = _overrepresented(used[1], used[0])
    toxic = [b" " + b" ".join(w for w in ws if w in marked) + b" " for ws in used[1] if any(w in marked for w in ws)]
    if not toxic:
        toxic = [b" " + b" ".join(ws) + b" " for ws in used[1]]
    joined = [b" " + b" ".join(ws) + b" " for ws in used[0]]
    shared = _dictionary(SHARED_BYTES, [o[k : k + 200] for o in joined for k in range(0, len(o), 200)])
    model = Model(_dictionary(CLASS_BYTES, toxic) + shared, shared)
    compare = model.scorer().compare
    counts = np.array([sum((np.bincount(compare(ws), minlength=HIGHEST - LOWEST + 1) for ws in kept[y]), np.zeros(HIGHEST - LOWEST + 1)) for y in (0, 1)]) + 1.0
    rates = counts / counts.sum(axis=1, keepdims=True)
    model.weights = np.log(rates[1] / rates[0]).tolist()
    scorer = model.scorer()
    found = sorted((scorer.evidence(ws), y) for y in (0, 1) for ws in kept[y])
    model.cut = _best_cut(found)
    return model


def _best_cut(found: list[tuple[float, int]]) -> float:
    """The cut with the best F-measure (precision counts double), in the middle of the gap between the values around it."""
    values = np.array([v for v, _ in found])
    labels = np.array([y for _, y in found])
    edges = np.unique(values)
    best = (-1.0, float(edges[-1]) + 1)
    for low, high in zip([edges[0] - 2, *edges[:-1]], edges, strict=True):
        hit = labels[values >= high]
        f = 1.25 * hit.sum() / (len(hit) + 0.25 * labels.sum())
        if f > best[0]:
            best = (float(f), float(low + high) / 2)
    return max(1.0, best[1])


def sample_of(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS, train_chars: int = TRAIN_CHARS) -> list[tuple[bytes, int]]:
    """Up to train_docs labelled (text, toxic) pairs of each label that are not held out: the bound of what the driver gets."""
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = known.where(fold(F.col("doc_id")) != 1).withColumn("order", F.md5(F.col("doc_id").cast("string")))
    # Order digests below a share of their range hold half as many rows again as are needed: no task sorts or sends more.
    counts = {r.toxic: r["count"] for r in known.where("toxic IN (0, 1)").groupBy("toxic").count().collect()}
    chosen = None
    for toxic in (0, 1):
        limit = int(min(1.0, 1.5 * train_docs / max(1, counts.get(toxic, 0))) * 2**32)
        first = F.conv(F.substring("order", 1, 8), 16, 10).cast("long") <= limit
        part = known.where((F.col("toxic") == toxic) & first).orderBy("order", "doc_id").limit(train_docs)
        chosen = part if chosen is None else chosen.unionAll(part)
    texts = docs.select("doc_id", F.substring(F.coalesce("text", F.lit("")), 1, train_chars).cast("binary").alias("text"))
    # chosen has at most 2 * train_docs rows of three short columns
    rows = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "order").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic"))
    return [(bytes(r.text), r.toxic) for r in rows.orderBy("order", "doc_id").limit(2 * train_docs).select("text", "toxic").collect()]


_SCORERS: dict[int, Scorer] = {}


def score(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """docs with a score column."""
    if model is None:
        return docs.withColumn("score", F.lit(0.0))

    key = hash((model.toxic, model.ordinary, model.cut))

    @F.pandas_udf("double")
    def scored(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        from leadloom.llm import toxicity

        if key not in toxicity._SCORERS:
            toxicity._SCORERS.clear()
            toxicity._SCORERS[key] = model.scorer()
        scorer = toxicity._SCORERS[key]
        for part in texts:
            yield pd.Series([scorer.score(t) for t in part], dtype="float64")

    return docs.withColumn("score", scored(as_bytes(text_col)))


def predicted() -> Column:
    return (F.col("score") >= CUT_SCORE).cast("int")


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    model = fit(sample_of(docs, labels))
    held_out = fold(F.col("doc_id")) == 1
    return score(docs.select("doc_id", "text"), model).select("doc_id", held_out.alias("held_out"), "score", predicted().alias("predicted"))
