"""SentencePiece encoding and decoding by streaming Viterbi.

The model file gives the pieces. It holds merge ranks, not log probabilities, so a piece of rank r is
given the score -log(r + 2) (Zipf's law over the ranks), and the segmentation with the highest sum is
found by a Viterbi pass whose window is bounded by the longest piece: whenever the backpointer paths
of all ends in the window meet, the ids before the meeting point are committed and forgotten. From each
start pieces are followed up to the first prefix that no piece has. A character without a piece is spelled
in byte pieces.

The paths always meet where a word ends, as no piece holds the space mark after another character, and
at line feeds, which no longer piece holds. So a text is encoded in such parts, and the ids of parts
seen are kept in a dictionary of bounded size, by encode until the task ends. Decoding joins the pieces' bytes.

Cases: null and empty texts have no ids; every other text decodes to exactly itself, whatever white
space or characters it holds (the space mark itself, U+2581, is spelled in bytes); repeated rows are
encoded alike; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadloom.llm.common import Memory

#: Parts whose ids a worker keeps at least, and those that a task of encode keeps, which comes after other operators in a worker's memory.
KEPT_PARTS, TASK_PARTS = 400_000, 200_000
SPACE = "▁"
#: Parts at whose ends all paths meet: spaces with the word after them, single line feeds, spaces alone.
PART = re.compile(r" *[^ \n]+|\n| +")


class Pieces:
    """The pieces of a model file, with scores, and the encoder's memory."""

    _of: dict[str, Pieces] = {}

    def __init__(self, path: str, kept_parts: int = KEPT_PARTS):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        self.scores: dict[str, tuple[float, int]] = {}
        self.bytes: list[bytes] = []
        self.byte_ids = [0] * 256
        rank = 0
        for k in range(model.get_piece_size()):
            piece = model.id_to_piece(k)
            if model.is_byte(k):
                self.byte_ids[int(piece[3:5], 16)] = k
                self.bytes.append(bytes([int(piece[3:5], 16)]))
            elif model.is_control(k) or model.is_unknown(k):
                self.bytes.append(b"")
            else:
                self.scores[piece.replace(SPACE, " ")] = (-math.log(rank + 2), k)
                self.bytes.append(piece.replace(SPACE, " ").encode())
                rank += 1
        if any(" " in p.lstrip(" ") or ("\n" in p and len(p) > 1) for p in self.scores):
            raise ValueError("a piece crosses a word's start or a line feed: texts can't be encoded in parts")
        #: What pieces begin with: the score and ids of those that are pieces themselves, () for the others.
        self.prefixes: dict[str, tuple] = {p[:k]: () for p in self.scores for k in range(1, len(p))}
        self.prefixes.update((p, (score, [k])) for p, (score, k) in self.scores.items())
        self.longest = max(map(len, self.scores))
        self.byte_score = -math.log(rank + 2) - 1
        self.kind = "H" if len(self.bytes) <= 65536 else "I"
        self.parts = Memory(self._encode, kept_parts)

    @classmethod
    def of(cls, path: str) -> Pieces:
        if path not in cls._of:
            cls._of[path] = cls(path)
        return cls._of[path]

    def stream(self, part: str) -> Iterator[list[int]]:
        """Ids in the order in which they are committed. Of equal scores the one with the longer last piece wins."""
        prefixes, scores, longest = self.prefixes, self.scores, self.longest
        best, back = {0: 0.0}, {}
        committed = 0
        n = len(part)
        for end in range(1, n + 1):
            # Pieces are followed from the start of the last character, up to the first prefix that no piece has.
            start = end - 1
            so_far = best[start]
            for at in range(end, min(n, start + longest) + 1):
                if (p := prefixes.get(part[start:at])) is None:
                    break
                if p and (at not in best or so_far + p[0] > best[at]):
                    best[at], back[at] = so_far + p[0], (start, p[1])
            if end not in best or part[start] not in scores:
                raw = part[start].encode("utf-8", "surrogatepass")
                if end not in best or so_far + self.byte_score * len(raw) > best[end]:
                    best[end], back[end] = so_far + self.byte_score * len(raw), (start, [self.byte_ids[b] for b in raw])
            if end < n and end - committed >= 2 * longest:
                # The ends from which a later piece can start, followed back until they meet.
                ends = set(range(end - longest + 1, end + 1))
                while len(ends) > 1:
                    last = max(ends)
                    ends.remove(last)
                    ends.add(back[last][0] if last > committed else committed)
                meet = ends.pop()
                if meet > committed:
                    yield self._path(back, committed, meet)
                    for k in range(committed, meet):
                        best.pop(k, None)
                        back.pop(k + 1, None)
                    committed = meet
        if n > committed:
            yield self._path(back, committed, n)

    @staticmethod
    def _path(back: dict, start: int, end: int) -> list[int]:
        steps = []
        while end > start:
            end, ids = back[end]
            steps.append(ids)
        return [x for ids in reversed(steps) for x in ids]

    def encode(self, text: str) -> array:
        """The ids of a text: a space is put in front, as the model asks for."""
        out = array(self.kind)
        if not text:
            return out
        out.frombytes(b"".join(self.parts.values(PART.findall(" " + text))))
        return out

    def _encode(self, parts: list[str]) -> list[bytes]:
        return [array(self.kind, [x for ids in self.stream(p) for x in ids]).tobytes() for p in parts]

    def decode(self, ids) -> str:
        return b"".join(map(self.bytes.__getitem__, ids))[1:].decode("utf-8", "surrogatepass")


def encode(docs: DataFrame, model: str, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """The kept columns, ids (array of int) and round_trip: whether decoding them gives the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A task has its own: workers go on with other operators, and what each keeps would add up.
        pieces = Pieces(model, TASK_PARTS)
        try:
            for batch in batches:
                # Slices, so that the ids of many long texts don't add up.
                for at in range(0, batch.num_rows, 256):
                    part = batch.slice(at, 256)
                    lengths, codes, same = [0], [], []
                    for text in part.column("text__").to_pylist():
                        ids = pieces.encode(text or "")
                        same.append(pieces.decode(ids) == (text or ""))
                        codes.append(np.frombuffer(ids, f"u{ids.itemsize}").astype(np.int32) if len(ids) else np.zeros(0, np.int32))
                        lengths.append(lengths[-1] + len(ids))
                    found = pa.ListArray.from_arrays(pa.array(lengths, pa.int32()), pa.array(np.concatenate(codes) if codes else np.zeros(0, np.int32)))
                    yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), found, pa.array(same, pa.bool_())], [*keep, "ids", "round_trip"])
        finally:
            pieces.parts = None  # it refers back to the pieces, which would stay until a collection

    rows = docs.select(*keep, F.col(text_col).alias("text__"))
    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema]
    return rows.mapInArrow(run, ", ".join([*kept, "ids array<int>", "round_trip boolean"]))


def digests(docs: DataFrame, model: str) -> DataFrame:
    """Per document: n_ids, ids_crc32 (of little-endian unsigned 32-bit integers) and of the decoded text n_chars and SHA-256."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces.of(model)
        for batch in batches:
            rows = []
            for text in batch.column("text").to_pylist():
                ids = pieces.encode(text or "")
                decoded = pieces.decode(ids)
                code = np.frombuffer(ids, f"u{ids.itemsize}").astype("<u4").tobytes() if len(ids) else b""
                rows.append((len(ids), zlib.crc32(code), len(decoded), hashlib.sha256(decoded.encode("utf-8", "surrogatepass")).hexdigest(), decoded == (text or "")))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds))],
                ["doc_id", "n_ids", "ids_crc32", "n_chars", "decoded_sha256", "round_trip"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_ids long, ids_crc32 long, n_chars long, decoded_sha256 string, round_trip boolean")
