"""Directly addressable codes for token ids: the file format, with random access to any token.

An id is cut into chunks of CHUNK bits, lowest first. Level k holds the k-th chunks of those ids that
have one, with a bitmap that says which ids go on to level k + 1, and a rank directory: the number of
set bits before every block of RANK bits. Id i of a level is at place rank(i) of the next, so any
token is read with one byte and one rank per level, without decoding its neighbours.

Layout, little-endian: magic, number of ids, of documents and of levels (uint64 each); doc_ids (int64, with a
bitmap of nulls in front), documents' first ids (uint64, one more than documents); then per level its
number of chunks (uint64), the chunks (one byte each), the bitmap, and the directory (uint32).
"""

from __future__ import annotations

import numpy as np

MAGIC = 0x3143414444494B54
CHUNK = 8
RANK = 512


def pack(doc_ids: list[int | None], starts: np.ndarray, ids: np.ndarray) -> bytes:
    """A block: starts has one entry more than doc_ids; ids are unsigned 32-bit integers."""
    levels, rest = [], ids.astype(np.uint32, copy=False)
    while True:
        more = rest >> CHUNK
        going = more > 0
        bitmap = np.packbits(going, bitorder="little")
        padded = np.zeros(-(-len(going) // RANK) * RANK, np.uint32)
        padded[: len(going)] = going
        directory = np.concatenate([[0], np.cumsum(padded.reshape(-1, RANK).sum(axis=1))]).astype(np.uint32)
        levels.append(b"".join([np.uint64(len(rest)).tobytes(), (rest & 0xFF).astype(np.uint8).tobytes(), bitmap.tobytes(), directory.tobytes()]))
        if not going.any():
            break
        rest = more[going]
    head = np.array([MAGIC, len(ids), len(doc_ids), len(levels)], np.uint64).tobytes()
    nulls = np.packbits(np.array([x is None for x in doc_ids], bool), bitorder="little").tobytes()
    known = np.array([0 if x is None else x for x in doc_ids], np.int64).tobytes()
    return b"".join([head, nulls, known, starts.astype(np.uint64).tobytes(), *levels])


class Block:
    """Reads a block; ids are found by place, alone or in ranges."""

    def __init__(self, data: bytes):
        magic, self.n, docs, levels = (int(x) for x in np.frombuffer(data, np.uint64, 4))
        if magic != MAGIC:
            raise ValueError("not a block of directly addressable codes")
        at = 32
        null = np.unpackbits(np.frombuffer(data, np.uint8, -(-docs // 8), at), bitorder="little")[:docs]
        at += -(-docs // 8)
        self.doc_ids = [None if x else int(y) for x, y in zip(null, np.frombuffer(data, np.int64, docs, at), strict=True)]
        at += 8 * docs
        self.starts = np.frombuffer(data, np.uint64, docs + 1, at).astype(np.int64)
        at += 8 * (docs + 1)
        self.levels = []
        for _ in range(levels):
            n = int(np.frombuffer(data, np.uint64, 1, at)[0])
            chunks = np.frombuffer(data, np.uint8, n, at + 8)
            bitmap = np.frombuffer(data, np.uint8, -(-n // 8), at + 8 + n)
            at += 8 + n + len(bitmap)
            directory = np.frombuffer(data, np.uint32, -(-n // RANK) + 1, at)
            at += 4 * len(directory)
            self.levels.append((chunks, bitmap, directory))

    def _rank(self, level: int, i: int) -> int:
        _, bitmap, directory = self.levels[level]
        first = i // RANK * RANK
        bits = np.unpackbits(bitmap[first // 8 : -(-i // 8)], bitorder="little")[: i - first]
        return int(directory[i // RANK]) + int(bits.sum())

    def get(self, i: int) -> int:
        """The id at place i."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for k, (chunks, bitmap, _) in enumerate(self.levels):
            value |= int(chunks[i]) << (CHUNK * k)
            if not bitmap[i >> 3] >> (i & 7) & 1:
                break
            i = self._rank(k, i)
        return value

    def slice(self, start: int, stop: int) -> np.ndarray:
        """The ids at places start to stop, reading just those chunks on each level."""
        out, where = np.zeros(max(0, stop - start), np.uint32), np.arange(max(0, stop - start))
        for k, (chunks, bitmap, _) in enumerate(self.levels):
            if not len(where):
                break
            out[where] |= chunks[start:stop].astype(np.uint32) << np.uint32(CHUNK * k)
            going = np.unpackbits(bitmap[start // 8 : -(-stop // 8)], bitorder="little")[start % 8 : start % 8 + stop - start].astype(bool)
            where = where[going]
            if len(where):
                start = self._rank(k, start)
                stop = start + len(where)
        return out

    def document(self, k: int) -> np.ndarray:
        return self.slice(int(self.starts[k]), int(self.starts[k + 1]))
