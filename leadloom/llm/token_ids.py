"""Token ids as files of directly addressable codes (dac.py), in ascending doc_id order.

Spark range-partitions and sorts the documents by doc_id; each task encodes its documents and writes
blocks of whole documents as rows (shard, block, before, payload) of a Parquet table, so that Spark
commits the files and a lost task is simply run again. Shards and blocks are in the order of doc_id;
a prefix sum over the shards' totals (a row per shard) gives every document's place in the stream.

Words between ASCII white space are encoded independently by the tokenizer (it turns white space into
boundaries that no token crosses), so ids are kept by word in a dictionary of bounded size.

Cases: null and empty texts have the end id alone; null doc_ids come first; rows with one doc_id are
ordered by text; a document longer than a block makes a block of its own; an empty table writes no
block; other columns are not read.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leadloom.llm import dac
from leadloom.llm.common import Memory, as_bytes

#: Words whose ids a worker keeps at least.
KEPT_WORDS = 400_000
#: Bytes of texts that are encoded at once, but for one longer text.
AT_ONCE = 1 << 22
#: Ids in a block, but for one longer document.
BLOCK_IDS = 1 << 20


class WordEncoder:
    """Encodes texts with a tokenizer file, a word at a time, keeping the ids of words seen."""

    _of: dict[str, WordEncoder] = {}

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.words = Memory(self._encode, KEPT_WORDS)

    @classmethod
    def of(cls, path: str) -> WordEncoder:
        if path not in cls._of:
            cls._of[path] = cls(path)
        return cls._of[path]

    def _encode(self, words: list[bytes]) -> list[bytes]:
        """Many words at once, with a space between; offsets tell to which word an id belongs."""
        out = []
        for k in range(0, len(words), 64):
            part = [w.decode("utf-8", "replace") for w in words[k : k + 64]]
            found = self.tokenizer.encode(" ".join(part), add_special_tokens=False)
            ids = np.array(found.ids, "<u4").tobytes()
            starts = np.array([start for start, _ in found.offsets], np.int64)
            cuts = (4 * np.searchsorted(starts, np.cumsum([0, *(len(w) + 1 for w in part)]))).tolist()
            out += [ids[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        return out

    def encode(self, text: bytes) -> bytes:
        """All ids of the text as little-endian unsigned 32-bit integers."""
        return next(self.encode_all(pa.array([text], pa.binary())))

    def encode_all(self, texts: pa.Array) -> Iterator[bytes]:
        """encode of each text. Of AT_ONCE bytes of texts, or of one longer text, a word is looked up once."""
        sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False)
        first = 0
        while first < len(sizes):
            last = max(first + 1, first + int(np.searchsorted(np.cumsum(sizes[first:]), AT_ONCE, side="right")))
            # The bytes of a text are split as they are: only ASCII white space counts.
            split = pc.ascii_split_whitespace(texts.slice(first, last - first).view(pa.string()))
            words = split.flatten()
            some = pc.greater(pc.binary_length(words), 0)
            upto = np.concatenate([[0], np.cumsum(some.to_numpy(zero_copy_only=False))])
            upto = upto[np.concatenate([[0], np.cumsum(pc.list_value_length(split).to_numpy(zero_copy_only=False))])]
            found = words.filter(some).view(pa.binary()).dictionary_encode()
            # One string of all words, split again, is cheaper than a scalar for each.
            listed = pa.ListArray.from_arrays(pa.array([0, len(found.dictionary)], pa.int32()), found.dictionary)
            codes = self.words.values(pc.binary_join(listed, b" ")[0].as_py().split())
            sizes_of = np.fromiter(map(len, codes), np.int64, len(codes)) // 4
            which = found.indices.to_numpy()
            n = sizes_of[which]
            after = np.concatenate([[0], np.cumsum(n)])
            place = np.repeat((np.cumsum(sizes_of) - sizes_of)[which] - after[:-1], n) + np.arange(after[-1])
            ids, cuts = memoryview(np.frombuffer(b"".join(codes), "<u4")[place]).cast("B"), (4 * after[upto]).tolist()
            yield from (bytes(ids[x:y]) for x, y in zip(cuts[:-1], cuts[1:], strict=True))
            first = last


WRITTEN = "shard int, block int, before long, n_docs long, n_ids long, payload binary"


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int = 1, block_ids: int = BLOCK_IDS) -> None:
    """Encodes the texts of docs and writes them to path."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = WordEncoder.of(tokenizer), np.uint32(end_id).tobytes()
        shard, block, before = TaskContext.get().partitionId(), 0, 0
        ids, parts, lengths, held = [], [], [], 0

        def out() -> pa.RecordBatch:
            payload = dac.pack(ids, np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)]), np.frombuffer(b"".join(parts), "<u4"))
            return pa.RecordBatch.from_arrays(
                [pa.array([x], t) for x, t in zip((shard, block, before, len(ids), held, payload), (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)],
                ["shard", "block", "before", "n_docs", "n_ids", "payload"],
            )

        for batch in batches:
            for doc_id, found in zip(batch.column("doc_id").to_pylist(), encoder.encode_all(batch.column("text")), strict=True):
                if held >= block_ids:
                    yield out()
                    block, before = block + 1, before + held
                    ids, parts, lengths, held = [], [], [], 0
                code = found + end
                ids.append(doc_id)
                parts.append(code)
                lengths.append(len(code) // 4)
                held += len(code) // 4
        if ids:
            yield out()

    rows = docs.select("doc_id", as_bytes().alias("text"))
    rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text").mapInArrow(encode, WRITTEN).write.parquet(path)


def checksums(block: dac.Block) -> list[int]:
    """The CRC-32 of each document's ids. All documents of the block are wanted, so its levels are read once."""
    ids, cuts = memoryview(block.slice(0, block.n).astype("<u4", copy=False)).cast("B"), (4 * block.starts).tolist()
    return [zlib.crc32(ids[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document in the files."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                block = dac.Block(batch.column("payload")[row].as_py())
                shard, before = batch.column("shard")[row].as_py(), batch.column("before")[row].as_py()
                n = len(block.doc_ids)
                sums = checksums(block)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([shard] * n, pa.int32()), pa.array(block.doc_ids, pa.int64()), pa.array(before + block.starts[:-1]), pa.array(np.diff(block.starts)), pa.array(sums, pa.int64())],
                    ["shard", "doc_id", "in_shard", "n_tokens", "ids_crc32"],
                )

    blocks = spark.read.schema(WRITTEN).parquet(path)
    shards = blocks.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    offsets = shards.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("offset"))
    found = blocks.select("shard", "before", "payload").mapInArrow(decode, "shard int, doc_id long, in_shard long, n_tokens long, ids_crc32 long")
    return found.join(offsets, "shard").select("doc_id", (F.col("offset") + F.col("in_shard")).alias("start"), "n_tokens", "ids_crc32")
