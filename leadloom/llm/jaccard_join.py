"""N-gram Jaccard join by parity sketches, exact for the threshold.

A document's set holds 64-bit hashes of its word shingles. Two sets with Jaccard similarity of PERCENT
or more differ in at most k elements, where k follows from their sizes. In a parity sketch every element flips
the bit that its hash names, so the Hamming distance of two sketches is at most the sets' symmetric difference.
Sizes are in geometric bands with a layout each; a set is keyed in its own band and in every higher one that
it can have a partner in, so a linked pair shares the layout of its larger set's band.

Pigeonhole: elements are dealt to k + 1 + spare blocks, and the parity of a block (of 2^64 bits, folded by XOR of
the names of the odd ones) is a key. Linked sets differ in at most k blocks, so they agree in more than spare
of them. In one order of all keys, empty blocks first and then those that most rows have, every set
gives up its first spare keys. The last key that two linked sets have in common is after at least spare
others, so both keep it: nothing is lost, and what is kept is rare. A key that only one set holds is last
in the order and meets nothing, so most sets are out of the join here.

Sets that are left meet their keys' hubs (three members of each key, chosen by hash): each set is compared with
the hubs that it shares most keys with, and components are found. Keys that still hold several components are
gathered under their first hub, whose sets are dealt to blocks; every pair of blocks is compared in one task. There
the sketches' Hamming distance, over 64 bits for each allowed difference, refuses pairs; the others are verified on
the whole sets, nearest first, as long as they lie between different components. Only links that make two components one
are given out, fewer than the components of the two blocks. So equal sets share a node from the start, linked copies never
form pairs, and no link between components is missed. What grows with the square of a group is the count
of Hamming distances between different components of one hub, and beyond DEALT_BLOCKS * BLOCK_ROWS sets the copies of sets.

Cases: sets of null, empty or blank texts are empty and link with nothing; under n words the whole text is
one shingle; of rows with one doc_id and different texts each gets the component of its own text; a null
doc_id links with nothing; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadloom.llm.common import as_bytes, forgotten, released, tokens, written
from leadloom.llm.components import components

#: Width of a size band: its upper end over its lower end.
BAND = 1.3
#: A sketch has 64 bits for each difference that linked sets may have, and this many times 64 at least.
LEAST_SKETCH = 32
#: Candidate documents whose ids may be broadcast (a few MB); above it their texts are joined by shuffle.
BROADCAST_ROWS = 500_000

#: The sets under one hub are dealt to blocks, and each pair of blocks is a task's group: up to DEALT_BLOCKS blocks of LEAST_ROWS sets or more, so that
#: a hub's sets are copied that often; more where a block would pass BLOCK_ROWS sets or about BLOCK_BYTES.
LEAST_ROWS, DEALT_BLOCKS, BLOCK_ROWS, BLOCK_BYTES = 128, 32, 4096, 1 << 24
#: Keys are compared in so many passes over the written profiles, each with the keys of one remainder, so that a shuffle holds a part of all keys.
KEY_PASSES = 4

_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit integers."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def shingle_set(text: bytes | None, n: int) -> np.ndarray:
    """The sorted distinct hashes of a text's word n-grams."""
    words = tokens(text)
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < n:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=len(words))], np.uint64)
    digest = xxhash.xxh3_64_digest
    hashes = np.frombuffer(b"".join([digest(w) for w in words]), ">u8").astype(np.uint64)
    last = len(words) - n + 1
    total = np.zeros(last, np.uint64)
    for k in range(n):
        total = mixed(total + hashes[k : k + last] * _MULTIPLIERS[k % 5])
    return np.unique(total)


def node_of(s: np.ndarray) -> int:
    return int.from_bytes(xxhash.xxh3_128_digest(s.tobytes())[:8], "big", signed=True)


class Layout:
    """Bands of sizes, and what a set holds in each: keys and a sketch."""

    def __init__(self, percent: int):
        self.percent = percent
        self.lows = [1]

    def low(self, band: int) -> int:
        """The smallest size of a band; the one below the next band's is its largest."""
        while len(self.lows) <= band:
            self.lows.append(max(self.lows[-1] + 1, int(self.lows[-1] * BAND)))
        return self.lows[band]

    def band(self, size: int) -> int:
        while self.lows[-1] <= size:
            self.low(len(self.lows))
        return int(np.searchsorted(self.lows, size, side="right")) - 1

    def most_different(self, band: int) -> int:
        """The largest symmetric difference of linked sets in a band: both below its upper end."""
        both = 2 * (self.low(band + 1) - 1)
        return (100 - self.percent) * both // (100 + self.percent)

    def bands(self, size: int) -> list[int]:
        """Bands that a set of this size may meet a partner in; where only equal sets link there is nothing to key."""
        own = band = self.band(size)
        found = []
        while band == own or 100 * size >= self.percent * self.low(band):
            if self.most_different(band):
                found.append(band)
            band += 1
        return found

    def spare(self, band: int) -> int:
        return self.most_different(band) // 4 + 2

    def keys(self, s: np.ndarray) -> list[tuple[int, int, np.ndarray]]:
        """Per band: the band, how many keys the set still has to give up, and its keys. Empty blocks are given up here."""
        found = []
        for band in self.bands(len(s)):
            spare = self.spare(band)
            blocks = self.most_different(band) + 1 + spare
            at = (s % np.uint64(blocks)).astype(np.int64)
            order = np.argsort(at, kind="stable")
            counts = np.bincount(at, minlength=blocks)
            full, empty = np.flatnonzero(counts), np.flatnonzero(counts == 0)
            parity = np.zeros(blocks, np.uint64)
            parity[full] = np.bitwise_xor.reduceat(mixed(s)[order], (np.cumsum(counts) - counts)[full])
            chosen = np.concatenate([empty[spare:], full])
            found.append((band, max(0, spare - len(empty)), mixed(parity[chosen] + mixed(np.uint64(band * 2**32) + chosen.astype(np.uint64)))))
        return found

    def sketch(self, s: np.ndarray, band: int) -> np.ndarray:
        """The parity sketch of a set in a band, in 64-bit words."""
        bits = np.bincount((mixed(s) % np.uint64(64 * max(LEAST_SKETCH, self.most_different(band)))).astype(np.int64), minlength=64 * max(LEAST_SKETCH, self.most_different(band)))
        return np.packbits((bits & 1).astype(np.uint8)).view(np.int64)


def _lists(parts: list[np.ndarray], kind: np.dtype = np.int64) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, parts)]), pa.int32()), pa.array(np.concatenate([np.zeros(0, kind), *parts])))


def profiles(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """doc_id, n_shingles, node (a digest of the set) and keys by band of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        layout = Layout(percent)
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                sizes, nodes, bands, cuts = [], [], [], [0]
                for text in part.column("text"):
                    s = shingle_set(text.as_py(), n)
                    sizes.append(len(s))
                    nodes.append(node_of(s))
                    bands += layout.keys(s) if len(s) else []
                    cuts.append(len(bands))
                fields = [pa.array([b for b, _, _ in bands], pa.int32()), pa.array([x for _, x, _ in bands], pa.int32()), _lists([k.view(np.int64) for _, _, k in bands])]
                listed = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.StructArray.from_arrays(fields, ["band", "spared", "keys"]))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(nodes, pa.int64()), listed], ["doc_id", "n_shingles", "node", "bands"])

    rows = docs.select("doc_id", as_bytes().alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_shingles long, node long, bands array<struct<band:int,spared:int,keys:array<long>>>")


def _sets(docs: DataFrame, wanted: DataFrame, n: int, percent: int) -> DataFrame:
    """node, row, size, items (the set as bytes) and sketches by band of the wanted nodes, from a document of each (doc_id, node).

    A node comes once for each row that repeats its document; row tells them apart.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        layout, at = Layout(percent), TaskContext.get().partitionId() << 32
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                nodes, sets = [], []
                for text, node in zip(part.column("text"), part.column("node").to_pylist(), strict=True):
                    s = shingle_set(text.as_py(), n)
                    if node_of(s) == node:  # a doc_id that is repeated with another text brings that text along
                        nodes.append(node)
                        sets.append(s)
                bands = [layout.bands(len(s)) for s in sets]
                flat = [(b, layout.sketch(s, b)) for s, own in zip(sets, bands, strict=True) for b in own]
                fields = pa.StructArray.from_arrays([pa.array([b for b, _ in flat], pa.int32()), _lists([x for _, x in flat])], ["band", "sketch"])
                listed = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, bands)]), pa.int32()), fields)
                own = pa.array([layout.band(len(s)) for s in sets], pa.int32())
                number = pa.array(np.arange(at, at + len(nodes)), pa.int64())
                at += len(nodes)
                yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), number, pa.array([len(s) for s in sets], pa.int64()), own, pa.array([s.tobytes() for s in sets], pa.binary()), listed], ["node", "row", "size", "own", "items", "sketches"])

    few = wanted.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    rows = docs.select("doc_id", as_bytes().alias("text")).join(F.broadcast(wanted) if few else wanted.hint("merge"), "doc_id")
    return rows.mapInArrow(run, "node long, row long, size long, own int, items binary, sketches array<struct<band:int,sketch:array<long>>>")


def _distance(x: Column, y: Column) -> Column:
    """The Hamming distance of two sketches."""
    return F.aggregate(F.zip_with(x, y, lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda total, count: total + count)


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those pairs (a, b) of nodes whose sets reach the similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    first = sets.select(F.col("node").alias("b"), F.col("items").alias("y"))
    second = sets.select(F.col("node").alias("a"), F.col("items").alias("x"))
    return pairs.select("a", "b").join(first, "b").join(second, "a").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def _blocks(open_: DataFrame) -> DataFrame:
    """hub, band, blocks: how many blocks the sets of a hub are dealt to."""
    n, size = F.count("*"), F.sum(F.col("size") * 10 + 256)
    few = F.least(F.lit(DEALT_BLOCKS), F.ceil(n / LEAST_ROWS))
    return open_.groupBy("hub", "band").agg(F.greatest(few, F.ceil(n / BLOCK_ROWS), F.ceil(size / BLOCK_BYTES)).cast("int").alias("blocks"))


def linked(block: np.ndarray, component: np.ndarray, sizes: np.ndarray, own: np.ndarray, sketches: np.ndarray, sets: list[np.ndarray], band: int, percent: int) -> list[tuple[int, int]]:
    """Links between rows of two blocks (or within one, where all rows are of one) that make different components one.

    Of the pairs that the sketches leave in play, those are verified on the whole sets that still lie in different components.
    """
    found, label = [], np.unique(component, return_inverse=True)[1].reshape(-1)
    left = np.flatnonzero(block == block.min())
    right = np.flatnonzero(block == block.max())
    for k in left.tolist():
        among = right[(label[right] != label[k]) & (np.maximum(own[right], own[k]) == band)]
        among = among[among > k] if len(left) == len(block) else among
        small, large = np.minimum(sizes[among], sizes[k]), np.maximum(sizes[among], sizes[k])
        among = among[100 * small >= percent * large]
        distance = np.bitwise_count(sketches[among] ^ sketches[k]).sum(axis=1, dtype=np.int64)
        in_play = (100 + percent) * distance <= (100 - percent) * (sizes[among] + sizes[k])
        for j in among[in_play][np.argsort(distance[in_play], kind="stable")].tolist():
            if label[j] != label[k]:
                both = len(np.intersect1d(sets[k], sets[j], assume_unique=True))
                if 100 * both >= percent * (len(sets[k]) + len(sets[j]) - both):
                    found.append((k, j))
                    label[label == label[j]] = label[k]
    return found


def _links(open_: DataFrame, blocks: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) that connect the components under each hub, as each pair of its blocks finds them."""

    def run(table: pa.Table) -> pa.Table:
        nodes, items = table.column("node").to_numpy(), table.column("items").to_pylist()
        if len(set(table.column("component").to_pylist())) > 1:
            sketches = table.column("sketch").combine_chunks().flatten().to_numpy().view(np.uint64).reshape(len(nodes), -1)
            columns = (table.column(c).to_numpy() for c in ("block", "component", "size", "own"))
            found = linked(*columns, sketches, [np.frombuffer(x, np.uint64) for x in items], table.column("band")[0].as_py(), percent)
        else:
            found = []
        at = np.array(found, np.int64).reshape(-1, 2)
        return pa.table({"a": pa.array(nodes[at[:, 0]], pa.int64()), "b": pa.array(nodes[at[:, 1]], pa.int64())})

    dealt = open_.join(blocks, ["hub", "band"]).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other")).drop("blocks", "other")
    return dealt.groupBy("hub", "band", "i", "j").applyInArrow(run, "a long, b long")


def _stars(found: DataFrame) -> DataFrame:
    """Components as edges."""
    return found.select(F.col("node").alias("a"), F.col("component").alias("b"))


def join(docs: DataFrame, n: int = 4, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles and component_id of every document."""
    spark, paths = docs.sparkSession, []

    def kept(df: DataFrame, name: str) -> DataFrame:
        table, path = written(df, name)
        paths.append(path)
        return table

    prof, prof_path = written(profiles(docs, n, percent), "profiles")
    slim, _ = written(prof.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0), F.col("node")).alias("node")), "nodes")
    real = prof.where("doc_id is not null and n_shingles > 0")
    keyed = real.select("node", F.explode("bands").alias("at")).select("node", "at.band", "at.spared", F.explode("at.keys").alias("key"))
    parts = []
    for k in range(KEY_PASSES):
        some = keyed.where(F.pmod("key", F.lit(KEY_PASSES)) == k)
        shared = some.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high"), F.count("*").alias("rows")).where("low != high")
        shared = kept(shared.select("key", "rows"), "shared")
        forgotten(spark)  # the shuffle of this pass's keys
        # Written before copies are collapsed, so that the join can split hot keys and the collapse starts map-side.
        parts.append(kept(some.join(shared, "key"), "met"))
        del some, shared
        forgotten(spark)
    del keyed, real, prof
    released(spark, prof_path)
    met = reduce(DataFrame.unionAll, parts)
    met = kept(met.distinct(), "unique")
    frequent = Window.partitionBy("node", "band").orderBy(F.desc("rows"), "key")
    rare = kept(met.withColumn("place", F.row_number().over(frequent)).where("place > spared").select("key", "node", "band"), "rare")
    by_hash = F.struct(F.xxhash64("node"), F.col("node"))
    hubs = rare.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high"), F.min(by_hash)["node"].alias("other")).where("low != high")
    members = kept(rare.join(kept(hubs, "hubs"), "key"), "members")

    ids = kept(slim.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("smallest")), "ids")
    wanted = kept(ids.join(members.select("node").distinct(), "node").select("node", F.col("smallest").alias("doc_id")), "wanted")
    sets = kept(_sets(docs, wanted, n, percent), "sets")
    # Sets are wide: where documents are repeated, the first row of each node is found from two narrow columns.
    repeated = kept(sets.groupBy("node").agg(F.min("row").alias("first"), F.count("*").alias("times")).where("times > 1").select("node", "first"), "repeated")
    if not repeated.isEmpty():
        sets = kept(sets.join(repeated, "node", "left").where("first is null or row = first").drop("first"), "sets")
    sketches = kept(sets.select("node", "size", "own", F.explode("sketches").alias("at")).select("node", "size", "own", "at.band", "at.sketch"), "sketches")

    def side(name: str) -> DataFrame:
        return sketches.select(F.col("node").alias(name), "band", *(F.col(c).alias(f"{c}_{name}") for c in ("size", "own", "sketch")))

    reachable = F.lit(100) * F.least("size_a", "size_b") >= F.lit(percent) * F.greatest("size_a", "size_b")
    distance = _distance(F.col("sketch_a"), F.col("sketch_b"))
    in_play = reachable & ((100 + percent) * distance <= (100 - percent) * (F.col("size_a") + F.col("size_b")))

    # Every set against those hubs of each kind that it shares most keys with.
    met_hubs = members.select("node", "band", F.posexplode(F.array("low", "high", "other")).alias("kind", "hub")).where("node != hub")
    nearest = met_hubs.groupBy("node", "band", "kind", "hub").count().groupBy("node", "kind").agg(F.max(F.struct("count", "hub", "band")).alias("m"))
    first = kept(nearest.select(F.least("node", "m.hub").alias("a"), F.greatest("node", "m.hub").alias("b"), "m.band").distinct(), "first")
    first = kept(first.join(side("a"), ["a", "band"]).join(side("b"), ["b", "band"]).where(in_play).select("a", "b").distinct(), "first")
    found = kept(components(_verified(first, sets, percent)), "found")

    def component(df: DataFrame, node: str, name: str) -> DataFrame:
        """df with the component of a column of nodes."""
        labels = found.select(F.col("node").alias(node), F.col("component").alias(name))
        return df.join(labels, node, "left").withColumn(name, F.coalesce(name, node))

    # Keys that hold several components: their sets, under the first hub.
    placed = kept(component(members.select("key", "low", "band", "node"), "node", "component"), "placed")
    mixed_keys = placed.groupBy("key").agg(F.min("component").alias("least"), F.max("component").alias("most")).where("least != most").select("key")
    open_ = kept(placed.join(kept(mixed_keys, "mixed"), "key").select(F.col("low").alias("hub"), "band", "node", "component").distinct(), "open")
    own_sketch = F.filter("sketches", lambda x: x["band"] == F.col("band"))[0]["sketch"]
    open_ = kept(open_.join(sets, "node").select("hub", "band", "node", "component", "size", "own", "items", own_sketch.alias("sketch")), "open")
    links = kept(_links(open_, kept(_blocks(open_), "blocks"), percent), "edges")
    if not links.isEmpty():
        found = kept(components(_stars(found).unionAll(links)), "found")

    grouped = kept(component(ids, "node", "component"), "grouped")
    smallest = kept(grouped.groupBy("component").agg(F.min("smallest").alias("component_id")), "smallest")
    classes, _ = written(grouped.join(smallest, "component").select("node", "component_id"), "classes")
    released(spark, *paths)
    return slim.join(classes, "node", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
