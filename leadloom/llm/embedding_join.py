"""Embedding near-duplicates by an epsilon grid order join.

For unit vectors a cosine of at least c means a distance of at most eps = sqrt(2 - 2c). Vectors are
rotated to the principal axes of all vectors (of their spread about the mean), sorted by grid cells on the leading axes, and cut into
blocks of consecutive vectors with bounding boxes over all axes. Blocks meet if they share a cell of
the first axis (an equi-join) and their boxes are within eps; in a pair of blocks, sequence intervals
are halved and joined recursively, skipping intervals whose boxes are farther apart than eps, down to
LEAF vectors whose cosines are computed. A pair of blocks gives, for each vector, how many it links
with, and a label for each connected piece, never the linked pairs themselves; so a large group of
copies costs its comparisons but not its pairs. Equal vectors are one class with a weight.

Boxes are compared with a margin for rounding, and cosines are those of the unrotated vectors in double
precision. Where the axes tell little (data spread evenly over many axes), few blocks can be skipped
and the join compares most blocks; results are the same.

Cases: vectors that are null, empty, zero, or hold null or non-finite numbers link with nothing, nor do
rows with a null vec_id; vectors of different lengths don't link; a repeated row is another vector with
the same id; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadloom.llm.common import released, written
from leadloom.llm.components import components

#: Vectors in a block, and in an interval that isn't halved any more.
BLOCK, LEAF = 2048, 256
#: Leading axes that the order uses, and the most numbers in a vector for which axes are computed.
ORDER_AXES, MOST_AXES = 8, 1024
MARGIN = 1e-9


def units(raw: bytes) -> np.ndarray:
    v = np.frombuffer(raw, np.float64)
    return v / math.sqrt(float(v @ v))


def vectors(table: DataFrame) -> DataFrame:
    """vec_id, raw (doubles), dims and node (a digest of raw, null for vectors that can't link) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raws, dims, nodes = [], [], []
            for v in batch.column("embedding"):
                raw = None
                if v.is_valid and len(v) and not v.values.null_count:
                    a = np.asarray(v.values.to_numpy(zero_copy_only=False), np.float64)
                    top = np.abs(a).max() if np.isfinite(a).all() else 0.0
                    if top > 0:
                        a = a if 1e-100 < top < 1e100 else a / top  # squares stay in range
                        raw = (a + 0.0).tobytes()
                raws.append(raw)
                dims.append(len(raw) // 8 if raw else 0)
                nodes.append(xxhash.xxh3_64_intdigest(raw) - 2**63 if raw else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), pa.array(raws, pa.binary()), pa.array(dims, pa.int32()), pa.array(nodes, pa.int64())], ["vec_id", "raw", "dims", "node"]
            )

    return table.select("vec_id", "embedding").mapInArrow(run, "vec_id long, raw binary, dims int, node long")


def principal_axes(classes: DataFrame, dims: int) -> np.ndarray:
    """The axes (columns) of vectors with dims numbers, by falling spread about their mean. The driver gets dims * (dims + 1) sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Row dims holds the sums of the vectors themselves.
        total = np.zeros((dims + 1, dims))
        for batch in batches:
            x = np.array([units(r.as_py()) for r in batch.column("raw")])
            total[:dims] += x.T @ x
            total[dims] += x.sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(dims + 1, dtype=np.int32), dims)), pa.array(np.tile(np.arange(dims, dtype=np.int32), dims + 1)), pa.array(total.ravel())], ["i", "j", "v"])

    same = classes.where(F.col("dims") == dims)
    sums = same.select("raw").mapInArrow(run, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v"))
    found = np.zeros((dims + 1, dims))
    for r in sums.collect():
        found[r.i, r.j] = r.v
    # Where all vectors share a direction, that direction tells them apart no more than their mean does: spread is taken about the mean.
    matrix = found[:dims] - np.outer(found[dims], found[dims]) / max(1, same.count())
    return np.linalg.eigh((matrix + matrix.T) / 2)[1][:, ::-1]


def blocks(classes: DataFrame, axes: np.ndarray | None, eps: float) -> DataFrame:
    """Blocks in grid order: block, dims, lo and hi (corners of the box), nodes, weights and raw as bytes."""

    def rotated(x: np.ndarray) -> np.ndarray:
        return x @ axes if axes is not None and x.shape[1] == len(axes) else x

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for r in batch.column("raw"):
                x = rotated(units(r.as_py())[None, :])[0, :ORDER_AXES]
                found.append(np.floor(x / eps).astype(np.int32).tolist())
            yield batch.append_column("cells", pa.array(found, pa.list_(pa.int32())))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = 0, []

        def out() -> pa.RecordBatch:
            nonlocal at, held
            nodes, weights, raws = zip(*held, strict=True)
            x = rotated(np.array([units(r) for r in raws]))
            row = [TaskContext.get().partitionId() << 32 | at, x.shape[1], x.min(axis=0).tolist(), x.max(axis=0).tolist(), np.array(nodes, np.int64).tobytes(), np.array(weights, np.int64).tobytes(), b"".join(raws)]
            at, held = at + 1, []
            kinds = (pa.int64(), pa.int32(), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.binary(), pa.binary(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, kinds, strict=True)], ["block", "dims", "lo", "hi", "nodes", "weights", "raw"])

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("node", "members", "raw")), strict=True):
                if held and (len(held) == BLOCK or len(held[-1][2]) != len(row[2])):
                    yield out()
                held.append(row)
        if held:
            yield out()

    ordered = classes.select("node", "members", "dims", "raw").mapInArrow(cells, "node long, members long, dims int, raw binary, cells array<int>")
    ordered = ordered.repartitionByRange("dims", "cells", "node").sortWithinPartitions("dims", "cells", "node")
    return ordered.mapInArrow(cut, "block long, dims int, lo array<double>, hi array<double>, nodes binary, weights binary, raw binary")


def near_blocks(table: DataFrame, eps: float) -> DataFrame:
    """Pairs (a, b) of blocks, a <= b, whose boxes are within eps."""
    meta = table.select("block", "dims", "lo", "hi")
    cell = lambda x: F.floor(x / eps).cast("int")
    a = meta.select(F.col("block").alias("a"), "dims", F.col("lo").alias("alo"), F.col("hi").alias("ahi"), F.explode(F.sequence(cell(F.col("lo")[0]), cell(F.col("hi")[0]))).alias("cell"))
    b = meta.select(F.col("block").alias("b"), "dims", F.col("lo").alias("blo"), F.col("hi").alias("bhi"), F.explode(F.sequence(cell(F.col("lo")[0] - eps), cell(F.col("hi")[0] + eps))).alias("cell"))
    gap = lambda lo, hi: F.zip_with(lo, hi, lambda x, y: F.greatest(F.lit(0.0), x - y))
    square = F.aggregate(F.zip_with(gap("alo", "bhi"), gap("blo", "ahi"), lambda x, y: x * x + y * y), F.lit(0.0), lambda s, x: s + x)
    return a.join(b, ["dims", "cell"]).where("a <= b").where(square <= eps * eps + MARGIN).select("a", "b").distinct()


class Interval:
    """A sequence interval of a block: where it is, and its box on the leading axes of the block pair."""

    def __init__(self, x: np.ndarray, start: int, stop: int):
        self.start, self.stop = start, stop
        self.lo, self.hi = x[start:stop].min(axis=0), x[start:stop].max(axis=0)
        middle = (start + stop) // 2
        self.halves = (Interval(x, start, middle), Interval(x, middle, stop)) if stop - start > LEAF else ()


def _apart(a: Interval, b: Interval) -> float:
    gap = np.maximum(0, np.maximum(a.lo - b.hi, b.lo - a.hi))
    return float(gap @ gap)


def _leaves(a: Interval, b: Interval, same: bool, limit: float) -> Iterator[tuple[Interval, Interval, bool]]:
    """Pairs of intervals of at most LEAF vectors that aren't provably distant."""
    if _apart(a, b) > limit:
        return
    if not a.halves and not b.halves:
        yield a, b, same
    elif same:
        x, y = a.halves
        yield from _leaves(x, x, True, limit)
        yield from _leaves(x, y, False, limit)
        yield from _leaves(y, y, True, limit)
    elif a.stop - a.start >= b.stop - b.start:
        for x in a.halves:
            yield from _leaves(x, b, False, limit)
    else:
        for y in b.halves:
            yield from _leaves(a, y, False, limit)


def links(pairs: DataFrame, table: DataFrame, axes: np.ndarray | None, cosine: float) -> DataFrame:
    """For pairs of blocks: node, links (weights of the nodes it links with there) and label (a node of its connected piece)."""
    limit = 2 - 2 * cosine + MARGIN

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                get = lambda c: batch.column(c)[k].as_py()  # noqa: B023, E731
                same = get("a") == get("b")
                sides = []
                for s in "ab"[: 1 if same else 2]:
                    nodes = np.frombuffer(get(f"{s}nodes"), np.int64)
                    v = np.frombuffer(get(f"{s}raw"), np.float64).reshape(len(nodes), -1)
                    x = v / np.sqrt(np.einsum("ij,ij->i", v, v))[:, None]
                    turned = x @ axes if axes is not None and x.shape[1] == len(axes) else x
                    sides.append((nodes, np.frombuffer(get(f"{s}weights"), np.int64), x, Interval(turned, 0, len(x))))
                (an, aw, ax, ai), (bn, bw, bx, bi) = sides[0], sides[-1]
                offset = 0 if same else len(an)
                counts, hits = np.zeros(offset + len(bn), np.int64), []
                for p, q, self_pair in _leaves(ai, bi, same, limit):
                    i, j = np.nonzero(ax[p.start : p.stop] @ bx[q.start : q.stop].T >= cosine)
                    i, j = i + p.start, j + q.start
                    if self_pair:
                        i, j = i[i < j], j[i < j]
                    if len(i):
                        np.add.at(counts, i, bw[j])
                        np.add.at(counts, j + offset, aw[i])
                        hits.append((i, j + offset))
                if not hits:
                    continue
                i, j = (np.concatenate(x) for x in zip(*hits, strict=True))
                labels = np.arange(len(counts))
                while True:  # smallest place that is reached
                    low = np.minimum(labels[i], labels[j])
                    before = labels.copy()
                    np.minimum.at(labels, i, low)
                    np.minimum.at(labels, j, low)
                    labels = labels[labels]
                    if (labels == before).all():
                        break
                linked, nodes = np.flatnonzero(counts), an if same else np.concatenate([an, bn])
                yield pa.RecordBatch.from_arrays([pa.array(nodes[linked]), pa.array(counts[linked]), pa.array(nodes[labels[linked]])], ["node", "links", "label"])

    side = lambda s: table.select(F.col("block").alias(s), *(F.col(c).alias(s + c) for c in ("nodes", "weights", "raw")))
    joined = pairs.join(side("a"), "a").join(side("b"), "b")
    return joined.mapInArrow(run, "node long, links long, label long")


def join(table: DataFrame, cosine: float = 0.9) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row."""
    spark, eps = table.sparkSession, math.sqrt(2 - 2 * cosine)
    rows, _ = written(vectors(table), "vectors")
    real = rows.where("node is not null and vec_id is not null")
    classes, classes_path = written(real.groupBy("node", "dims", "raw").agg(F.min("vec_id").alias("least"), F.count("*").alias("members")), "classes")
    most = classes.where(F.col("dims") <= MOST_AXES).groupBy("dims").count().orderBy(F.desc("count"), "dims").first()
    axes = principal_axes(classes, most["dims"]) if most else None
    cut, cut_path = written(blocks(classes, axes, eps), "blocks")
    pairs, pairs_path = written(near_blocks(cut, eps), "pairs")
    found, found_path = written(links(pairs, cut, axes, cosine), "links")
    totals = found.groupBy("node").agg(F.sum("links").alias("links"))
    pieces = components(found.where("node != label").select(F.col("node").alias("a"), F.col("label").alias("b")))
    placed = classes.join(totals, "node", "left").join(pieces, "node", "left")
    placed, placed_path = written(
        placed.select("node", "least", (F.coalesce("links", F.lit(0)) + F.col("members") - 1).alias("n_links"), F.coalesce("component", "node").alias("component")), "placed"
    )
    smallest = placed.groupBy("component").agg(F.min("least").alias("component_id"))
    done, _ = written(placed.join(smallest, "component").select("node", "n_links", "component_id"), "done")
    released(spark, classes_path, cut_path, pairs_path, found_path, placed_path)
    kept = rows.select("vec_id", F.when(F.col("vec_id").isNotNull(), F.col("node")).alias("node")).join(done, "node", "left")
    component = F.coalesce("component_id", "vec_id")
    return kept.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))


#: Brute force; components are found by walking the links from each vector.
ORACLE_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
), ok AS (
  SELECT vec_id, e FROM v
  WHERE e IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_sum(list_transform(e, lambda x: x * x)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.9
), reach AS (
  SELECT vec_id AS start, vec_id AS node FROM embeddings
  UNION
  SELECT reach.start, links.b FROM reach JOIN links ON reach.node = links.a
), component AS (
  SELECT start, min(node) AS component_id FROM reach GROUP BY start
)
SELECT e.vec_id, (SELECT count(*) FROM links WHERE a = e.vec_id) AS n_links, c.component_id, e.vec_id = c.component_id AS kept
FROM embeddings e JOIN component c ON c.start = e.vec_id
"""
