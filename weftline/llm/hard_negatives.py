"""Hard negatives from Hilbert-ordered blocks of vectors with zone maps.

Vectors are rounded to integers and ordered along a Hilbert curve through their
dimensions of the greatest variance. Each range of the curve is a bucket of a Parquet
table, and each row of it a block of neighbours with the least and greatest value per
dimension. Interval arithmetic over these bounds every inner product of an anchor with
a block: a bucket without a block that can matter to an anchor of the chunk at hand is
not read, and a block is unpacked only for anchors that it can matter to. All scores
are exact integers.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.ranks import global_rank
from ..functions.staging import shared_dir
from .common import python_batches, stage

#: Dimensions of the curve and bits of each.
CURVE_DIMS, CURVE_BITS = 10, 6
#: Rows of a block; least rows of a bucket, and the most buckets (they grow instead).
BLOCK_ROWS, BUCKET_ROWS, MOST_BUCKETS = 256, 8192, 4096
#: Anchors that one pass over the blocks serves; they and what is known of them are broadcast.
CHUNK_ANCHORS = 2000
#: Candidates that a task holds before it reduces them to the best.
HELD = 200_000
#: A hundred times an inner product stays within 63 bits.
_MOST_SQUARE = 1 << 56
#: Inner products up to here are exact in floating point.
_EXACT = float(1 << 53)

RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
BLOCK = "bucket int, block long, labels array<int>, lo array<long>, hi array<long>, rows binary, ids binary, row_labels binary, anchors binary, components binary"


def _block_schema() -> pa.Schema:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "array<int>": pa.list_(pa.int32()), "array<long>": pa.list_(pa.int64())}
    return pa.schema([(name, kinds[kind]) for name, kind in (c.split(" ") for c in BLOCK.split(", "))])


def integer_vectors(vectors: DataFrame, is_anchor: Column, scale: int, most_dims: int) -> DataFrame:
    """``vec_id, label, c, anchor`` of the rows that take part: components are ``floor(scale * x)``."""
    limit = int((_MOST_SQUARE / max(1, most_dims)) ** 0.5)
    value = lambda x: F.floor(F.lit(float(scale)) * x.cast("double"))
    finite = F.forall("embedding", lambda x: F.coalesce(~F.isnan(x) & (F.abs(F.lit(float(scale)) * x.cast("double")) <= limit), F.lit(False)))
    rows = vectors.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull()).filter(finite)
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("int").alias("label"), F.transform("embedding", value).alias("c"), F.coalesce(is_anchor, F.lit(False)).alias("anchor"))


def _matrix(column, dims: int) -> np.ndarray:
    """A list column as a matrix; missing components are 0."""
    out = np.zeros((len(column), dims), np.int64)
    sizes = np.diff(column.offsets.to_numpy())
    if dims:
        out[np.arange(dims) < sizes[:, None]] = column.flatten().to_numpy()
    return out


def _dimensions(rows: DataFrame, dims: int) -> list[tuple[int, int, int]]:
    """The dimensions of the curve, of the greatest variance, with their least and greatest value: one row a dimension comes to the driver."""

    def sums(batches):
        for batch in batches:
            c = _matrix(batch.column("c"), dims)
            if len(c):
                x = c.astype(float)
                yield pa.RecordBatch.from_arrays([pa.array(range(dims), pa.int32()), pa.array([float(len(c))] * dims), pa.array(x.sum(0)), pa.array((x * x).sum(0)), pa.array(c.min(0)), pa.array(c.max(0))], names=["d", "n", "s", "q", "lo", "hi"])

    by = rows.select("c").mapInArrow(sums, "d int, n double, s double, q double, lo long, hi long").groupBy("d")
    per = by.agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"), F.min("lo").alias("lo"), F.max("hi").alias("hi")).collect()
    per.sort(key=lambda r: (-(r["q"] / r["n"] - (r["s"] / r["n"]) ** 2), r["d"]))
    return [(r["d"], r["lo"], r["hi"]) for r in per[:CURVE_DIMS]]


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Places on the Hilbert curve of points with coordinates below ``2**bits``, a row a point.

    The coordinates become the transposed index by undoing the exchanges and
    inversions of each level from the top, then by Gray coding.
    """
    x = np.array(cells.T, dtype=np.int64)
    key = np.zeros(cells.shape[0], np.int64)
    if not len(x):
        return key
    for level in range(bits - 1, 0, -1):
        below = (1 << level) - 1
        for i in range(len(x)):
            set_ = (x[i] >> level & 1).astype(bool)
            swap = np.where(set_, 0, (x[0] ^ x[i]) & below)
            x[0] ^= np.where(set_, below, swap)
            x[i] ^= swap
    for i in range(1, len(x)):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(key)
    for level in range(bits - 1, 0, -1):
        flip ^= np.where(x[-1] >> level & 1, (1 << level) - 1, 0)
    x ^= flip
    for level in range(bits - 1, -1, -1):
        for row in x:
            key = key << 1 | (row >> level & 1)
    return key


def write_blocks(vectors: DataFrame, is_anchor: Column, path: str, scale: int = 256) -> tuple[int, int]:
    """Write the blocks of ``vectors`` under ``path``, a folder a bucket; the rows in them and the dimensions."""
    spark = vectors.sparkSession
    python_batches(spark)
    dims = vectors.agg(F.max(F.size("embedding"))).first()[0] or 0
    dims = max(dims, 0)
    rows = stage(integer_vectors(vectors, is_anchor, scale, dims), "vectors")
    n = rows.count()
    axes = _dimensions(rows, dims) if n and dims else []

    def placed(batches):
        for batch in batches:
            c = _matrix(batch.column("c"), dims)
            cells = np.zeros((len(c), len(axes)), np.int64)
            for k, (d, lo, hi) in enumerate(axes):
                cells[:, k] = (c[:, d] - lo) * ((1 << CURVE_BITS) - 1) // max(1, hi - lo)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(hilbert(cells, CURVE_BITS))], names=[*batch.schema.names, "curve"])

    def blocks(batches):
        bucket, at, block, held, left = TaskContext.get().partitionId(), 0, 0, [], 0

        def packed(table):
            nonlocal at, block
            c, labels = _matrix(table.column("c").combine_chunks(), dims), table.column("label").to_numpy()
            numbers = (bucket << 40) + at + np.arange(len(c))
            at, block = at + len(c), block + 1
            plain = lambda v, kind: np.ascontiguousarray(v, kind).tobytes()
            row = {"bucket": bucket, "block": (bucket << 32) + block, "labels": np.unique(labels).tolist(), "lo": c.min(0).tolist(), "hi": c.max(0).tolist(), "rows": plain(numbers, "<i8"), "ids": plain(table.column("vec_id").to_numpy(), "<i8"), "row_labels": plain(labels, "<i4"), "anchors": plain(table.column("anchor").to_numpy(zero_copy_only=False), "u1"), "components": plain(c, "<i4")}
            return pa.RecordBatch.from_pylist([row], schema=_block_schema())

        for batch in batches:
            held.append(batch)
            left += batch.num_rows
            if left >= BLOCK_ROWS:
                table = pa.Table.from_batches(held)
                for k in range(0, left - left % BLOCK_ROWS, BLOCK_ROWS):
                    yield packed(table.slice(k, BLOCK_ROWS))
                table = table.slice(left - left % BLOCK_ROWS)
                held, left = table.to_batches() if len(table) else [], len(table)
        if left:
            yield packed(pa.Table.from_batches(held))

    buckets = max(1, -(-n // max(BUCKET_ROWS, n // MOST_BUCKETS)))
    # equal vectors under one id are told apart by their contents, so that the order is one
    order = ["curve", "vec_id", "label", "c"]
    curve = rows.mapInArrow(placed, T.StructType([*rows.schema.fields, T.StructField("curve", T.LongType())]))
    ranged = curve.repartitionByRange(buckets, *order[:2]).sortWithinPartitions(*order)
    ranged.mapInArrow(blocks, BLOCK).write.partitionBy("bucket").option("compression", "zstd").parquet(path)
    return n, dims


class _Block:
    """A block unpacked from its row."""

    def __init__(self, row: dict, dims: int):
        self.rows, self.ids = np.frombuffer(row["rows"], "<i8"), np.frombuffer(row["ids"], "<i8")
        self.labels = np.frombuffer(row["row_labels"], "<i4")
        self.anchors = np.frombuffer(row["anchors"], "u1").astype(bool)
        self.components = np.frombuffer(row["components"], "<i4").reshape(len(self.rows), dims).astype(np.int64)


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of the rows of two integer matrices."""
    most = max(1, a.shape[1]) * float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0))
    return np.rint(a.astype(float) @ b.astype(float).T).astype(np.int64) if most < _EXACT else a @ b.T


def score_bounds(anchors: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest inner product of each anchor with any vector between ``lo`` and ``hi``, by interval arithmetic."""
    up, down = np.maximum(anchors, 0), np.minimum(anchors, 0)
    return up @ lo + down @ hi, up @ hi + down @ lo


def _best(found: list[np.ndarray], groups: int, k: int) -> np.ndarray:
    """Of rows ``group, score, id, row`` the first ``k`` of each group by falling score, then id, then row."""
    all_ = np.concatenate(found) if found else np.zeros((0, 4), np.int64)
    all_ = all_[np.lexsort((all_[:, 3], all_[:, 2], -all_[:, 1], all_[:, 0]))]
    first = np.searchsorted(all_[:, 0], np.arange(groups))
    return all_[np.arange(len(all_)) - first[all_[:, 0]] < k]


class _Search:
    """The best ``k`` of each group among the blocks that a task reads.

    A group asks, for one anchor, for rows of its own or of other labels with scores
    from ``low`` to ``high``. ``least`` is what a score must reach to be among the best
    so far.
    """

    def __init__(self, chunk: dict, k: int, same_label: bool):
        self.c, self.labels, self.rows = chunk["c"], chunk["labels"], chunk["rows"]
        self.anchor, self.low, self.high = chunk["anchor"], chunk["low"], chunk["high"]
        self.k, self.same, self.least = k, same_label, chunk["low"].copy()
        self.found: list[np.ndarray] = []
        self.held = 0

    def asking(self, row: dict) -> np.ndarray:
        """The groups to which a block can matter, by its bounds and labels."""
        low, high = score_bounds(self.c, np.array(row["lo"], np.int64), np.array(row["hi"], np.int64))
        labels = np.array(row["labels"], np.int32)
        there = np.isin(self.labels, labels) if self.same else (len(labels) > 1) | ~np.isin(self.labels, labels)
        return np.flatnonzero(there[self.anchor] & (high[self.anchor] >= self.least) & (low[self.anchor] <= self.high))

    def read(self, row: dict, dims: int) -> None:
        groups = self.asking(row)
        if not len(groups):
            return
        block = _Block(row, dims)
        used, which = np.unique(self.anchor[groups], return_inverse=True)
        scores = _products(self.c[used], block.components)
        fits = (self.labels[used][:, None] == block.labels) == self.same
        fits &= self.rows[used][:, None] != block.rows
        scores, fits = scores[which], fits[which]
        fits &= (scores >= self.least[groups][:, None]) & (scores <= self.high[groups][:, None])
        if fits.shape[1] > self.k:
            # no more than the best k, and all that tie with the last of them
            kept = np.where(fits, scores, np.iinfo(np.int64).min)
            fits &= scores >= np.partition(kept, fits.shape[1] - self.k, axis=1)[:, fits.shape[1] - self.k][:, None]
        g, at = np.nonzero(fits)
        self.found.append(np.stack([groups[g], scores[g, at], block.ids[at], block.rows[at]], axis=1))
        self.held += len(g)
        if self.held > HELD:
            self.reduce()

    def reduce(self) -> np.ndarray:
        best = _best(self.found, len(self.low), self.k)
        count = np.bincount(best[:, 0], minlength=len(self.low))
        ends = np.cumsum(count)
        full = np.flatnonzero(count == self.k)
        self.least[full] = best[ends[full] - 1, 1]
        self.found, self.held = [best], 0
        return best


_ZONES = ("bucket", "labels", "lo", "hi")
_FOUND = "grp int, score long, id long, row_number long"


def _search(spark: SparkSession, path: str, dims: int, chunk: dict, k: int, same_label: bool) -> DataFrame:
    """The best ``k`` of each group of a chunk over all blocks: ``grp, score, id, row_number``, with ``place`` from 1.

    First the zone maps alone name the buckets to read (their number is bounded), then
    these are read; each task keeps its own best, and the last choice is among those.
    """
    table = spark.read.schema(BLOCK).parquet(path)
    shared = spark.sparkContext.broadcast(chunk)

    def needed(batches):
        search = _Search(shared.value, k, same_label)
        for batch in batches:
            rows = batch.to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array(sorted({r["bucket"] for r in rows if len(search.asking(r))}), pa.int32())], names=["bucket"])

    def read(batches):
        search = _Search(shared.value, k, same_label)
        for batch in batches:
            for row in batch.to_pylist():
                search.read(row, dims)
        best = search.reduce()
        yield pa.RecordBatch.from_arrays([pa.array(best[:, 0].astype(np.int32)), *[pa.array(np.ascontiguousarray(best[:, j])) for j in (1, 2, 3)]], names=["grp", "score", "id", "row_number"])

    buckets = [r["bucket"] for r in table.select(*_ZONES).mapInArrow(needed, "bucket int").distinct().collect()]
    found = table.filter(F.col("bucket").isin(buckets)).mapInArrow(read, _FOUND)
    order = Window.partitionBy("grp").orderBy(F.desc("score"), "id", "row_number")
    return found.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k)


def _anchors(spark: SparkSession, path: str, dims: int, positives: int) -> DataFrame:
    """The anchors by row number: ``row_number, vec_id, label, c, least``, where ``least`` is the score of the last positive in the anchor's own block, null for too few."""

    def found(batches):
        for batch in batches:
            for row in batch.to_pylist():
                block = _Block(row, dims)
                at = np.flatnonzero(block.anchors)
                scores = _products(block.components[at], block.components)
                least: list[int | None] = []
                for k, i in enumerate(at):
                    own = np.delete(scores[k], i)[np.delete(block.labels, i) == block.labels[i]]
                    least.append(int(np.partition(own, len(own) - positives)[len(own) - positives]) if len(own) >= positives else None)
                yield pa.RecordBatch.from_arrays([pa.array(block.rows[at]), pa.array(block.ids[at]), pa.array(block.labels[at]), pa.array(block.components[at].tolist(), pa.list_(pa.int64())), pa.array(least, pa.int64())], names=["row_number", "vec_id", "label", "c", "least"])

    blocks = spark.read.schema(BLOCK).parquet(path)
    return blocks.mapInArrow(found, "row_number long, vec_id long, label int, c array<long>, least long")


def hard_negatives(vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 10, low_pct: int = 30, high_pct: int = 90, scale: int = 256) -> DataFrame:
    """For each anchor and each of its positives the first negatives of a window of scores.

    ``vectors`` has ``vec_id, embedding, label``. Components become ``floor(scale * x)``; a score
    is an integer inner product, higher ones first, ties by ``vec_id``. An anchor's positives
    are its first ``positives`` other rows of the same label, its negatives for one of them the
    first ``negatives`` rows of other labels with ``low_pct * p <= 100 * score <= high_pct * p``
    for the positive's score p. Gives ``anchor_id, positive_id, rank, negative_id,
    positive_score, negative_score``; anchors without positives, and positives
    without negatives, have no rows.

    Rows with a null id, label or vector, with a null or non-finite component, or with one
    beyond ``2**28 / sqrt(dimensions)`` after scaling take no part. Shorter vectors are filled
    with zeros. Rows that repeat an id are rows of their own: an anchor given twice is
    answered twice. Further columns are not read. An empty table gives no rows.

    Anchors are asked in chunks along the curve, with a pass over the needed buckets for the
    positives and one for the negatives; results of a chunk are written when done.
    """
    spark = vectors.sparkSession
    folder = f"{shared_dir(spark)}/hard-negatives-{uuid.uuid4().hex}"
    n, dims = write_blocks(vectors, is_anchor, f"{folder}/blocks", scale)
    ranked = stage(global_rank(_anchors(spark, f"{folder}/blocks", dims, positives), ["row_number"], "number"), "anchors") if n else None
    count = ranked.count() if n else 0
    if not count:
        return spark.createDataFrame([], RESULT)
    for at in range(0, count, CHUNK_ANCHORS):
        anchors = ranked.filter((F.col("number") > at) & (F.col("number") <= at + CHUNK_ANCHORS)).orderBy("number").collect()
        floor, top = np.iinfo(np.int64).min, np.iinfo(np.int64).max
        chunk = {"c": np.array([r["c"] for r in anchors], np.int64).reshape(len(anchors), dims), "labels": np.array([r["label"] for r in anchors], np.int32), "rows": np.array([r["row_number"] for r in anchors], np.int64)}
        asked = chunk | {"anchor": np.arange(len(anchors)), "low": np.array([floor if r["least"] is None else r["least"] for r in anchors], np.int64), "high": np.full(len(anchors), top)}
        near = _search(spark, f"{folder}/blocks", dims, asked, positives, True).orderBy("grp", "place").collect()
        if not near:
            continue
        p = np.array([r["score"] for r in near], np.int64)
        windows = chunk | {"anchor": np.array([r["grp"] for r in near]), "low": -(-low_pct * p // 100), "high": high_pct * p // 100}
        pairs = spark.createDataFrame([(k, anchors[r["grp"]]["vec_id"], r["id"], r["score"]) for k, r in enumerate(near)], "q int, anchor_id long, positive_id long, positive_score long")
        found = _search(spark, f"{folder}/blocks", dims, windows, negatives, False)
        out = found.join(F.broadcast(pairs), F.col("grp") == F.col("q")).select("anchor_id", "positive_id", F.col("place").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
        out.write.mode("overwrite").parquet(f"{folder}/found/{at}")
    return spark.read.schema(RESULT).option("recursiveFileLookup", "true").parquet(f"{folder}/found") if _there(spark, f"{folder}/found") else spark.createDataFrame([], RESULT)


def _there(spark: SparkSession, folder: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
