"""Hard negatives by an STR-packed R-tree.

Rows are tiled by sort-tile-recursive packing: cuts along one coordinate after another, the
widest first, deal them to blocks, and inside a block (a unit of about UNIT_ROWS rows; a
larger block has several) the same packing orders them into leaves of LEAF rows, FAN nodes to
a parent. A node's minimum bounding box and a query q give an interval of inner products,
coordinate by coordinate: q > 0 takes the upper bound from the box's upper side, q < 0 from
its lower side. A best-first queue by upper bound expands nodes; a box goes unseen if its
interval lies outside the score window or strictly below the kth score found so far.

The cuts are fitted on a bounded sample (at most SAMPLE rows); every row is indexed, each
with a uniform number that parts equal coordinates, so copies of one vector spread over
blocks. The sample's own rows also give each query a lower bound of its kth score before the
first box is opened. Blocks' boxes (BLOCKS at most) travel to the queries; a query goes to
the units that its bounds leave, in batches, and a unit is one packed row that is shuffled
once and followed by one batch after another: neither rows nor units are copied per batch.
Scores are exact integers; the search is exact.

``mine`` searches twice: the first POSITIVES other rows of the anchor's label, then for each
positive of score p the first NEGATIVES rows of other labels with low * p <= scale * score <=
high * p.

Defined cases: rows with a null id, label or vector, with a null or non-finite component, of
another length than most of the sample, or too long for scores that fit a long (squared norm
over 2^62 after scaling) take no part. Ties go to the smaller id. Repeated rows are candidates
one by one; anchors alike in id, label and vector are one anchor, and no row of the anchor's
id is its positive. An anchor without positives, or a positive without negatives in the
window (always so for a negative score), gives no rows. Extra columns are ignored; an empty
table gives no rows.
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.common import P, by_value, sample_ids, small_batches
from tidemark.session import materialize

by_value(__name__)

SCALE = 256
POSITIVES, NEGATIVES = 5, 10
#: 30 p <= 100 score <= 90 p.
WINDOW = (30, 90, 100)
SAMPLE, BLOCKS, UNIT_ROWS, SMALL_UNIT, SMALL_BLOCKS = 8192, 1024, 1 << 16, 1 << 10, 64
LEAF, FAN = 128, 16
QUERY_BATCH = 128
NORM = float(1 << 62)
LOW, HIGH = -(1 << 62), 1 << 62
SEED = 11


# --- packing --------------------------------------------------------------------

def by_spread(x: np.ndarray, parts: int) -> list[int]:
    """The coordinates to cut along: the widest, one for each halving that ``parts`` allows."""
    spread = np.ptp(x.astype(np.float64), axis=0) if len(x) else np.zeros(x.shape[1])
    return np.argsort(-spread, kind="stable")[:max(1, int(np.ceil(np.log2(max(2, parts)))))].tolist()


def str_order(x: np.ndarray, dims: list[int], leaf: int) -> np.ndarray:
    """Rows in the order of their leaves: slabs of whole leaves along the first coordinate, each packed along the rest."""
    parts = -(-len(x) // leaf)
    if parts <= 1 or not dims:
        return np.arange(len(x))
    per = leaf * -(-parts // int(np.ceil(parts ** (1 / len(dims)))))
    order = np.argsort(x[:, dims[0]], kind="stable")
    return np.concatenate([s[str_order(x[s], dims[1:], leaf)] for s in (order[lo:lo + per] for lo in range(0, len(x), per))])


class Tiles:
    """Cuts of the same packing on a sample; ``place`` deals any row to its block."""

    def __init__(self, x: np.ndarray, u: np.ndarray, parts: int):
        self.blocks = 0
        self.root = self._cut(x.astype(np.float64) + u[:, None], by_spread(x, parts), parts)

    def _cut(self, key: np.ndarray, dims: list[int], parts: int):
        if parts <= 1 or not dims or len(key) < 2:
            self.blocks += 1
            return self.blocks - 1
        slabs = int(np.ceil(parts ** (1 / len(dims))))
        order = np.argsort(key[:, dims[0]], kind="stable")
        at = [len(key) * s // slabs for s in range(slabs + 1)]
        cuts = key[order[at[1:-1]], dims[0]]
        return dims[0], cuts, [self._cut(key[order[a:b]], dims[1:], -(-parts // slabs)) for a, b in zip(at, at[1:])]

    def place(self, x: np.ndarray, u: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x), dtype=np.int64)
        stack = [(self.root, np.arange(len(x)))]
        while stack:
            node, rows = stack.pop()
            if isinstance(node, int):
                out[rows] = node
                continue
            dim, cuts, children = node
            slab = np.searchsorted(cuts, x[rows, dim].astype(np.float64) + u[rows], side="right")
            stack += [(child, rows[slab == s]) for s, child in enumerate(children)]
        return out


# --- a tree ---------------------------------------------------------------------

def exact(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products as integers (squared norms are at most 2^62)."""
    def norm(v):
        return float((v.astype(np.float64) ** 2).sum(axis=-1).max(initial=0))

    if norm(q) * norm(x) < 2.0 ** 104:  # below 2^52 in every sum: doubles hold it
        return (q.astype(np.float64) @ x.T.astype(np.float64)).astype(np.int64)
    return q @ x.T


def intervals(q: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest inner product of each query with each box (rounded outwards)."""
    q, lo, hi = q.astype(np.float64), lo.astype(np.float64), hi.astype(np.float64)
    up, down = np.maximum(q, 0), np.minimum(q, 0)
    slack = (np.abs(q) @ np.maximum(np.abs(lo), np.abs(hi)).T) * 1e-12
    return up @ lo.T + down @ hi.T - slack, up @ hi.T + down @ lo.T + slack


class Tree:
    """A packed unit: rows in leaf order and the boxes of all nodes, leaves first."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, x: np.ndarray):
        self.ids, self.labels, self.x = ids, labels, x
        starts = np.arange(0, len(x), LEAF)
        self.ends = np.append(starts[1:], len(x))
        lo, hi, self.children, self.leaves = [np.minimum.reduceat(x, starts)], [np.maximum.reduceat(x, starts)], {}, len(starts)
        first, count = 0, len(starts)
        while count > 1:
            groups = np.arange(0, count, FAN)
            lo.append(np.minimum.reduceat(lo[-1], groups))
            hi.append(np.maximum.reduceat(hi[-1], groups))
            for g in groups.tolist():
                self.children[first + count + g // FAN] = range(first + g, first + min(g + FAN, count))
            first, count = first + count, len(groups)
        self.lo, self.hi, self.root = np.concatenate(lo), np.concatenate(hi), first

    def bounds(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return intervals(q, self.lo, self.hi)

    def search(self, q: np.ndarray, below: list[float], above: list[float], scored: dict, own: int | None, label: int, same: bool,
               low: int, high: int, k: int, floor: int) -> list[tuple[int, int]]:
        """The best k (-score, id) in the window, none below ``floor``. ``scored``: the query's leaf scores so far."""
        best: list[tuple[int, int]] = []
        kth = max(floor, low)
        queue = [(-min(above[self.root], high), self.root)]
        while queue:
            bound, node = heapq.heappop(queue)
            if -bound < kth:
                break
            if node >= self.leaves:
                for c in self.children[node]:
                    if above[c] >= kth and below[c] <= high:
                        heapq.heappush(queue, (-min(above[c], high), c))
                continue
            a, b = node * LEAF, int(self.ends[node])
            s = scored.get(node)
            if s is None:
                s = scored[node] = exact(q, self.x[a:b])
            ok = (s >= kth) & (s <= high) & ((self.labels[a:b] == label) == same)
            if own is not None:
                ok &= self.ids[a:b] != own
            at = np.flatnonzero(ok)
            if len(at):
                best = sorted(best + list(zip((-s[at]).tolist(), self.ids[a:b][at].tolist())))[:k]
                if len(best) == k:
                    kth = max(kth, -best[-1][0])
        return best


# --- the index ------------------------------------------------------------------

@dataclass
class Index:
    units: DataFrame  # unit, ids, labels, x: one packed row a unit
    rows: DataFrame  # id, label, vec
    lo: np.ndarray  # of blocks
    hi: np.ndarray
    units_of: list[range]
    sample: tuple[np.ndarray, np.ndarray, np.ndarray]  # ids, labels, vectors


def matrix(column) -> np.ndarray:
    arr = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return arr.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(arr), -1)


def usable(table: DataFrame, id_col: str, label_col: str, vec_col: str, scale: int) -> DataFrame:
    """id, label, vec (whole numbers), u (uniform, its own for every row)."""
    d = F.transform(vec_col, lambda x: x.cast("double"))
    fine = F.col(vec_col).isNotNull() & ~F.exists(d, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    scaled = F.transform(d, lambda x: F.floor(x * scale))
    short = F.aggregate(d, F.lit(0.0), lambda s, x: s + (x * scale) * (x * scale) + F.abs(x * scale) * 2 + 1) <= NORM
    u = F.pmod(F.xxhash64(F.col(id_col), F.monotonically_increasing_id()), F.lit(1 << 40)) / float(1 << 40)
    kept = table.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & fine)
    return kept.where(short & (F.size(vec_col) > 0)).select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), scaled.alias("vec"), u.alias("u"))


def build(table: DataFrame, id_col: str, label_col: str, vec_col: str, scale: int = SCALE, sample: int = SAMPLE) -> Index | None:
    rows = materialize(usable(table, id_col, label_col, vec_col, scale), "rtree_rows")
    picked = sample_ids(rows.withColumn(P + "all", F.lit(0)), "id", [P + "all"], sample, SEED).toArrow()
    if not picked.num_rows:
        return None
    lengths = Counter(picked.column("vec").combine_chunks().value_lengths().to_pylist())
    dim = max(lengths, key=lambda n: (lengths[n], -n))
    rows = rows.where(F.size("vec") == dim)
    picked = picked.filter(pa.compute.equal(pa.compute.list_value_length(picked.column("vec")), dim)).sort_by([("id", "ascending"), ("u", "ascending")])
    x, n = matrix(picked.column("vec")), rows.count()
    parts = min(BLOCKS, max(-(-n // UNIT_ROWS), min(SMALL_BLOCKS, -(-n // SMALL_UNIT))))
    tiles = Tiles(x, picked.column("u").to_numpy(), parts)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                block = tiles.place(matrix(b.column("vec")), b.column("u").to_numpy())
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(block.astype(np.int32))], names=[*b.schema.names, "block"])

    placed = materialize(rows.mapInArrow(place, "id long, label long, vec array<long>, u double, block int"), "rtree_placed")
    counts = {r["block"]: r["count"] for r in placed.groupBy("block").count().collect()}  # BLOCKS rows at most
    units_of, now = [], 0
    for block in range(tiles.blocks):
        units_of.append(range(now, now := now + -(-counts.get(block, 0) // UNIT_ROWS)))
    first = F.element_at(F.array(*[F.lit(r.start) for r in units_of]), F.col("block") + 1)
    many = F.element_at(F.array(*[F.lit(len(r)) for r in units_of]), F.col("block") + 1)
    unit = (first + F.floor(F.pmod(F.col("u") * float(1 << 20), F.lit(1.0)) * many)).cast("int")

    def pack(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("id", "ascending"), ("u", "ascending")])
        x = matrix(rows.column("vec"))
        order = str_order(x, by_spread(x, -(-len(x) // LEAF)), LEAF)
        x = x[order]
        kind = np.int32 if np.abs(x).max(initial=0) < 1 << 31 else np.int64
        return pa.table({"unit": pa.array([key[0].as_py()], pa.int32()), "block": pa.array([rows.column("block")[0].as_py()], pa.int32()),
                         "ids": [rows.column("id").to_numpy()[order].tobytes()], "labels": [rows.column("label").to_numpy()[order].tobytes()],
                         "x": [x.astype(kind).tobytes()], "lo": pa.array([x.min(axis=0)], pa.list_(pa.int64())), "hi": pa.array([x.max(axis=0)], pa.list_(pa.int64()))})

    units = materialize(placed.withColumn("unit", unit).repartition(max(1, min(now, 4096)), "unit").groupBy("unit").applyInArrow(
        pack, "unit int, block int, ids binary, labels binary, x binary, lo array<long>, hi array<long>"), "rtree_units")

    def box(rows: pa.Table) -> pa.Table:
        return pa.table({"block": rows.column("block")[:1], "lo": pa.array([matrix(rows.column("lo")).min(axis=0)], pa.list_(pa.int64())),
                         "hi": pa.array([matrix(rows.column("hi")).max(axis=0)], pa.list_(pa.int64()))})

    lo, hi = np.zeros((tiles.blocks, dim), dtype=np.int64), np.zeros((tiles.blocks, dim), dtype=np.int64)
    for r in units.select("block", "lo", "hi").groupBy("block").applyInArrow(box, "block int, lo array<long>, hi array<long>").collect():
        lo[r["block"]], hi[r["block"]] = r["lo"], r["hi"]
    return Index(units, rows, lo, hi, units_of, (picked.column("id").to_numpy(), picked.column("label").to_numpy(), x))


def search(index: Index, asked: DataFrame, same: bool, k: int) -> DataFrame:
    """``asked``: key, id, label, vec and windows (array of struct low, high). Returns (key, nth,
    rank, id, score): for each window (nth from 0) the first k rows of the same label and
    another id, or of other labels, with a score in the window."""
    small_batches(asked.sparkSession)
    lo, hi, units_of = index.lo, index.hi, index.units_of
    shared = asked.sparkSession.sparkContext.broadcast(index.sample)  # SAMPLE rows at most

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, labels, x = shared.value
        names = ["unit", "key", "id", "label", "vec", "low", "high", "floor", "windows"]
        for whole in batches:
            for at in range(0, whole.num_rows, QUERY_BATCH):
                b = whole.slice(at, QUERY_BATCH)
                q, low, high = matrix(b.column("vec")), [], []
                for w in b.column("windows").to_pylist():
                    low.append([r["low"] for r in w])
                    high.append([r["high"] for r in w])
                s, floor = exact(q, x), []
                for i, (own, label) in enumerate(zip(b.column("id").to_pylist(), b.column("label").to_pylist())):
                    may = s[i][((labels == label) == same) & (~np.bool_(same) | (ids != own))]
                    floor.append([])
                    for a, z in zip(low[i], high[i]):
                        inside = may[(may >= a) & (may <= z)]
                        floor[-1].append(int(np.partition(inside, len(inside) - k)[len(inside) - k]) if len(inside) >= k else LOW)
                below, above = intervals(q, lo, hi)
                want = np.zeros(above.shape, dtype=bool)
                for i in range(len(q)):
                    for a, z, f in zip(low[i], high[i], floor[i]):
                        want[i] |= (above[i] >= max(a, f)) & (below[i] <= z)
                for block in np.flatnonzero(want.any(axis=0)).tolist():
                    rows = np.flatnonzero(want[:, block])
                    part = [[b.column("key").to_numpy()[rows].tobytes()], [b.column("id").to_numpy()[rows].tobytes()],
                            [b.column("label").to_numpy()[rows].tobytes()], [q[rows].tobytes()]]
                    flat = [[[v for i in rows for v in z[i]]] for z in (low, high, floor)]
                    n = [[len(low[i]) for i in rows]]
                    for u in units_of[block]:
                        yield pa.RecordBatch.from_arrays([pa.array([u], pa.int32()), *[pa.array(p, pa.binary()) for p in part],
                                                          *[pa.array(f, pa.list_(pa.int64())) for f in flat], pa.array(n, pa.list_(pa.int32()))], names=names)

    sent = asked.select("key", "id", "label", "vec", "windows").mapInArrow(
        route, "unit int, key binary, id binary, label binary, vec binary, low array<long>, high array<long>, floor array<long>, windows array<int>")
    n_units = max(1, units_of[-1].stop)
    # dealt by unit and sorted, a unit's packed row comes before its batches: no join, so neither side can be
    # broadcast (Spark cannot know how many batches the routing makes) and no unit is copied for each batch
    packed = index.units.select("unit", "ids", "labels", "x")
    met = (sent.unionByName(packed, allowMissingColumns=True).withColumn("later", F.col("x").isNull())
           .repartition(min(n_units, 4096), "unit").sortWithinPartitions("unit", "later"))

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, tree = None, None
        for b in batches:
            for r in range(b.num_rows):
                row = {n: b.column(n)[r] for n in b.schema.names}
                if not row["later"].as_py():
                    now = row["unit"].as_py()
                    ids = np.frombuffer(row["ids"].as_py(), dtype=np.int64)
                    raw = row["x"].as_py()
                    x = np.frombuffer(raw, dtype=np.int32 if len(raw) == 4 * len(ids) * lo.shape[1] else np.int64)
                    tree = Tree(ids, np.frombuffer(row["labels"].as_py(), dtype=np.int64), x.reshape(len(ids), -1).astype(np.int64))
                    continue
                if row["unit"].as_py() != now:  # a unit without rows
                    continue
                key, own, label = (np.frombuffer(row[n].as_py(), dtype=np.int64).tolist() for n in ("key", "id", "label"))
                q = np.frombuffer(row["vec"].as_py(), dtype=np.int64).reshape(len(key), -1)
                below, above = tree.bounds(q)
                low, high, floor = (row[n].as_py() for n in ("low", "high", "floor"))
                out, w = [], 0
                for i, windows in enumerate(row["windows"].as_py()):
                    under, over, scored = below[i].tolist(), above[i].tolist(), {}
                    for nth in range(windows):
                        found = tree.search(q[i], under, over, scored, own[i] if same else None, label[i], same, low[w], high[w], k, floor[w])
                        out += [(key[i], nth, x, -s) for s, x in found]
                        w += 1
                cols = list(zip(*out)) or [()] * 4
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int64()),
                                                  pa.array(cols[3], pa.int64())], names=["key", "nth", "id", "score"])

    found = met.mapInArrow(visit, "key long, nth int, id long, score long")
    rank = F.row_number().over(W.partitionBy("key", "nth").orderBy(F.desc("score"), F.asc("id")))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("key", "nth", "rank", "id", "score")


EMPTY = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def mine(table: DataFrame, is_anchor: Column, id_col: str = "vec_id", label_col: str = "label", vec_col: str = "embedding", scale: int = SCALE,
         positives: int = POSITIVES, negatives: int = NEGATIVES, window: tuple[int, int, int] = WINDOW, sample: int = SAMPLE) -> DataFrame:
    """``is_anchor`` is a condition on the column `id`."""
    index = build(table, id_col, label_col, vec_col, scale, sample)
    if index is None:
        return table.sparkSession.createDataFrame([], EMPTY)
    every = F.array(F.struct(F.lit(LOW).alias("low"), F.lit(HIGH).alias("high")))
    anchors = materialize(index.rows.where(is_anchor).select("id", "label", "vec").distinct().withColumn("key", F.monotonically_increasing_id()), "anchors")
    near = materialize(search(index, anchors.withColumn("windows", every), True, positives).select("key", "rank", "id", "score"), "positives")
    low, high, of = window
    # low * p <= of * s <= high * p for whole s: from the ceiling to the floor of the quotients
    bounds = F.struct((-F.floor(-F.col("score").cast("decimal(20,0)") * low / of)).cast("long").alias("low"),
                      F.floor(F.col("score").cast("decimal(20,0)") * high / of).cast("long").alias("high"))
    windows = near.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("rank", bounds.alias("w")))).alias("w"))  # at most ``positives``
    asked = anchors.join(windows, "key").withColumn("windows", F.transform("w", lambda x: x["w"]))
    far = search(index, asked, False, negatives)
    named = near.select("key", (F.col("rank") - 1).alias("nth"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    return (far.withColumnsRenamed({"id": "negative_id", "score": "negative_score"}).join(named, ["key", "nth"])
            .join(anchors.select("key", F.col("id").alias("anchor_id")), "key")
            .select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"))
