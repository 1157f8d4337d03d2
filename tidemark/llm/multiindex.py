"""Approximate nearest neighbours by an inverted multi-index.

Vectors are split into two halves; each half has its own codebook, so K + K centroids make
K x K cells. A query's distances to the two codebooks (its inner products, negated) are
sorted, and a heap walks the pairs by summed distance, cell by cell, until the cells hold
enough candidates. The candidates are reranked by their exact inner product in double
precision.

The codebooks are fitted on a bounded sample; every row is indexed. The index is cut into
blocks of about BLOCK_ROWS rows: small cells share one, a large cell (copies of one vector)
is split over several. A query travels to the blocks of its cells with its vector, and a
block meets at most GROUP_QUERIES queries at a time, so a task's memory is bounded whatever
the cells hold. Blocks return each query's best k, and those are merged.

``share`` of all rows is looked at per query. On directions without structure (the test
tables) near rows are spread over many cells, so the share that gives a recall of 0.9 is
large; clustered vectors need far less.

Defined cases: vectors that are null, empty, zero, hold null or non-finite components, or
have another length than most of the sample take no part. Fewer candidates than k: all of
them. Ties go to the smaller id. A repeated id is a candidate once per row, and no row with
a query's own id is its candidate. Extra columns are ignored; an empty table gives no rows.
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

from tidemark.llm.common import P, by_value, sample_ids
from tidemark.session import materialize

by_value(__name__)

K = 64
SHARE = 0.5
TOP = 20
#: Rows that the codebooks are fitted on, at most.
SAMPLE = 8192
ROUNDS = 12
BLOCK_ROWS = 4096
GROUP_QUERIES = 4096
SEED = 5


def usable(v: Column) -> Column:
    d = F.transform(v, lambda x: x.cast("double"))
    return (v.isNotNull() & ~F.exists(d, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
            & F.exists(d, lambda x: x != 0))


def codebook(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(ROUNDS):
        at = nearest(x, c)
        n = np.bincount(at, minlength=len(c))
        total = np.zeros_like(c)
        np.add.at(total, at, x)
        c[n > 0] = total[n > 0] / n[n > 0][:, None]
    return c


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return ((c ** 2).sum(1) - 2 * (x @ c.T)).argmin(1)


def cells_by_distance(d1: np.ndarray, d2: np.ndarray, count: list[list[int]], enough: int) -> list[int]:
    """Non-empty cells in order of d1 + d2 until they hold ``enough`` rows."""
    o1, o2 = np.argsort(d1, kind="stable").tolist(), np.argsort(d2, kind="stable").tolist()
    s1, s2 = np.sort(d1).tolist(), np.sort(d2).tolist()
    heap = [(s1[0] + s2[0], 0, 0)]
    out, held, width = [], 0, len(o2)
    while heap and held < enough:
        _, i, j = heapq.heappop(heap)
        n = count[o1[i]][o2[j]]
        if n:
            out.append(o1[i] * width + o2[j])
            held += n
        if j + 1 < len(o2):
            heapq.heappush(heap, (s1[i] + s2[j + 1], i, j + 1))
        if j == 0 and i + 1 < len(o1):
            heapq.heappush(heap, (s1[i + 1] + s2[0], i + 1, 0))
    return out


@dataclass
class Index:
    rows: DataFrame  # id, cell, vec (doubles)
    first: np.ndarray
    second: np.ndarray
    counts: np.ndarray  # rows per cell
    total: int

    def blocks(self) -> tuple[list[list[int]], int]:
        """Blocks of each cell: a large cell has several of its own."""
        blocks, now, room = [], 0, BLOCK_ROWS
        for n in self.counts.ravel().tolist():
            if n > BLOCK_ROWS:
                own = -(-n // BLOCK_ROWS)
                now += room < BLOCK_ROWS
                blocks.append(list(range(now, now + own)))
                now, room = now + own, BLOCK_ROWS
                continue
            if n > room:
                now, room = now + 1, BLOCK_ROWS
            blocks.append([now])
            room -= n
        return blocks, now + 1


def vectors(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    arr = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return arr.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(arr), -1)


def build(table: DataFrame, id_col: str, vec_col: str, k: int = K, sample: int = SAMPLE, seed: int = SEED) -> Index | None:
    good = table.where(F.col(id_col).isNotNull() & usable(F.col(vec_col))).select(
        F.col(id_col).alias("id"), F.transform(vec_col, lambda x: x.cast("double")).alias("vec"))
    picked = sample_ids(good.withColumn(P + "all", F.lit(0)), "id", [P + "all"], sample, seed).drop(P + "all").toArrow()
    if not picked.num_rows:
        return None
    lengths = Counter(picked.column("vec").combine_chunks().value_lengths().to_pylist())
    dim = max(lengths, key=lambda n: (lengths[n], -n))
    got = sorted((i, v) for i, v in zip(picked.column("id").to_pylist(), picked.column("vec").to_pylist()) if len(v) == dim)
    x = np.array([v for _, v in got])
    half = (dim + 1) // 2
    rng = np.random.default_rng(seed)
    first, second = codebook(x[:, :half], k, rng), codebook(x[:, half:], k, rng) if dim > 1 else np.zeros((1, 0))
    width = len(second)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                v = vectors(b.column(1))
                cell = nearest(v[:, :half], first) * width + nearest(v[:, half:], second)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(cell.astype(np.int32)), b.column(1)], names=["id", "cell", "vec"])

    kind = dict(good.dtypes)["id"]
    rows = materialize(good.where(F.size("vec") == dim).mapInArrow(place, f"id {kind}, cell int, vec array<double>"), "multiindex")
    counts = np.zeros(len(first) * width, dtype=np.int64)
    for r in rows.groupBy("cell").count().collect():  # K x K rows at most
        counts[r["cell"]] = r["count"]
    return Index(rows, first, second, counts.reshape(len(first), width), int(counts.sum()))


def search(index: Index, is_query: Column, top: int = TOP, share: float = SHARE) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's ``top`` nearest found. ``is_query``: a
    condition on the index's id."""
    first, second, total = index.first, index.second, index.total
    half = first.shape[1]
    count = index.counts.tolist()
    of_cell, n_blocks = index.blocks()
    enough = max(int(np.ceil(total * share)), 4 * top) + 1
    kind = dict(index.rows.dtypes)["id"]
    queries = index.rows.where(is_query)
    groups = max(1, -(-queries.count() // GROUP_QUERIES))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            v = vectors(b.column(1))
            d1, d2 = -(v[:, :half] @ first.T), -(v[:, half:] @ second.T)
            row, block, cells = [], [], []
            for i in range(len(v)):
                mine: dict[int, list[int]] = {}
                for c in cells_by_distance(d1[i], d2[i], count, enough):
                    for x in of_cell[c]:
                        mine.setdefault(x, []).append(c)
                row += [i] * len(mine)
                block += mine.keys()
                cells += mine.values()
            at = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(block, pa.int32()), b.column(2).take(at), b.column(0).take(at), b.column(1).take(at),
                                              pa.array(cells, pa.list_(pa.int32()))], names=["block", "g", "qid", "qvec", "cells"])

    routed = queries.select("id", "vec", F.pmod(F.xxhash64("id"), F.lit(groups)).cast("int").alias("g")).mapInArrow(
        route, f"block int, g int, qid {kind}, qvec array<double>, cells array<int>")
    own = np.array([x[0] for x in of_cell], dtype=np.int32)
    many = np.array([len(x) for x in of_cell], dtype=np.int32)

    def blocked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cell = b.column(1).to_numpy(zero_copy_only=False)
            block = own[cell] + b.column(3).to_numpy(zero_copy_only=False) % many[cell]
            yield pa.RecordBatch.from_arrays([pa.array(block.astype(np.int32)), *b.columns[:3]], names=["block", "id", "cell", "vec"])

    stored = index.rows.withColumn("part", F.pmod(F.xxhash64("id", "vec"), F.lit(1 << 20)).cast("int")).mapInArrow(
        blocked, f"block int, id {kind}, cell int, vec array<double>")
    stored = stored.withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))

    def rerank(rows: pa.Table, asked: pa.Table) -> pa.Table:
        out_q, out_v, out_s = [], [], []
        if rows.num_rows and asked.num_rows:
            cell = rows.column("cell").to_numpy()
            ids = np.array(rows.column("id").to_pylist())
            order = np.lexsort((ids, cell))
            x, ids, cell = vectors(rows.column("vec"))[order], ids[order], cell[order]
            kinds, start = np.unique(cell, return_index=True)
            end = np.append(start[1:], len(cell))
            q, qid, want = vectors(asked.column("qvec")), np.array(asked.column("qid").to_pylist()), asked.column("cells").to_pylist()
            for lo in range(0, len(q), 256):
                part = slice(lo, lo + 256)
                s = np.full((len(q[part]), len(x)), -np.inf)
                wanted = [set(c) for c in want[part]]
                for c, a, b in zip(kinds.tolist(), start, end):
                    who = [i for i, w in enumerate(wanted) if c in w]
                    if who:
                        s[who, a:b] = q[part][who] @ x[a:b].T
                s[qid[part][:, None] == ids[None, :]] = -np.inf
                for i in range(len(s)):
                    found = np.flatnonzero(s[i] > -np.inf)
                    if len(found) > top:  # all that reach the top-th score, up to rounding, are scored again
                        edge = np.partition(s[i][found], len(found) - top)[len(found) - top]
                        found = found[s[i][found] >= edge - 1e-9 * max(1.0, abs(edge))]
                    exact = (x[found] * q[lo + i]).sum(axis=1)
                    best = np.lexsort((ids[found], -exact))[:top]
                    out_q += [qid[lo + i].item()] * len(best)
                    out_v += ids[found][best].tolist()
                    out_s += exact[best].tolist()
        id_type = rows.schema.field("id").type
        return pa.table({"query_id": pa.array(out_q, id_type), "vec_id": pa.array(out_v, id_type), "score": pa.array(out_s, pa.float64())})

    found = (stored.groupBy("block", "g").cogroup(routed.groupBy("block", "g"))
             .applyInArrow(rerank, f"query_id {kind}, vec_id {kind}, score double"))
    ranked = found.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), F.asc("vec_id"))))
    return ranked.where(F.col("rank") <= top).select("query_id", F.col("rank").cast("int"), "vec_id", "score")


EMPTY = "query_id long, rank int, vec_id long, score double"


def nearest_neighbours(table: DataFrame, is_query: Column, id_col: str = "vec_id", vec_col: str = "embedding",
                       top: int = TOP, share: float = SHARE, k: int = K) -> DataFrame:
    """``is_query`` is a condition on the column `id`."""
    index = build(table, id_col, vec_col, k)
    if index is None:
        return table.sparkSession.createDataFrame([], EMPTY)
    return search(index, is_query, top, share)
