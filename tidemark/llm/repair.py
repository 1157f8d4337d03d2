"""Conversation structure repair by prefix-doubling path ranking.

Rows of a conversation are ordered; each has at most one fault (blank, duplicate of an
earlier row, truncated). The cheapest edits (keep K, give another role R, delete D, insert
an empty turn I) that leave the role initials `(s?(ua)+)?` are found by a cost DP over nodes
(row, state), the state being the last kept initial. Arcs on cheapest paths carry their
edit's initial. Node ranks by the next 1, 2, 4, ... letters come from prefix doubling: a pair
of ranks, a node's own and the one that its doubled pointer leads to, is ranked anew. As an
edit's initial fixes the node it leads to, equal audits from a node meet in one node and the
pointers double with the ranks. The arc of least (letter, rank of its node) is taken
everywhere, and the least path is read off the doubled pointers, all steps at once.

No conversation is one group. Rows get their place by a range-partitioned sort, and BLOCK
places in a row are a block, which holds many short conversations or a part of a long one.
The two parts at a block's edges are summed up as a 4 x 4 matrix of least costs between
states; a conversation over several blocks combines one such matrix a block, which gives
each part its costs to the end, and then the states in which its parts are entered.

``repair`` returns ``turns`` (id, seg, n, role, text, edit; in order of seg, n) and ``report``
(id, gaps, blank, duplicate, truncated, illegal, cost, audit). An audit is as long as its
conversation: one string cell, as asked for. ``digests`` streams a conversation's turns
through one hash, in order and without holding them; a hash of a whole conversation cannot
be split.

Defined cases: null roles and texts count as empty. Rows without an id are a conversation of
their own; null turns come first and count for no gap. Rows of equal turn are ordered by
role and text, repeated rows follow each other. A role of no initial, or another than s, u or
a, cannot be kept. Very long texts are only looked at for their last character and a
digest. Extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import by_value, small_batches
from tidemark.session import materialize

by_value(__name__)

BLOCK_BITS = 13
WHITE = " \t\n\x0b\x0c\r"
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
BLANK, DUPLICATE, CUT = 1, 2, 3
#: States: nothing yet, after s, after u, after a. What a kept row of initial s, u, a or another leads to; what is wanted next.
KEEPS = np.array([[1, 2, -1, -1], [-1, 2, -1, -1], [-1, -1, 3, -1], [-1, 2, -1, -1]])
WANTED = np.array([2, 2, 3, 2])
ENDS = (0, 1 << 50, 1 << 50, 0)
NEVER = 1 << 50
#: Adjacent initials that are in order: su, ua, au.
LEGAL = np.zeros((4, 4), dtype=bool)
LEGAL[[0, 1, 2], [1, 2, 1]] = True
LETTERS = "DIKR"


@dataclass
class Repair:
    turns: DataFrame
    report: DataFrame


# --- a block ------------------------------------------------------------------

def segments(conv: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the runs of one conversation."""
    code = pc.dictionary_encode(conv, null_encoding="encode").indices.to_numpy(zero_copy_only=False)
    start = np.flatnonzero(np.concatenate(([True], code[1:] != code[:-1])))
    return start, np.diff(np.append(start, len(code)))


def arcs(initial: np.ndarray, fault: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per row and state: cost of K and of R, and the state that K leads to."""
    stays = np.where((fault == BLANK) | (fault == DUPLICATE), NEVER, np.where(fault == CUT, TRUNCATED, 0))
    to = KEEPS[:, initial].T
    keep = np.where(to >= 0, KEEP + stays[:, None], NEVER)
    return keep, np.broadcast_to((REROLE + stays)[:, None], keep.shape), np.maximum(to, 0)


def costs(initial: np.ndarray, fault: np.ndarray, start: np.ndarray, length: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Least cost from each node to its segment's end. Segment j has a level before each of
    its rows and one after them: level i is ``start[j] + j + i``."""
    keep, rerole, to = arcs(initial, fault)
    out = np.empty((len(initial) + len(start), 4), dtype=np.int64)
    order = np.argsort(-length, kind="stable")
    longest_first, last = -length[order], (start + np.arange(len(start)) + length)[order]
    for k in range(int(length.max(initial=0)) + 1):
        alive = int(np.searchsorted(longest_first, -k, side="right"))
        at = last[:alive] - k
        if k == 0:
            own = ends[order].copy()
        else:
            row, then = at - order[:alive], out[at + 1]
            own = np.minimum(DELETE + then, keep[row] + np.take_along_axis(then, to[row], 1))
            np.minimum(own, rerole[row] + then[:, WANTED], out=own)
        own[:, 2], own[:, 3] = np.minimum(own[:, 2], INSERT + own[:, 3]), np.minimum(own[:, 3], INSERT + own[:, 2])
        own[:, :2] = np.minimum(own[:, :2], INSERT + own[:, 2:3])
        out[at] = own
    return out


def matrix(initial: np.ndarray, fault: np.ndarray) -> np.ndarray:
    """Least cost of one segment from each entry state to each exit state."""
    n = np.array([len(initial)])
    units = np.where(np.eye(4, dtype=bool), 0, NEVER)
    return np.stack([costs(initial, fault, np.array([0]), n, units[s:s + 1])[0] for s in range(4)], axis=1)


def dense_ranks(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return np.unique(first * (int(second.max(initial=0)) + 1) + second, return_inverse=True)[1]


def least_paths(initial, fault, start, length, ends, entries: list[tuple[int, int]]):
    """For each (segment, entry state): its cost, exit state and least audit as arrays of
    (letter, row, state after), row -1 for an insertion."""
    cost = costs(initial, fault, start, length, ends)
    levels, j = len(cost), np.repeat(np.arange(len(start)), length + 1)
    row = np.arange(levels) - j
    inner = np.ones(levels, dtype=bool)
    inner[start + np.arange(len(start)) + length] = False
    row[~inner] = 0
    state = np.arange(4)
    keep, rerole, to = arcs(initial, fault) if len(initial) else (np.full((1, 4), NEVER),) * 2 + (np.zeros((1, 4), dtype=np.int64),)
    after = np.minimum(np.arange(levels) + 1, levels - 1)[:, None]
    same = np.arange(levels)[:, None]
    # targets and costs of D, I, K, R from every node
    target = np.stack([after * 4 + state, same * 4 + WANTED + 0 * state, after * 4 + to[row], after * 4 + WANTED + 0 * state], axis=2).reshape(-1, 4)
    flat = cost.ravel()
    step = np.stack(np.broadcast_arrays(np.int64(DELETE), np.int64(INSERT), keep[row], rerole[row]), axis=2).reshape(-1, 4)
    optimal = step + flat[target] == flat[:, None]
    optimal[np.repeat(~inner, 4)] &= [False, True, False, False]
    done = np.zeros((levels, 4), dtype=bool)
    done[~inner] = cost[~inner] == ends
    done = done.ravel()
    optimal[done] = False

    letter = np.where(done, 0, optimal.argmax(axis=1) + 1)  # letters in order, so the first is the least
    pointer = np.where(done, np.arange(len(done)), target[np.arange(len(done)), np.maximum(letter - 1, 0)])
    rank, doubled = dense_ranks(letter, np.zeros_like(letter)), [pointer]
    while True:
        finer = dense_ranks(rank, rank[pointer])
        if finer.max(initial=0) == rank.max(initial=0) and done[pointer].all():
            break
        rank, pointer = finer, pointer[pointer]
        doubled.append(pointer)
    key = np.where(optimal, np.arange(1, 5) * (len(rank) + 1) + rank[target], np.iinfo(np.int64).max)
    chosen = key.argmin(axis=1)

    node = np.array([(start[s] + s) * 4 + e for s, e in entries], dtype=np.int64)
    steps = np.zeros(len(node), dtype=np.int64)
    now = node.copy()
    for k in reversed(range(len(doubled))):  # most letters that do not reach the end
        further = doubled[k][now]
        go = ~done[further]
        steps[go] += 1 << k
        now[go] = further[go]
    steps += ~done[now]
    exits = np.where(done[now], now, doubled[0][now])
    owner = np.repeat(np.arange(len(node)), steps)
    t = np.arange(len(owner)) - np.repeat(np.cumsum(steps) - steps, steps)
    at = node[owner]
    for k in range(len(doubled)):
        at = np.where(t >> k & 1, doubled[k][at], at)
    edit = chosen[at]
    of_row = np.where(edit == 1, -1, row[at // 4])
    return cost.ravel()[node], exits % 4, steps, edit, of_row, target[at, edit] % 4


def _block(rows: pa.Table) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    rows = rows.sort_by("pos").combine_chunks()
    conv = rows.column("conv").combine_chunks()
    start, length = segments(conv)
    return conv, *(rows.column(c).to_numpy() for c in ("pos", "initial", "fault")), start, length


# --- the job ------------------------------------------------------------------

def _parts(light: DataFrame, kind: str) -> DataFrame:
    """Parts of conversations by block: adjacent initials out of order, and a matrix where the part is at an edge."""
    def run(rows: pa.Table) -> pa.Table:
        conv, pos, initial, fault, start, length = _block(rows)
        end = start + length
        bad = np.concatenate(([False], ~LEGAL[initial[:-1], initial[1:]]))
        bad[start] = False
        edge = np.zeros(len(start), dtype=bool)
        edge[[0, -1]] = True
        m = [matrix(initial[a:b], fault[a:b]).ravel().tolist() if e else None for a, b, e in zip(start, end, edge)]
        return pa.table({"conv": conv.take(pa.array(start)), "seg": pos[start], "edge": edge, "first": initial[start], "last": initial[end - 1],
                         "illegal": np.add.reduceat(bad.astype(np.int64), start), "m": pa.array(m, pa.list_(pa.int64()))})

    return light.groupBy("block").applyInArrow(run, f"conv {kind}, seg long, edge boolean, first int, last int, illegal long, m array<long>")


def _ends(parts: DataFrame) -> DataFrame:
    """Parts at edges: the costs to the conversation's end, whether others come before, and pairs out of order at the seam."""
    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("seg")
        first, last, n = rows.column("first").to_pylist(), rows.column("last").to_pylist(), rows.num_rows
        ends, now = [], np.array(ENDS)
        for m in reversed(rows.column("m").to_pylist()):
            ends.append(now.tolist())
            now = (np.array(m).reshape(4, 4) + now).min(axis=1)
        seam = [0] + [int(not LEGAL[a, b]) for a, b in zip(last, first[1:])]
        seg = rows.column("seg")
        return pa.table({"block": pc.shift_right(seg, BLOCK_BITS), "seg": seg, "multi": [n > 1] * n, "later": [i > 0 for i in range(n)],
                         "ends": pa.array(ends[::-1], pa.list_(pa.int64())), "illegal": seam})

    return parts.where("edge").groupBy("conv").applyInArrow(run, "block long, seg long, multi boolean, later boolean, ends array<long>, illegal long")


def _paths(light: DataFrame, ends: DataFrame, kind: str) -> DataFrame:
    """One row for each part and state it can be entered in: cost, exit state and edits."""
    def run(rows: pa.Table, known: pa.Table) -> pa.Table:
        conv, pos, initial, fault, start, length = _block(rows)
        at = {p: i for i, p in enumerate(pos[start].tolist())}
        end, multi, entries = np.tile(np.array(ENDS), (len(start), 1)), np.zeros(len(start), dtype=bool), {}
        for r in known.to_pylist():
            if r["multi"]:
                s = at[r["seg"]]
                end[s], multi[s] = r["ends"], True
                if r["later"]:
                    entries[s] = range(4)
        tasks = [(s, e) for s in range(len(start)) for e in entries.get(s, (0,))]
        cost, exits, steps, edit, row, state = least_paths(initial, fault, start, length, end, tasks)
        seg = np.array([s for s, _ in tasks])
        letters, bounds = "".join(np.array(list(LETTERS))[edit]), np.concatenate(([0], np.cumsum(steps))).astype(np.int32)
        offsets = pa.array(bounds)
        return pa.table({
            "conv": conv.take(pa.array(start[seg])), "seg": pos[start[seg]], "entry": pa.array([e for _, e in tasks], pa.int32()),
            "exit": pa.array(exits.astype(np.int32)), "multi": multi[seg], "cost": cost, "letters": [letters[a:b] for a, b in zip(bounds, bounds[1:])],
            "at": pa.ListArray.from_arrays(offsets, pa.array(pos[row], mask=row < 0)),
            "state": pa.ListArray.from_arrays(offsets, pa.array(state.astype(np.int32)))})

    schema = f"conv {kind}, seg long, entry int, exit int, multi boolean, cost long, letters string, at array<long>, state array<int>"
    return light.groupBy("block").cogroup(ends.groupBy("block")).applyInArrow(run, schema)


def _entered(paths: DataFrame) -> DataFrame:
    """(seg, entry) of the parts of conversations over several blocks, from the first part on."""
    def run(rows: pa.Table) -> pa.Table:
        exits: dict[int, dict[int, int]] = {}
        for r in rows.to_pylist():
            exits.setdefault(r["seg"], {})[r["entry"]] = r["exit"]
        out, state = [], 0
        for seg in sorted(exits):
            out.append((seg, state))
            state = exits[seg][state]
        return pa.table({"seg": pa.array([s for s, _ in out], pa.int64()), "entry": pa.array([e for _, e in out], pa.int32())})

    return paths.where("multi").select("conv", "seg", "entry", "exit").groupBy("conv").applyInArrow(run, "seg long, entry int")


def repair(rows: DataFrame, id_col: str = "conv_id", order_col: str = "turn", role_col: str = "role", text_col: str = "text") -> Repair:
    small_batches(rows.sparkSession)
    got = rows.select(F.col(id_col).alias("conv"), F.col(order_col).alias("ord"), F.coalesce(F.col(role_col), F.lit("")).alias("role"),
                      F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.monotonically_increasing_id().alias("tie"))
    kind = dict(got.dtypes)["conv"]
    keys = ["conv", "ord", "role", "text", "tie"]
    placed = materialize(got.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("tie").withColumn("pos", F.monotonically_increasing_id()), "turns")
    firsts = placed.groupBy("conv", "role", F.sha2("text", 256).alias("digest")).agg(F.min("pos").alias("pos")).select("pos", F.lit(True).alias("new"))
    said = F.rtrim("text", F.lit(WHITE))
    initial = F.when(F.col("role").startswith("s"), 0).when(F.col("role").startswith("u"), 1).when(F.col("role").startswith("a"), 2).otherwise(3)
    seen = placed.select("pos", "conv", initial.alias("initial"), (said == "").alias("blank"), (~F.right(said, F.lit(1)).isin(".", "!", "?")).alias("cut"))
    fault = F.when(F.col("blank"), BLANK).when(F.col("new").isNull(), DUPLICATE).when(F.col("cut"), CUT).otherwise(0)
    light = materialize(seen.join(firsts, "pos", "left").select("pos", "conv", "initial", fault.alias("fault"),
                                                                F.shiftright("pos", BLOCK_BITS).alias("block")), "turn_faults")
    parts = materialize(_parts(light, kind), "turn_parts")
    ends = materialize(_ends(parts), "turn_ends")
    paths = materialize(_paths(light, ends, kind), "turn_paths")
    taken = paths.where("not multi").unionByName(paths.join(_entered(paths), ["seg", "entry"]).select(*paths.columns))

    steps = taken.select("conv", "seg", "letters", F.posexplode(F.arrays_zip("at", "state")).alias("n", "s"))
    steps = steps.select("conv", "seg", "n", F.substr("letters", F.col("n") + 1, F.lit(1)).alias("edit"), F.col("s.at").alias("pos"), F.col("s.state").alias("state"))
    own = F.col("edit") == "K"
    turns = (steps.where("edit != 'D'").join(placed.select("pos", "role", "text"), "pos", "left")
             .select(F.col("conv").alias(id_col), "seg", "n", F.when(own, F.col("role")).when(F.col("state") == 2, "user").otherwise("assistant").alias(role_col),
                     F.coalesce("text", F.lit("")).alias(text_col), "edit"))

    counts = light.groupBy("conv").agg(*[F.count_if(F.col("fault") == k).alias(n) for k, n in ((BLANK, "blank"), (DUPLICATE, "duplicate"), (CUT, "truncated"))])
    gaps = (placed.where("ord is not null").select("conv", "ord").distinct().groupBy("conv")
            .agg((F.max("ord") - F.min("ord") + 1 - F.count("*")).cast("long").alias("gaps")))
    illegal = parts.select("conv", "illegal").unionByName(ends.join(parts.select("seg", "conv"), "seg").select("conv", "illegal"))
    illegal = illegal.groupBy("conv").agg(F.sum("illegal").alias("illegal"))
    pieces = F.sort_array(F.collect_list(F.struct("seg", "letters")))
    audits = taken.groupBy("conv").agg(F.min_by("cost", "seg").alias("cost"), F.array_join(F.transform(pieces, lambda p: p["letters"]), "").alias("audit"))
    report = counts
    for more in (gaps, illegal, audits):
        report = join_id(report, more, "conv", "conv")
    report = report.select(F.col("conv").alias(id_col), F.coalesce("gaps", F.lit(0).cast("long")).alias("gaps"), "blank", "duplicate", "truncated", "illegal", "cost", "audit")
    return Repair(turns, report)


def join_id(left: DataFrame, right: DataFrame, left_id: str, right_id: str) -> DataFrame:
    """Left join in which a null id meets a null id."""
    r = right.withColumnRenamed(right_id, "__tm_right")
    return left.join(r, F.col(left_id).eqNullSafe(F.col("__tm_right")), "left").drop("__tm_right")


def digests(turns: DataFrame, line: Column, id_col: str = "conv_id") -> DataFrame:
    """(id, digest): SHA-256 of each conversation's lines joined by newlines."""
    rows = turns.select(F.col(id_col), "seg", "n", line.alias("line")).repartition(id_col).sortWithinPartitions(id_col, "seg", "n").select(id_col, "line")
    kind = dict(rows.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        for b in batches:
            ids, out = [], []
            for i, line in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if state is None or i != now:
                    if state is not None:
                        ids.append(now)
                        out.append(state.hexdigest())
                    now, state = i, hashlib.sha256(line.encode())
                else:
                    state.update(b"\n" + line.encode())
            yield pa.RecordBatch.from_arrays([pa.array(ids, b.schema.field(0).type), pa.array(out, pa.string())], names=[id_col, "digest"])
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now], b.schema.field(0).type), pa.array([state.hexdigest()])], names=[id_col, "digest"])

    return rows.mapInArrow(run, f"`{id_col}` {kind}, digest string")


def damage(rows: DataFrame, id_col: str = "conv_id", order_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Faults by crc32 of `id:turn` modulo 20 (a null anywhere is one space): 0 drops the row,
    1 empties its text, 2 takes `[.!?]` out of it, 3 repeats the row, 4 makes its role user."""
    def text(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    kind = F.crc32(F.concat(text(id_col), F.lit(":"), text(order_col))) % 20
    said = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(text(text_col), "[.!?]", "")).otherwise(text(text_col))
    return (rows.where(kind != 0)
            .select(F.col(id_col), F.col(order_col), F.when(kind == 4, "user").otherwise(text(role_col)).alias(role_col), said.alias(text_col),
                    F.explode(F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("__tm_copy"))
            .drop("__tm_copy"))
