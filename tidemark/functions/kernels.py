"""The indicator operators of ``functions.columns`` on numpy blocks of whole series.

A Spark window re-adds every row of its frame for each row (frames of 200, 90, 30 rows), one
row at a time, and stacks an operator for each layer of the plan. Here a task adds shifted
arrays instead: the same additions in the same order, so the same doubles to the last bit.

Spark deals and sorts the rows (``operators.sequence.series_blocks``); a task sees Arrow
batches, cuts them at the ends of (key, chunk) groups and keeps no more than the rows of one
block or one group. A series is ``(values, ok)``: ``ok`` is False where SQL has NULL.
"""

from __future__ import annotations

import sys

import numpy as np
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers need no copy of this package

BLOCK_ROWS = 1 << 15
OUT_ROWS = 1 << 13
CLASSES = [(0.05, 5.0), (0.03, 3.0), (0.01, 1.0)]  # as columns.CLASS_STEPS


class Groups:
    """Where the groups of a block begin and end: ``pos`` rows of its group stand before a row, ``left`` after it."""

    def __init__(self, first: np.ndarray):
        n = len(first)
        self.starts = np.flatnonzero(first)
        lengths = np.diff(np.append(self.starts, n))
        self.start = np.repeat(self.starts, lengths)
        self.pos = np.arange(n) - self.start
        self.left = self.start + np.repeat(lengths, lengths) - 1 - np.arange(n)


def shift(s, n: int, g: Groups):
    """The value ``n`` rows of the group away (n < 0: before)."""
    (x, ok), m = s, abs(n)
    y, there = np.zeros_like(x), np.zeros(len(x), dtype=bool)
    if n == 0:
        return s
    if m < len(x):
        if n < 0:
            y[m:], there[m:] = x[:-m], ok[:-m] & (g.pos[m:] >= m)
        else:
            y[:-m], there[:-m] = x[m:], ok[m:] & (g.left[:-m] >= m)
    return y, there


def shift_present(s, present: np.ndarray, n: int, g: Groups):
    """The value of the nth present row before (n < 0) or after a row of its group."""
    x, ok = s
    at, upto = np.flatnonzero(present), np.cumsum(present)
    before = upto - present
    rank = before + n if n < 0 else upto + n - 1
    last = upto[g.start + g.pos + g.left] - 1 if len(x) else upto
    there = (rank >= before[g.start]) & (rank <= last)
    to = at[np.where(there, rank, 0)] if len(at) else np.zeros(len(x), dtype=np.int64)
    return x[to], there & ok[to]


def average(s, n: int, g: Groups):
    """Mean of the present values of ``n`` rows, added from the oldest on."""
    x, ok = s
    zeros = np.where(ok, x, 0.0)
    total = np.zeros(len(x))
    for j in range(min(n, len(x)) - 1, -1, -1):
        total[j:] += zeros[:len(x) - j]
    if n > 1:  # frames cut short by their group's start: running sums from there
        ends = np.append(g.starts[1:], len(x))
        for a, b in zip(g.starts.tolist(), np.minimum(g.starts + n - 1, ends).tolist()):
            total[a:b] = np.add.accumulate(zeros[a:b]) + 0.0
    so_far = np.append(0, np.cumsum(ok))
    rows = np.arange(len(x))
    count = so_far[rows + 1] - so_far[rows - np.minimum(g.pos, n - 1)]
    return total / count, count > 0


def deviation(s, n: int, g: Groups):
    """Sample standard deviation of ``n`` rows before and the row itself, by the updates that Spark makes."""
    x, ok = s
    count, mean, m2 = np.zeros(len(x)), np.zeros(len(x)), np.zeros(len(x))
    for j in range(n, -1, -1):
        y, there = shift(s, -j, g)
        more = count + there
        delta = y - mean
        part = delta / more
        mean = np.where(there, mean + part, mean)
        m2 = np.where(there, m2 + delta * (delta - part), m2)
        count = more
    return np.sqrt(m2 / (count - 1.0)), count > 1


def ratio(a, b):
    """``try_divide(a, b) - 1``."""
    return a[0] / b[0] - 1, a[1] & b[1] & (b[0] != 0)


def above(s, t: float):
    """``value > t`` as SQL has it: NaN is above all, NULL is not."""
    return s[1] & ((s[0] > t) | np.isnan(s[0]))


def series(plan: list[tuple], base: dict, g: Groups) -> tuple[dict, dict]:
    """All series of ``plan`` (name, op, inputs, n; inputs first) over the base series, and for
    each a mask of the rows that the row-based operator emits (None: all)."""
    val, present = dict(base), dict.fromkeys(base)
    for name, op, inputs, n in plan:
        x = [val[i] for i in inputs]
        masks = [present[i] for i in inputs if present[i] is not None]
        p = np.logical_and.reduce(masks) if masks else None
        if op in ("perf", "deriv"):
            other = shift(x[0], n, g) if p is None or not n else shift_present(x[0], p, n, g)
            if op == "deriv":
                out = x[0][0] - other[0], x[0][1] & other[1]
            else:
                out = ratio(x[0], other) if n < 0 else ratio(other, x[0])
            p = other[1] if p is None else p & other[1]
        elif op == "sma":
            out = average(x[0], n, g)
        elif op == "ma_plus":
            mean, some = average(x[0], n, g)
            out = mean * (n - 1) / n + x[0][0] / n, some & x[0][1]
        elif op == "stddev":
            out = deviation(x[0], n, g)
        elif op in ("boll_h", "boll_l"):
            band = x[1][0] * 2
            out = x[0][0] + band if op == "boll_h" else x[0][0] - band, x[0][1] & x[1][1]
        elif op == "diff":
            out = x[0][0] - x[1][0], x[0][1] & x[1][1]
        elif op == "rate":
            out = ratio(x[0], x[1])
        elif op in ("class", "gt"):
            got = np.zeros(len(x[0][0]))
            if op == "gt":
                got[above((x[0][0] * 100, x[0][1]), n)] = 1.0
            else:
                for t, c in reversed(CLASSES):
                    got[above(x[0], t)] = c
            out = got, np.ones(len(got), dtype=bool) if p is None else p
        else:
            raise ValueError(f"unknown operator {op}")
        val[name], present[name] = out, p
    return val, present


def blocks(batches, keys: list[str]):
    """(table, first row of a group?) of whole groups, from sorted Arrow batches."""
    import pyarrow as pa

    def firsts(t):
        new = np.zeros(t.num_rows, dtype=bool)
        new[:1] = True
        for k in keys:
            c = t.column(k).combine_chunks()
            c = c.dictionary_encode(null_encoding="encode").indices if pa.types.is_string(c.type) or pa.types.is_large_string(c.type) else c
            c = c.to_numpy(zero_copy_only=False)
            new[1:] |= c[1:] != c[:-1]
        return new

    held, n, need = [], 0, BLOCK_ROWS
    for b in batches:
        held.append(b)
        n += b.num_rows
        if n < need:
            continue
        t = pa.Table.from_batches(held).combine_chunks()
        new = firsts(t)
        cut = int(np.flatnonzero(new)[-1])
        if cut:
            yield t.slice(0, cut), new[:cut]
        held = t.slice(cut).to_batches()
        n -= cut
        need = max(BLOCK_ROWS, 2 * n)
    if n:
        t = pa.Table.from_batches(held).combine_chunks()
        yield t, firsts(t)


def numbers(column):
    """(values, ok) of an Arrow column of doubles."""
    import pyarrow.compute as pc
    c = column.combine_chunks()
    ok = pc.is_valid(c).to_numpy(zero_copy_only=False)
    return np.where(ok, c.to_numpy(zero_copy_only=False), 0.0), ok


def doubles(x, ok):
    import pyarrow as pa
    if ok.all():
        return pa.array(x)
    return pa.Array.from_buffers(pa.float64(), len(x), [pa.py_buffer(np.packbits(ok, bitorder="little").tobytes()), pa.py_buffer(np.ascontiguousarray(x))])


def on_grid(x, ok):
    """Values on the grid of 1e-6 (eight significant digits from 1e4 on), as longs."""
    y = np.floor(x * 1e6 + 0.3183098)
    big = ~(np.abs(x) < 1e4)
    if big.any():
        b = x[big]
        y[big] = np.floor(b * np.power(10.0, 7 - np.floor(np.log10(np.abs(b)))) + 0.3183098)
    y[np.isnan(y)] = 0.0  # as Java casts NaN
    return longs(y, ok)


def longs(y, ok):
    import pyarrow as pa
    return pa.array(y.astype(np.int64), mask=None if ok.all() else ~ok)


def real_blocks(batches, plan: list[tuple], base: list[str], groups: list[str], halo: str):
    """(rows, values, presence) of whole groups, halo rows left out after the series are computed."""
    import pyarrow as pa
    for t, new in blocks(batches, groups):
        with np.errstate(all="ignore"):
            val, present = series(plan, {c: numbers(t.column(c)) for c in base}, Groups(new))
        real = ~t.column(halo).to_numpy(zero_copy_only=False)
        if not real.all():
            t, val = t.filter(pa.array(real)), {c: (x[real], ok[real]) for c, (x, ok) in val.items()}
            present = {c: p if p is None else p[real] for c, p in present.items()}
        if t.num_rows:
            yield t, val, present


def wide_task(plan: list[tuple], base: list[str], groups: list[str], halo: str, kept: list[str],
              wanted: list[str], flags: list[str], names: list[str], encode=doubles):
    """A ``mapInArrow`` function: the columns ``kept``, the series ``wanted`` and the presence of
    ``flags`` for each row, named ``names``. ``encode`` makes an Arrow column of a series."""
    def task(batches):
        import pyarrow as pa
        for t, val, present in real_blocks(batches, plan, base, groups, halo):
            with np.errstate(all="ignore"):
                cols = [t.column(c).combine_chunks() for c in kept] + [encode(*val[c]) for c in wanted]
            cols += [pa.array(np.ones(t.num_rows, dtype=bool) if present[c] is None else present[c]) for c in flags]
            out = pa.RecordBatch.from_arrays(cols, names)
            for lo in range(0, out.num_rows, OUT_ROWS):
                yield out.slice(lo, OUT_ROWS)
    return task


def long_task(plan: list[tuple], base: list[str], groups: list[str], halo: str, kept: list[str],
              wanted: list[str], names: list[str]):
    """A ``mapInArrow`` function: a row (``kept``, value, type) for each row and each of the series
    ``wanted`` that the row-based operator emits."""
    def task(batches):
        import pyarrow as pa
        for t, val, present in real_blocks(batches, plan, base, groups, halo):
            whole = [t.column(c).combine_chunks() for c in kept]
            for c in wanted:
                (x, ok), cols = val[c], whole
                if present[c] is not None:
                    there = pa.array(present[c])
                    x, ok, cols = x[present[c]], ok[present[c]], [k.filter(there) for k in whole]
                if len(x):
                    yield pa.RecordBatch.from_arrays([*cols, doubles(x, ok), pa.repeat(pa.scalar(c), len(x))], names)
    return task
