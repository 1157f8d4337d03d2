"""Declarative indicator plan: a list of series definitions.

A definition names its operator, its input series and its row parameter; the
wide builder derives the layering (dependency depth) and the exact
look-back / look-ahead each series needs from these definitions.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

from tidemark.functions import names as N

BASE = ("Close", "Open", "Low", "High")


@dataclass(frozen=True)
class Series:
    name: str
    op: str                 # base sma ma_plus stddev perf deriv boll_h boll_l diff rate class gt
    inputs: tuple[str, ...] = ()
    n: int = 0

    @property
    def own_back(self) -> int:
        if self.op in ("sma", "ma_plus"):
            return self.n - 1
        if self.op == "stddev":
            return self.n
        if self.op in ("perf", "deriv"):
            return -self.n if self.n < 0 else 0
        return 0

    @property
    def own_fwd(self) -> int:
        if self.op in ("perf", "deriv") and self.n > 0:
            return self.n
        return 0


# --- constructors (mirror the operator vocabulary) -------------------------

def base(name: str) -> Series:
    return Series(name, "base")


def sma(src: str, to: str, n: int) -> Series:
    return Series(to, "sma", (src,), n)


def ma_plus(src: str, to: str, n: int) -> Series:
    return Series(to, "ma_plus", (src,), n)


def stddev(src: str, n: int) -> Series:
    return Series(N.stddev_name(src, n), "stddev", (src,), n)


def perf(src: str, n: int) -> Series:
    return Series(N.perf_name(src, n), "perf", (src,), n)


def deriv(src: str, n: int) -> Series:
    return Series(N.deriv_name(src, n), "deriv", (src,), n)


def bollinger(src: str, sd: str) -> list[Series]:
    return [Series(N.boll_high_name(src), "boll_h", (src, sd)),
            Series(N.boll_low_name(src), "boll_l", (src, sd))]


def diff(a: str, b: str) -> Series:
    return Series(N.diff_name(a, b), "diff", (a, b))


def rate(a: str, b: str) -> Series:
    return Series(N.rate_name(a, b), "rate", (a, b))


def classification(src: str) -> Series:
    return Series(N.CLASS_NAME, "class", (src,))


def bin_gt(src: str, t: int) -> Series:
    return Series(N.gt_name(t), "gt", (src,), t)


# --- the standard plan ------------------------------------------------------
# The seven layers of the standard indicator plan, in the
# original order (69 series).  Windows: XS 3, S 6, M 12, L 30, XL 90, XXL 200;
# deviations over 10 preceding rows; performance offsets as listed.

def standard_layers() -> list[list[Series]]:
    return [
        [base("Close"), base("Open"), base("Low"), base("High")],
        [ma_plus("Close", "XS", 3), ma_plus("Close", "S", 6), ma_plus("Close", "M", 12),
         ma_plus("Close", "L", 30), ma_plus("Close", "XL", 90), ma_plus("Close", "XXL", 200),
         ma_plus("Open", "XS-O", 3), ma_plus("High", "XS-H", 3), ma_plus("Low", "XS-L", 3)],
        [stddev("Close", 10), stddev("XS", 10), stddev("M", 10),
         perf("Close", -1), perf("Close", +1), perf("Close", +5),
         perf("XS", 30), perf("XS", 15), perf("XS", 5),
         perf("XS", -1), perf("XS", -5), perf("XS", -15), perf("XS", -30)],
        [*bollinger("Close", "STDDEV-Close-10"), *bollinger("XS", "STDDEV-XS-10"),
         *bollinger("M", "STDDEV-M-10"),
         deriv("P-XS-5", -1), deriv("P-XS-15", -1), deriv("P-XS-30", -1),
         diff("P-XS-1", "P-XS-5"), diff("P-XS-5", "P-XS-15"), diff("P-XS-15", "P-XS-30")],
        [rate("Close", "BOL-H-Close"), rate("Close", "BOL-L-Close"),
         rate("XS", "BOL-H-XS"), rate("XS", "BOL-L-XS"),
         rate("M", "BOL-H-M"), rate("M", "BOL-L-M"),
         rate("Close", "Open"), rate("High", "Low"),
         rate("XS", "XS-O"), rate("XS", "XS-H"), rate("XS", "XS-L"),
         rate("XS", "S"), rate("XS", "L"), rate("S", "L"), rate("S", "M"),
         rate("M", "L"), rate("L", "XL"), rate("XL", "XXL")],
        [deriv("XS/XS-O", -1), deriv("XS/XS-H", -1), deriv("XS/XS-L", -1),
         deriv("XS/S", -1), deriv("XS/L", -1), deriv("S/M", -1),
         deriv("S/L", -1), deriv("M/L", -1), deriv("L/XL", -1)],
        [classification("P-XS+15"), bin_gt("P-Close+5", 3),
         bin_gt("P-Close+5", 2), bin_gt("P-Close+5", 1)],
    ]


@lru_cache(maxsize=None)
def standard_plan() -> tuple[Series, ...]:
    return tuple(s for layer in standard_layers() for s in layer)


def standard_names() -> list[str]:
    return [s.name for s in standard_plan()]


# --- plan analysis ----------------------------------------------------------

def by_name(plan) -> dict[str, Series]:
    out = {}
    for s in plan:
        if s.name in out:
            raise ValueError(f"duplicate series {s.name}")
        out[s.name] = s
    return out


def closure(plan, wanted: list[str]) -> list[Series]:
    """Definitions needed to produce ``wanted`` (in plan order)."""
    idx = by_name(plan)
    need: set[str] = set()
    stack = list(wanted)
    while stack:
        n = stack.pop()
        if n in need:
            continue
        if n not in idx:
            raise KeyError(f"unknown series {n}")
        need.add(n)
        stack.extend(idx[n].inputs)
    return [s for s in plan if s.name in need]


def layering(plan) -> list[list[Series]]:
    """Group definitions by dependency depth (base series are depth 0)."""
    idx = by_name(plan)
    depth: dict[str, int] = {}

    def d(name: str) -> int:
        if name not in depth:
            s = idx[name]
            depth[name] = 0 if not s.inputs else 1 + max(d(i) for i in s.inputs)
        return depth[name]

    layers: dict[int, list[Series]] = {}
    for s in plan:
        layers.setdefault(d(s.name), []).append(s)
    return [layers[k] for k in sorted(layers)]


def reach(plan) -> tuple[int, int]:
    """Total (look-back, look-ahead) rows over the deepest dependency chains.
    Labels read the presence of their source's counterpart row, which is
    already inside the source's reach."""
    idx = by_name(plan)
    memo: dict[str, tuple[int, int]] = {}

    def r(name: str) -> tuple[int, int]:
        if name not in memo:
            s = idx[name]
            b = f = 0
            for i in s.inputs:
                ib, if_ = r(i)
                b, f = max(b, ib), max(f, if_)
            memo[name] = (b + s.own_back, f + s.own_fwd)
        return memo[name]

    back = fwd = 0
    for s in plan:
        b, f = r(s.name)
        back, fwd = max(back, b), max(fwd, f)
    return back, fwd
