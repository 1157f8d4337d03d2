"""Series naming conventions (the names are data: they appear as ``type``
values in the long store and as column names in the wide table)."""

from __future__ import annotations


def perf_name(src: str, n: int) -> str:
    """Relative change: ``P-XS-5`` (past), ``P-XS+5`` (future)."""
    return f"P-{src}{'' if n < 0 else '+'}{n}"


def deriv_name(src: str, n: int) -> str:
    """Absolute change: ``D-P-XS-5-1`` (past), ``D-...+1`` (future)."""
    return f"D-{src}{'' if n < 0 else '+'}{n}"


def stddev_name(src: str, n: int) -> str:
    return f"STDDEV-{src}-{n}"


def boll_high_name(src: str) -> str:
    return f"BOL-H-{src}"


def boll_low_name(src: str) -> str:
    return f"BOL-L-{src}"


def diff_name(a: str, b: str) -> str:
    return f"{a}-{b}"


def rate_name(a: str, b: str) -> str:
    return f"{a}/{b}"


def gt_name(threshold: int) -> str:
    return f"gt{threshold}"


CLASS_NAME = "Class"
