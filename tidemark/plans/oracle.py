"""DuckDB SQL for the correctness check (independent long-form formulation).

Each series is its own CTE computed the row-based way: windows over the rows
of its input series, LAG/LEAD with rows dropped where the counterpart value
is missing, binary series as equi-joins on (isin, date).  The wide table is
the ``sum``-pivot of the union of all series.  Doubles are compared as BIGINTs on a 1e-6 grid
(eight significant digits above 1e4) on both sides; the odd offset keeps exact
ties such as x.xxxxxx5 off the rounding edge.
"""

from __future__ import annotations

from tidemark.plans import spec as S



def Q(expr: str) -> str:
    """Absolute 1e-6 grid below 1e4, eight significant digits above (large
    values come from near-zero divisors, which amplify last-bit noise)."""
    x = f"({expr})"
    return (f"CAST(CASE WHEN abs({x}) < 1e4 THEN floor({x} * 1e6 + 0.3183098) "
            f"ELSE floor({x} * power(10.0, 7 - floor(log10(abs({x})))) + 0.3183098) END AS BIGINT)")


def ident(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


ORDER_SD = "l_orderkey, l_linenumber, l_partkey, l_extendedprice"

BARS_SUPPLIER_DAY = f"""
SELECT CAST(l_suppkey AS VARCHAR) AS isin, CAST(l_shipdate AS DATE) AS date,
  first(p ORDER BY {ORDER_SD}) AS "Open", max(p) AS "High", min(p) AS "Low",
  last(p ORDER BY {ORDER_SD}) AS "Close",
  sum(CAST(l_quantity AS DOUBLE)) AS "Number_of_Shares",
  CAST(count(*) AS DOUBLE) AS "Number_of_Trades",
  sum(p * l_quantity) AS "Turnover"
FROM (SELECT *, l_extendedprice / NULLIF(l_quantity, 0) AS p FROM lineitem) li
GROUP BY 1, 2
"""

BARS_EVENT_HOUR = """
SELECT event_type AS isin, date_trunc('hour', ts) AS date,
  first(value ORDER BY ts, event_id) AS "Open", max(value) AS "High", min(value) AS "Low",
  last(value ORDER BY ts, event_id) AS "Close",
  CAST(count(*) AS DOUBLE) AS "Number_of_Shares",
  CAST(count(*) AS DOUBLE) AS "Number_of_Trades",
  sum(value * 1.0) AS "Turnover"
FROM events
GROUP BY 1, 2
"""

BAR_COLS = ["Open", "High", "Low", "Close", "Number_of_Shares", "Number_of_Trades", "Turnover"]


def quantized_bars(bars_sql: str) -> str:
    cols = ", ".join(f"{Q(ident(c))} AS {ident(c)}" for c in BAR_COLS)
    return f"SELECT isin, date, {cols} FROM ({bars_sql}) b"


W = "PARTITION BY isin ORDER BY date"


def _shift(n: int) -> str:
    if n < 0:
        return f"lag(value, {-n}) OVER ({W})"
    if n > 0:
        return f"lead(value, {n}) OVER ({W})"
    return "value"


def series_sql(s: S.Series, src: list[str], bars: str = "bars") -> str:
    """Row-based SQL of one series; ``src`` are the CTE names of its inputs."""
    n = s.n
    if s.op == "base":
        return f"SELECT isin, date, {ident(s.name)} AS value FROM {bars}"
    if s.op == "sma":
        return (f"SELECT isin, date, avg(value) OVER ({W} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
                f" AS value FROM {src[0]}")
    if s.op == "ma_plus":
        return (f"SELECT isin, date, (avg(value) OVER ({W} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW))"
                f" * {n - 1} / {n} + value / {n} AS value FROM {src[0]}")
    if s.op == "stddev":
        return (f"SELECT isin, date, stddev_samp(value) OVER ({W} ROWS BETWEEN {n} PRECEDING AND CURRENT ROW)"
                f" AS value FROM {src[0]}")
    if s.op in ("perf", "deriv"):
        if s.op == "deriv":
            v = "v1 - v2"
        elif n < 0:
            v = "v1 / NULLIF(v2, 0) - 1"
        else:
            v = "v2 / NULLIF(v1, 0) - 1"
        return (f"SELECT isin, date, {v} AS value FROM (SELECT isin, date, value AS v1, "
                f"{_shift(n)} AS v2 FROM {src[0]}) t WHERE v2 IS NOT NULL")
    if s.op in ("boll_h", "boll_l", "diff", "rate"):
        e = {"boll_h": "a.value + b.value * 2", "boll_l": "a.value - b.value * 2",
             "diff": "a.value - b.value", "rate": "a.value / NULLIF(b.value, 0) - 1"}[s.op]
        return (f"SELECT a.isin, a.date, {e} AS value FROM {src[0]} a JOIN {src[1]} b "
                f"ON a.isin = b.isin AND a.date = b.date")
    if s.op == "class":
        return ("SELECT isin, date, CAST(CASE WHEN value > 0.05 THEN 5.0 WHEN value > 0.03 THEN 3.0 "
                f"WHEN value > 0.01 THEN 1.0 ELSE 0.0 END AS DOUBLE) AS value FROM {src[0]}")
    if s.op == "gt":
        return (f"SELECT isin, date, CAST(CASE WHEN value * 100 > {n} THEN 1.0 ELSE 0.0 END AS DOUBLE)"
                f" AS value FROM {src[0]}")
    raise ValueError(s.op)


def long_ctes(plan, names: list[str], bars_sql: str) -> tuple[str, dict[str, str]]:
    """``WITH`` clause computing every needed series as its own CTE, plus a
    ``long`` CTE with the union of the ``names`` series."""
    needed = S.closure(tuple(plan), names)
    cte = {s.name: f"s{i}" for i, s in enumerate(needed)}
    parts = [f"bars AS MATERIALIZED ({bars_sql})"]
    for s in needed:
        parts.append(f"{cte[s.name]} AS MATERIALIZED ({series_sql(s, [cte[i] for i in s.inputs])})")
    union = " UNION ALL ".join(f"SELECT isin, date, value, {lit(n)} AS type FROM {cte[n]}" for n in names)
    parts.append(f"long AS ({union})")
    return "WITH " + ",\n".join(parts), cte


def wide_sql(plan, names: list[str], bars_sql: str, quantize: bool = True) -> str:
    w, _ = long_ctes(plan, names, bars_sql)
    cols = []
    for n in names:
        e = f"sum(value) FILTER (WHERE type = {lit(n)})"
        cols.append(f"{Q(e) if quantize else e} AS {ident(n)}")
    return f"{w}\nSELECT isin, date, {', '.join(cols)} FROM long GROUP BY isin, date"


def long_sql(plan, names: list[str], bars_sql: str, select: str) -> str:
    w, _ = long_ctes(plan, names, bars_sql)
    return f"{w}\n{select}"
