"""SQL for DuckDB, for comparison: bars from order lines, and recursive series as folds over lists."""

from __future__ import annotations

from ..functions.windows import rows

BARS = """px as (
  select 'S' || l_suppkey as ticker, cast(l_shipdate as date) as date, l_extendedprice / l_quantity as px, l_quantity as q,
         {'a': l_orderkey, 'b': l_linenumber, 'c': l_partkey, 'd': l_extendedprice, 'e': l_quantity} as k from lineitem
), bars as (
  select ticker, date, min_by(px, k) as open, max(px) as high, min(px) as low, max_by(px, k) as close, sum(q) as volume from px group by ticker, date
)"""
DIM = """dim as (
  select 'S' || s_suppkey as ticker, s_name as description, greatest(s_acctbal, 0.0) * 3e7 as market_cap, r_name as sector, n_name as industry,
         case when s_suppkey % 2 = 0 then 'NYSE' else 'NASDAQ' end as exchange
  from supplier join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey
)"""


def on_bars(*steps: str, select: str, dim: bool = False) -> str:
    """bars, then named steps ("name as (...)"), then a select."""
    return "with " + ",\n".join([BARS, *([DIM] if dim else []), *steps]) + "\n" + select


def layer(name: str, source: str, **columns: str) -> str:
    """A step that adds columns to those of another."""
    return f"{name} as (select *, " + ", ".join(f"{v} as {k}" for k, v in columns.items()) + f" from {source})"


def so_far(column: str) -> str:
    return f"list({column}) filter ({column} is not null) over {rows(None)}"


def _if_any(column: str, value: str, least: int = 1) -> str:
    return f"case when {column} is not null and count({column}) over {rows(None)} >= {least} then {value} end"


def ewm(column: str, n: int = 0, alpha: float | None = None) -> str:
    a = repr(alpha if alpha is not None else 2.0 / (n + 1))
    return _if_any(column, f"list_reduce({so_far(column)}, lambda p, q: p + {a}::double * (q - p))")


def ewm_adjusted(column: str, n: int = 0, alpha: float | None = None, least: int = 1) -> str:
    a = alpha if alpha is not None else 2.0 / (n + 1)
    total = f"list_reduce({so_far(column)}, lambda p, q: p * {1 - a!r}::double + q)"
    return _if_any(column, f"{total} * {a!r}::double / (1 - pow({1 - a!r}::double, count({column}) over {rows(None)}))", least)


def wilder(column: str, n: int) -> str:
    values = so_far(column)
    return _if_any(column, f"list_reduce(list_prepend(list_avg(({values})[1:{n}]), ({values})[{n + 1}:]), lambda p, q: (p * {n - 1} + q) / {n})", n)


def latest(source: str, *columns: str, digits: int = 4) -> str:
    """The last row of each ticker; columns named with a # are rounded."""
    picked = ", ".join(f"round({c[1:]}, {digits}) as {c[1:]}" if c[0] == "#" else c for c in columns)
    return f"select ticker, {picked} from {source} qualify row_number() over (partition by ticker order by date desc) = 1"
