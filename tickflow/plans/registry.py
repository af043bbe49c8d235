"""Registry of queries and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tickflow.plans.ticks import TICKS_SQL

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

LEG_RISES = "id_p > lag(id_p) over (order by date_trd, trd_id)"

TAGGED_SQL = f"""
rising as (select *, {LEG_RISES} as rises from raw),
tagged as (
  select *, case when rises then
      case when flag_d = 1 and chg_max * s_run < 0 and chg_max < 0 then 'mi_down'
           when flag_d = 1 and chg_max * s_run < 0 and chg_max > 0 then 'mi_up'
           when flag_d = 1 and chg_max * s_run > 0 and chg_max < 0 then 'md_down'
           when flag_d = 1 and chg_max * s_run > 0 and chg_max > 0 then 'md_up'
           when chg_max < 0 then 'mw_down'
           when chg_max > 0 then 'mw_up' end end as model
  from rising)"""


def r6(expr: str, alias: str | None = None) -> str:
    return f"(round(({expr})::double, 6) + 0.0)" + (f" as {alias}" if alias else "")


def r6s(*names: str) -> str:
    return ", ".join(r6(n, n) for n in names)


def sql(body: str, *ctes: str, tagged: bool = False) -> str:
    parts = [TICKS_SQL] + ([TAGGED_SQL] if tagged else []) + list(ctes)
    return "with " + ",\n".join(parts) + "\n" + body


def query(name: str, oracle: str | None = None):
    def add(fn):
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn
    return add
