"""The ``ticks`` trade table, derived from ``events``.

One definition for Spark (``ticks``) and one for DuckDB (``TICKS_SQL``).
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickflow import constants as C
from tickflow.operators.regimes import tag_regimes
from tickflow.order import (DAY_ORDER, Order, dense_position, previous_row, running_group_max,
                            running_sum)
from tickflow.runtime import attach, state_of, written

_built: dict[tuple, DataFrame] = {}

# Arrive in the input and feed the engineered features.
_SPECIAL = {
    "smart_price": "value",
    "rng_ewma": "value + user_id * 0.01",
    "vewma": "value * 0.3 + user_id * 0.02",
    "vewma_g_p": "value * 0.7 - user_id * 0.03",
    "book_imb": "case when event_id % 97 = 0 then null else value * s_run end",
    "msg_imb": "(user_id * 7 + event_id) % 201 * 0.01 - 1",
    "sspread": "case when event_id % 53 = 0 then null else (user_id % 5) * 0.5 + value * 0.001 end",
    "PA_up": "case when s_run >= 0 then value * 0.1 else 0.0 end",
    "PA_down": "case when event_id % 11 = 0 then null when s_run < 0 then value * 0.1 else 0.0 end",
    "chgfreq": "(user_id * 3 + event_id) % 101 * 0.01",
    "last_d_s": "s_run * 1.0",
    "n_trd": "(user_id * 5 + event_id) % 500 * 1.0",
    "n_big": "user_id % 6 * 1.0",
    "n_big_aux": "user_id % 8 * 1.0",
    "n_p": "user_id % 13 * 1.0",
    "n_p_aux": "user_id % 7 * 1.0",
}
_BOUNDED = ["vol_big_ratio", "aggimb", "aggimb_big", "n_aggimb", "loc_agg_imb_m",
            "loc_aggbig_imb_m", "pagg_c_best_0p7", "pagg_v_best_0p7", "vol_big_ratio_aux",
            "aggimb_aux", "aggimb_big_aux", "n_aggimb_aux", "loc_agg_imb_m_aux",
            "loc_aggbig_imb_m_aux", "pagg_c_best_0p7_aux", "pagg_v_best_0p7_aux"]
_SIGNED = ["agg_net_d", "loc_agg_net_d", "aggbig_net_d", "loc_aggbig_net_d", "agg_net_m",
           "aggbig_net_m", "loc_agg_net_m", "loc_aggbig_net_m", "agg_net_m_aux",
           "aggbig_net_m_aux", "loc_agg_net_m_aux", "loc_aggbig_net_m_aux", "vewma_c_v",
           "vewmag_dif", "abagg", "abagg_aux"]
_POSITIVE = ["imp_c_0p8", "imp_v_0p8", "int_c_0p8", "int_v_0p8", "aggpior_c", "aggpior_v",
             "abs_c", "abs_v", "depth_bid7", "depth_ask7", "big_c", "big_v", "vol_trd", "vol_big",
             "vol_trd_aux", "n_trd_aux", "vol_big_aux", "big_c_aux", "big_v_aux",
             "aggpior_c_aux", "aggpior_v_aux", "loc_aggbig_c_m", "loc_aggbig_v_m",
             "loc_aggbig_c_m_aux", "loc_aggbig_v_m_aux"]
_MOVES = [f"movesc_{side}_{size}_{fade}" for size in C.PROP_SIZES for fade in C.MOVE_FADES
          for side in ("bid", "ask")]
_PROPS = [name for e in C.PROP_EXPONENTS for name in C.prop_names(e)]


def _raw_features() -> dict[str, str]:
    out = dict(_SPECIAL)
    for i, name in enumerate(_BOUNDED):
        out[name] = f"(user_id * {i + 2} + event_id * {2 * i + 3}) % 201 * 0.01 - 1"
    for i, name in enumerate(_SIGNED):
        out[name] = f"value * s_run * 0.{i % 9 + 1} + (user_id * {i + 3} + event_id) % 31 - 15"
    for i, name in enumerate(_POSITIVE):
        out[name] = f"value * 0.{i % 9 + 1} + (user_id * {i + 2} + event_id * 3) % 41"
    for i, name in enumerate(_MOVES):
        out[name] = f"value * 0.0{i % 9 + 1} + (user_id * {i + 5} + event_id) % 17"
    for i, name in enumerate(_PROPS):
        out[name] = (f"case when event_id % {29 + i} = 0 then null "
                     f"else (user_id * {i + 4} + event_id) % 91 * 0.01 end")
    return out


RAW_FEATURES = _raw_features()


# what the raw features are computed from
FEATURE_SOURCE = ["s_run", "event_id", "user_id", "value"]


def _spark_features() -> dict[str, str]:
    """The same numbers for Spark: hundredths as one division of whole numbers, which rounds as the decimal does and
    spares a wide decimal per value."""
    out = dict(RAW_FEATURES)
    out |= {"msg_imb": "((user_id * 7 + event_id) % 201 - 100) / 100D", "chgfreq": "(user_id * 3 + event_id) % 101 / 100D",
            "sspread": "case when event_id % 53 = 0 then null else (user_id % 5) / 2D + value * 0.001 end"}
    out |= {n: f"cast({_SPECIAL[n].removesuffix(' * 1.0')} as double)" for n in _SPECIAL if _SPECIAL[n].endswith(" * 1.0")}
    for i, name in enumerate(_BOUNDED):
        out[name] = f"((user_id * {i + 2} + event_id * {2 * i + 3}) % 201 - 100) / 100D"
    for i, name in enumerate(_PROPS):
        out[name] = f"case when event_id % {29 + i} = 0 then null else (user_id * {i + 4} + event_id) % 91 / 100D end"
    return out


_SPARK_FEATURES = _spark_features()

# A score with ties that is higher on average when ``hit`` is 1.
_PROB = ("(event_id * 7919 + user_id * 104729) % 1000 * 0.0007 "
         "+ case when event_type = 'purchase' then 0.2 else 0.0 end")

def build_ticks(events: DataFrame, order: Order = DAY_ORDER,
                partitions: int | None = None) -> DataFrame:
    """Stored columns of the trade table."""
    base = events.select(
        "event_id", "ts", "user_id", "event_type", "value",
        F.to_date("ts").alias("date_trd"),
        F.date_format("ts", "HH:mm:ss.SSSSSS").alias("time"),
        F.when(F.col("event_type").isin("click", "purchase"), 1)
        .when(F.col("event_type").isin("error", "signup"), -1).otherwise(0).cast("long").alias("s_run"))
    ticks = written(dense_position(base, "date_trd", ["ts", "event_id"], "trd_id", partitions), "pos")
    # one row per day, from the written rows
    daily = ticks.groupBy("date_trd").agg(F.round(F.avg("value"), 6).alias("freq"))

    chg_max = (F.when(F.col("s_run") == 0, F.col("value") - 40)
               .when(F.col("event_id") % 3 == 0, -F.col("s_run") * F.col("value"))
               .otherwise(F.col("s_run") * F.col("value")))
    ticks = previous_row(ticks.withColumn("chg_max", chg_max), ["s_run", "chg_max"], order,
                         across_parts=False)
    changed = F.coalesce((F.col("s_run") != F.col("prev_s_run")).cast("long"), F.lit(0))
    ticks = running_sum(ticks.withColumn("_change", changed), "_change", "id_run", order)
    ticks = running_group_max(ticks, "id_run", "value", "_top", order)
    ticks = attach(ticks, daily, ["date_trd"])

    plus = F.col("event_type").isin("click", "purchase")
    max_run = F.col("s_run") * F.col("_top")
    price = F.lit(100) + F.col("value") / 10
    return ticks.select(
        "date_trd", F.expr("trd_id div 3").alias("update"), "time", "trd_id",
        F.when(plus, "+").otherwise("-").alias("side"),
        price.alias("first_price"), (price + F.col("s_run")).alias("last_price"),
        (price + F.col("s_run") / 2).alias("avg_price"),
        (F.col("user_id") % 9 + 1).alias("qty"), (F.col("value") * F.col("s_run")).alias("chg_cum"),
        (F.col("value") > 100).cast("long").alias("flag_big"),
        "id_run", "s_run", max_run.alias("max_run"),
        (F.abs(max_run) >= 0.6 * F.col("freq")).cast("long").alias("flag_d"),
        F.expr("trd_id div 2").alias("id_p"), F.col("trd_id").alias("seq"),
        "chg_max", (-F.col("prev_chg_max")).alias("chg_max_mp"), "freq",
        F.expr(f"cast({_PROB} as double)").alias("prob"),
        (F.col("event_type") == "purchase").cast("long").alias("hit"),
        "event_id", "user_id", "value")


def with_raw_features(core: DataFrame, names: Iterable[str] = RAW_FEATURES) -> DataFrame:
    """Add the ``f_*`` input columns."""
    return core.select("*", *[F.expr(f"cast({_SPARK_FEATURES[n]} as double)").alias("f_" + n) for n in names])


def _stored(spark: SparkSession, sf_dir: str, kind: str, build: Callable[[], DataFrame]) -> DataFrame:
    slot = (spark.sparkContext.applicationId, sf_dir, kind, state_of(spark, f"{sf_dir}/events.parquet"))
    if slot not in _built:
        _built[slot] = written(build(), kind)
    return _built[slot]


def ticks(spark: SparkSession, sf_dir: str, features: bool = False) -> DataFrame:
    """Trade table, built once per application and folder and kept as a written table.

    ``features`` adds the raw ``f_*`` columns; scans read only the columns in use.
    """
    if features:
        return tagged_ticks(spark, sf_dir).drop("model")
    return _stored(spark, sf_dir, "ticks", lambda: build_ticks(spark.read.parquet(f"{sf_dir}/events.parquet")))


def tagged_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trade table with raw features and ``model``, written too. Regimes come from the narrow table, so that no wide
    row is shuffled or sorted."""
    def build() -> DataFrame:
        core = ticks(spark, sf_dir)
        wide = with_raw_features(tag_regimes(core))
        return wide.select(*core.columns, *["f_" + n for n in RAW_FEATURES], "model")
    return _stored(spark, sf_dir, "tagged", build)


_RAW_SQL = ",\n  ".join(f"cast({e} as double) as f_{n}" for n, e in RAW_FEATURES.items())

TICKS_SQL = f"""
t0 as (
  select event_id, ts, user_id, event_type, cast(value as double) as value,
         cast(ts as date) as date_trd, strftime(ts, '%H:%M:%S.%f') as time,
         cast(case when event_type in ('click', 'purchase') then 1
                   when event_type in ('error', 'signup') then -1 else 0 end as bigint) as s_run,
         row_number() over (partition by cast(ts as date) order by ts, event_id) - 1 as trd_id
  from events),
t1 as (
  select *,
         case when s_run = 0 then value - 40
              when event_id % 3 = 0 then -s_run * value else s_run * value end as chg_max,
         lag(s_run) over (partition by date_trd order by trd_id) as prev_s,
         avg(value) over (partition by date_trd) as day_avg
  from t0),
t2 as (
  select *, lag(chg_max) over (partition by date_trd order by trd_id) as prev_chg,
         cast(sum(case when s_run <> prev_s then 1 else 0 end)
              over (partition by date_trd order by trd_id) as bigint) as id_run,
         round(day_avg, 6) as freq
  from t1),
t3 as (
  select *, s_run * max(value) over (partition by date_trd, id_run order by trd_id) as max_run
  from t2),
ticks as (
  select date_trd, trd_id // 3 as update, time, trd_id,
         case when event_type in ('click', 'purchase') then '+' else '-' end as side,
         100 + value / 10 as first_price, 100 + value / 10 + s_run as last_price,
         100 + value / 10 + s_run / 2.0::double as avg_price,
         user_id % 9 + 1 as qty, value * s_run as chg_cum,
         cast(value > 100 as bigint) as flag_big,
         id_run, s_run, max_run,
         cast(abs(max_run) >= 0.6::double * freq as bigint) as flag_d,
         trd_id // 2 as id_p, trd_id as seq, chg_max, -prev_chg as chg_max_mp, freq,
         cast({_PROB} as double) as prob, cast(event_type = 'purchase' as bigint) as hit,
         event_id, user_id, value
  from t3),
raw as (
  select *,
  {_RAW_SQL}
  from ticks)"""
