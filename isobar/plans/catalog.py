"""Queries of the engine over the standard tables, with the same in SQL."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from isobar import sinks
from isobar.functions import crs as C
from isobar.functions import units as U
from isobar.model import DimensionMap, Field, mask, stack
from isobar.operators import filters, regrid, spatial
from isobar.plans.calculate import calculate
from isobar.plans.request import Request
from isobar.sources.datasets import Dataset, from_records, read_all, request_size

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


# Fields over the tables, and the same as SQL.
EVENT_COLUMNS = {"time": "ts", "x": "cast(-105 + user_id % 15 as double)", "y": "cast(35 + (user_id div 15) % 10 as double)", "rlz": "event_type", "gid": "event_id", "value": "value"}
BOXED = {"lb_x": "cast(-105 + user_id % 15 as double) - 0.5D", "ub_x": "cast(-105 + user_id % 15 as double) + 0.5D", "lb_y": "cast(35 + (user_id div 15) % 10 as double) - 0.5D", "ub_y": "cast(35 + (user_id div 15) % 10 as double) + 0.5D"}
EVENTS = "e as (select ts as time, cast(-105 + user_id % 15 as double) as x, cast(35 + (user_id // 15) % 10 as double) as y, event_type as rlz, event_id as gid, value from events)"
BOX_EVENTS = EVENTS + ", b as (select *, x - 0.5 as lb_x, x + 0.5 as ub_x, y - 0.5 as lb_y, y + 0.5 as ub_y from e)"
LINE_COLUMNS = {"time": "l_shipdate", "x": "cast(l_suppkey % 10 as double)", "y": "cast((l_suppkey div 10) % 10 as double)", "quantity": "l_quantity", "price": "l_extendedprice"}
LINES = "l as (select l_shipdate as time, cast(l_suppkey % 10 as double) as x, cast((l_suppkey // 10) % 10 as double) as y, l_linenumber as level, l_quantity as quantity, l_extendedprice as price, l_discount as discount, l_tax as tax, l_orderkey as orderkey from lineitem)"
DAILY = LINES + ", d as (select x, y, time, sum(quantity) as quantity from l group by x, y, time)"
SELECTION = [(-103.2, 36.2, -100.1, 40.0), (-95.5, 38.0, -93.0, 43.7), (-104.5, 35.5, -102.5, 37.5)]
SEL = "s as (select * from (values (1, -103.2, 36.2, -100.1, 40.0), (2, -95.5, 38.0, -93.0, 43.7), (3, -104.5, 35.5, -102.5, 37.5)) as t(ugid, x0, y0, x1, y1))"


def events(spark: SparkSession, d: str, boxes: bool = False) -> Field:
    return Dataset(f"{d}/events.parquet", variable="value", columns={**EVENT_COLUMNS, **(BOXED if boxes else {})}, units={"value": "K"}).get(spark)


def lines(spark: SparkSession, d: str, level: bool = False, *variables: str) -> Field:
    more = {"level": "l_linenumber"} if level else {}
    extra = {"discount": "l_discount", "tax": "l_tax"}
    names = variables or ("quantity", "price")
    columns = {k: v for k, v in {**LINE_COLUMNS, **extra, **more}.items() if k in ("time", "x", "y", "level", *names)}
    return Dataset(f"{d}/lineitem.parquet", variable=list(names), columns=columns).get(spark)


def daily(spark: SparkSession, d: str, scale: str = "quantity", name: str = "quantity", units: str | None = None) -> Field:
    """One value for each cell and day."""
    f = lines(spark, d, False, "quantity")
    df = f.df.groupBy("x", "y", "time").agg(F.sum("quantity").alias("quantity")).select("x", "y", "time", F.expr(scale).alias(name))
    return Field.of(df, (name,), units={name: units} if units else {})


def rounded(df: DataFrame, *names: str, places: int = 6) -> DataFrame:
    return df.withColumns({n: F.round(n, places) for n in names})


def out(f: Field, *names: str, places: int = 6) -> DataFrame:
    kinds = dict(f.df.dtypes)
    return rounded(f.df.select(*(names or f.df.columns)), *[v for v in f.variables if kinds.get(v) == "double" and v in (names or f.df.columns)], places=places)


# Set functions and groupings.
@query(
    "agg_month_year",
    f"with {LINES} select x, y, cast(year(time) as int) as year, cast(month(time) as int) as month, make_timestamp(year(time), month(time), 16, 0, 0, 0) as time, min(time) as lb_time, max(time) as ub_time, avg(quantity) as mean, min(quantity) as low, max(quantity) as high, sum(quantity) as total, count(quantity) as n_quantity from l group by x, y, year(time), month(time)",
)
def agg_month_year(spark: SparkSession, d: str) -> DataFrame:
    f = lines(spark, d, False, "quantity")
    calcs = [{"func": "mean", "name": "mean"}, {"func": "min", "name": "low"}, {"func": "max", "name": "high"}, {"func": "sum", "name": "total"}]
    return calculate(f, calcs, ["month", "year"], sample_size=True).df


@query("agg_std_median", f"with {LINES} select x, y, cast(year(time) as int) as year, round(stddev_pop(price), 4) as std, median(price) as median from l group by x, y, year(time)")
def agg_std_median(spark: SparkSession, d: str) -> DataFrame:
    f = calculate(lines(spark, d, False, "price"), ["std", "median"], ["year"])
    return rounded(f.df.select("x", "y", "year", "std", "median"), "std", places=4)


@query("agg_freq_perc", f"with {LINES} select x, y, cast(month(time) as int) as month, round(avg(quantity), 6) as mean, round(quantile_cont(quantity, 0.9), 6) as p90, round(quantile_cont(quantity, 0.95), 6) as p95, round(quantile_cont(quantity, 0.99), 6) as p99 from l group by x, y, month(time)")
def agg_freq_perc(spark: SparkSession, d: str) -> DataFrame:
    calcs = ["mean", *({"func": "freq_perc", "name": f"p{p}", "kwds": {"percentile": p}} for p in (90, 95, 99))]
    return out(calculate(lines(spark, d, False, "quantity"), calcs, ["month"]), "x", "y", "month", "mean", "p90", "p95", "p99")


@query(
    "agg_thresholds",
    f"with {LINES} select level, x, y, cast(year(time) as int) as year, count(*) filter (quantity between 10 and 20) as between_, count(*) filter (quantity > 25) as over_, count(*) filter (quantity <= 5) as upto_ from l group by level, x, y, year(time)",
)
def agg_thresholds(spark: SparkSession, d: str) -> DataFrame:
    calcs = ["between~between_!lower~10!upper~20", "threshold~over_!threshold~25!operation~gt", "threshold~upto_!threshold~5!operation~lte"]
    return calculate(lines(spark, d, True, "quantity"), calcs, ["year"]).df.select("level", "x", "y", "year", "between_", "over_", "upto_")


PART_TIMES = {
    "day": ("day",),
    "month": ("month",),
    "year": ("year",),
    "day_month": ("day", "month"),
    "day_year": ("day", "year"),
    "day_month_year": ("day", "month", "year"),
}
for name, parts in PART_TIMES.items():
    year = "year(time)" if "year" in parts else "year(min(time))"
    month = "month(time)" if "month" in parts else "7" if "year" in parts else "month(min(time))"
    day = "day(time)" if "day" in parts else "16" if "month" in parts else "1"
    keys = ", ".join(f"cast({p}(time) as int) as {p}" for p in parts)
    by = ", ".join(f"{p}(time)" for p in parts)
    SQL[f"group_{name}"] = f"with {EVENTS} select rlz, {keys}, make_timestamp({year}, {month}, {day}, {12 if 'day' in parts else 0}, 0, 0) as time, min(time) as lb_time, max(time) as ub_time, round(avg(value), 6) as mean, count(value) as n_value from e group by rlz, {by}"

    def grouped(spark: SparkSession, d: str, parts: tuple = parts) -> DataFrame:
        f = events(spark, d)
        f = f.with_df(f.df.drop("x", "y", "gid"))
        return out(calculate(f, "mean", list(parts), sample_size=True), "rlz", *parts, "time", "lb_time", "ub_time", "mean", "n_value")

    QUERIES[f"group_{name}"] = grouped


@query(
    "group_all",
    f"with {EVENTS}, t as (select rlz, list_sort(list(distinct time)) as times, min(time) as lb_time, max(time) as ub_time, round(avg(value), 6) as mean, max(value) as max from e group by rlz) select rlz, times[greatest(cast(floor(len(times) / 2 - 1) as int), 0) + 1] as time, lb_time, ub_time, mean, max from t",
)
def group_all(spark: SparkSession, d: str) -> DataFrame:
    f = events(spark, d)
    return out(calculate(f.with_df(f.df.drop("x", "y", "gid")), ["mean", "max"], "all"), "rlz", "time", "lb_time", "ub_time", "mean", places=6).join(calculate(f.with_df(f.df.drop("x", "y", "gid")), "max", "all").df.select("rlz", "max"), "rlz")


SEASONS = [[12, 1, 2], [3, 4, 5], [6, 7, 8], [9, 10, 11]]
SEASON = "case when month(time) in (12, 1, 2) then 'w' when month(time) in (3, 4, 5) then 'a' when month(time) in (6, 7, 8) then 'b' else 'c' end"


@query(
    "group_seasons",
    f"with {LINES}, g as (select *, case when month(time) in (12, 1, 2) then 0 when month(time) in (3, 4, 5) then 1 when month(time) in (6, 7) then 2 end as season from l) select x, season, min(time) as lb_time, max(time) as ub_time, make_timestamp(cast(floor((year(min(time)) + year(max(time))) / 2) as bigint), case when season = 0 then 1 else cast(floor((month(min(time)) + month(max(time))) / 2) as bigint) end, 16, 0, 0, 0) as time, avg(quantity) as mean from g where season is not null group by x, season",
)
def group_seasons(spark: SparkSession, d: str) -> DataFrame:
    f = lines(spark, d, False, "quantity")
    return calculate(f.with_df(f.df.drop("y")), "mean", [[3, 4, 5], [12, 1, 2], [6, 7]]).df.select("x", "season", "lb_time", "ub_time", "time", "mean")


@query("group_seasons_year", f"with {LINES} select x, case when month(time) in (12, 1, 2) then 0 when month(time) in (3, 4, 5) then 1 when month(time) in (6, 7, 8) then 2 else 3 end as season, cast(year(time) as int) as year, sum(quantity) as sum, count(quantity) as n_quantity from l group by all")
def group_seasons_year(spark: SparkSession, d: str) -> DataFrame:
    f = lines(spark, d, False, "quantity")
    return calculate(f.with_df(f.df.drop("y")), "sum", [*SEASONS, "year"], sample_size=True).df.select("x", "season", "year", "sum", "n_quantity")


@query(
    "group_seasons_unique",
    f"with {LINES}, g as (select *, case when month(time) in (6, 7, 8) then 0 else 1 end as season, year(time) + case when month(time) = 12 then 1 else 0 end as year from l where month(time) in (12, 1, 2, 6, 7, 8)) select x, season, cast(year as int) as year, min(time) as lb_time, max(time) as ub_time, sum(quantity) as sum from g group by x, season, year having count(distinct month(time)) = 3",
)
def group_seasons_unique(spark: SparkSession, d: str) -> DataFrame:
    f = lines(spark, d, False, "quantity")
    return calculate(f.with_df(f.df.drop("y")), "sum", [[12, 1, 2], [6, 7, 8], "unique"]).df.select("x", "season", "year", "lb_time", "ub_time", "sum")


# Runs.
RUNS = DAILY + ", h as (select *, year(time) as yr, quantity > 40 as hit from d), i as (select *, row_number() over (partition by x, y, yr order by time) - row_number() over (partition by x, y, yr, hit order by time) as run from h), r as (select x, y, yr, run, count(*) as length from i where hit group by x, y, yr, run), k as (select distinct x, y, yr from h)"
for how, made in {"mean": "avg(length)", "median": "median(length)", "std": "stddev_pop(length)", "max": "max(length)", "min": "min(length)"}.items():
    SQL[f"runs_duration_{how}"] = f"with {RUNS} select k.x, k.y, cast(k.yr as int) as year, round(coalesce(case when count(length) = 1 or max(length) = 1 then max(length) else {made} end, 0.0)::double, 6) as duration from k left join r on k.x = r.x and k.y = r.y and k.yr = r.yr group by k.x, k.y, k.yr"

    def duration(spark: SparkSession, d: str, how: str = how) -> DataFrame:
        return out(calculate(daily(spark, d), f"duration!threshold~40!operation~gt!summary~{how}", ["year"]), "x", "y", "year", "duration")

    QUERIES[f"runs_duration_{how}"] = duration


@query("runs_freq_duration", f"with {RUNS} select x, y, cast(yr as int) as year, cast(length as int) as duration, cast(count(*) as int) as count from r group by x, y, yr, length")
def runs_freq_duration(spark: SparkSession, d: str) -> DataFrame:
    f = calculate(daily(spark, d), "freq_duration!threshold~40!operation~gt", ["year"])
    return f.df.select("x", "y", "year", F.explode("freq_duration").alias("e")).select("x", "y", "year", "e.duration", "e.count")


@query(
    "freeze_thaw",
    f"""with recursive {DAILY},
    t as (select x, y, cast(year(time) as int) as year, row_number() over (partition by x, y, year(time) order by time) as k, quantity - 25 as v from d),
    u as (select *, sum(v) over (partition by x, y, year order by k) as total, coalesce(lag(v) over (partition by x, y, year order by k) >= 0, true) as above from t),
    b as (select distinct x, y, year, 0 as begun, cast(0 as double) as base from t union select x, y, year, k - 1, total - v from u where (v >= 0) <> above),
    h as (select b.x, b.y, b.year, b.begun, min(k) as done, arg_min(sign(total - base), k) as side from b join u on u.x = b.x and u.y = b.y and u.year = b.year and k > begun and abs(total - base) >= 15 group by all),
    n as (select *, row_number() over (partition by x, y, year order by begun) as n from h),
    w as (
        select distinct x, y, year, cast(0 as bigint) as n, cast(0 as bigint) as side, cast(0 as bigint) as since, -1 as changes from t
        union all
        select w.x, w.y, w.year, n.n, case when n.begun >= w.since then n.side else w.side end, case when n.begun >= w.since and n.side <> w.side then n.done else w.since end, w.changes + case when n.begun >= w.since and n.side <> w.side then 1 else 0 end
        from w join n on n.x = w.x and n.y = w.y and n.year = w.year and n.n = w.n + 1
    )
    select x, y, year, cast(max(changes) as double) as freezethaw from w group by x, y, year""",
)
def freeze_thaw(spark: SparkSession, d: str) -> DataFrame:
    return calculate(daily(spark, d, "quantity - 25", "tas", "C"), "freezethaw!threshold~15", ["year"]).df.select("x", "y", "year", "freezethaw")


@query(
    "daily_percentile",
    f"""with {DAILY}, k as (select distinct cast(month(time) as int) as month, cast(day(time) as int) as day from d),
    p as (
        select d.x, k.month, k.day, d.quantity from d join k on not (k.month = 2 and k.day = 29)
            and exists (select 1 from (values (-1), (0), (1)) as o(n) where abs(date_diff('day', make_date(year(d.time) + o.n, k.month, case when k.month = 2 and k.day = 29 then 28 else k.day end), cast(d.time as date))) <= 2)
        union all
        select d.x, 2, 29, d.quantity from d join k on k.month = 2 and k.day = 29 and date_diff('day', make_date(year(d.time), 2, 28), cast(d.time as date)) between -1 and 2
    )
    select x, month, day, round(quantile_cont(quantity, 0.9), 6) as daily_perc from p group by x, month, day""",
)
def daily_percentile(spark: SparkSession, d: str) -> DataFrame:
    f = daily(spark, d)
    f = f.with_df(f.df.drop("y"))
    return out(calculate(f, {"func": "daily_perc", "name": "daily_perc", "kwds": {"percentile": 90, "window_width": 5}}), "x", "month", "day", "daily_perc")


# Scalar and multivariate calculations.
@query("multi_divide", f"with {LINES} select x, y, cast(year(time) as int) as year, round(avg(price / nullif(discount, 0)), 4) as divide from l group by x, y, year(time)")
def multi_divide(spark: SparkSession, d: str) -> DataFrame:
    return out(calculate(lines(spark, d, False, "price", "discount"), {"func": "divide", "kwds": {"arr1": "price", "arr2": "discount"}}, ["year"]), "x", "y", "year", "divide", places=4)


@query("scalar_ln", f"with {LINES} select x, y, cast(month(time) as int) as month, round(avg(case when discount > 0 then ln(discount) end), 6) as ln from l group by x, y, month(time)")
def scalar_ln(spark: SparkSession, d: str) -> DataFrame:
    return out(calculate(lines(spark, d, False, "discount"), "ln", ["month"]), "x", "y", "month", "ln")


@query(
    "multi_heat_index",
    f"""with {LINES}, t as (select x, y, time, quantity + 70 as t, tax * 1000 + 30 as h from l)
    select x, y, cast(year(time) as int) as year, round(avg(case when t >= 80 and h >= 40 then -42.379 + 2.04901523 * t + 10.14333127 * h - 0.22475541 * t * h - 6.83783e-3 * t * t - 5.481717e-2 * h * h + 1.22874e-3 * t * t * h + 8.5282e-4 * t * h * h - 1.99e-6 * t * t * h * h end), 6) as heat_index from t group by x, y, year(time)""",
)
def multi_heat_index(spark: SparkSession, d: str) -> DataFrame:
    f = lines(spark, d, False, "quantity", "tax")
    f = Field.of(f.df.select("x", "y", "time", (F.col("quantity") + 70).alias("tas"), (F.col("tax") * 1000 + 30).alias("rhs")), ("tas", "rhs"), units={"tas": "fahrenheit", "rhs": "percent"})
    return out(calculate(f, {"func": "heat_index", "kwds": {"tas": "tas", "rhs": "rhs"}}, ["year"]), "x", "y", "year", "heat_index")


@query("expression", f"with {LINES} select x, y, time, round(4 * exp(quantity / 50) + power(discount, 2) - abs(price - 1000) / 10, 4) as made, round(log10(price) * ln(10) + quantity / nullif(discount, 0), 4) as other from l")
def expression(spark: SparkSession, d: str) -> DataFrame:
    f = lines(spark, d, False, "quantity", "price", "discount")
    return out(calculate(f, ["made=4*exp(quantity/50) + power(discount, 2) - abs(price - 1000)/10", "other=log(price) + quantity/discount"]), "x", "y", "time", "made", "other", places=4)


# Windows over time.
for op, made in {"mean": "avg(quantity)", "min": "min(quantity)", "max": "max(quantity)", "median": "median(quantity)", "var": "var_pop(quantity)", "std": "stddev_pop(quantity)"}.items():
    for mode in ("same", "valid"):
        value = f"{made} over w" if mode == "same" else f"case when count(*) over w = 5 then {made} over w end"
        SQL[f"window_{op}_{mode}"] = f"with {DAILY} select x, y, time, round({value}, 4) as moved from d window w as (partition by x, y order by time rows between 2 preceding and 2 following)"

        def moved(spark: SparkSession, d: str, op: str = op, mode: str = mode) -> DataFrame:
            return out(calculate(daily(spark, d), f"moving_window~moved!k~5!operation~{op}!mode~{mode}"), "x", "y", "time", "moved", places=4)

        QUERIES[f"window_{op}_{mode}"] = moved


@query("convolve_same", f"with {DAILY} select x, y, time, round(1.0 * coalesce(lead(quantity) over w, 0) + 0.5 * quantity + 0.25 * coalesce(lag(quantity) over w, 0), 6) as convolved from d window w as (partition by x, y order by time)")
def convolve_same(spark: SparkSession, d: str) -> DataFrame:
    return out(calculate(daily(spark, d), {"func": "convolve_1d", "name": "convolved", "kwds": {"v": [1.0, 0.5, 0.25], "mode": "same"}}), "x", "y", "time", "convolved")


@query("convolve_valid", f"with {DAILY} select x, y, time, round(case when lead(quantity, 2) over w is not null then 1.0 * lead(quantity, 2) over w + 0.5 * lead(quantity) over w + 0.25 * quantity end, 6) as convolved from d window w as (partition by x, y order by time)")
def convolve_valid(spark: SparkSession, d: str) -> DataFrame:
    return out(calculate(daily(spark, d), {"func": "convolve_1d", "name": "convolved", "kwds": {"v": [1.0, 0.5, 0.25], "mode": "valid"}}), "x", "y", "time", "convolved")


# Climate indices of daily values.
TAS = DAILY + ", t as (select x, y, time, 248 + quantity as v from d)"
PR = DAILY + ", t as (select x, y, time, greatest(quantity - 20, 0) as v from d)"


def index_query(name: str, keys: list[str], base: str, scale: str, sql: str) -> None:
    SQL[name] = f"with {base} select x, y, cast(year(time) as int) as year, {sql} from t group by x, y, year(time)"

    def made(spark: SparkSession, d: str) -> DataFrame:
        return out(calculate(daily(spark, d, scale, "v"), keys, ["year"]), "x", "y", "year", *keys)

    QUERIES[name] = made


index_query("index_temperature_means", ["TG", "TN", "TX", "TXx", "TXn", "TNx", "TNn"], TAS, "248 + quantity", "round(avg(v), 6) as TG, round(avg(v), 6) as TN, round(avg(v), 6) as TX, max(v) as TXx, min(v) as TXn, max(v) as TNx, min(v) as TNn")
index_query("index_temperature_days", ["SU", "TR", "FD", "ID", "HD17", "GD4"], TAS, "248 + quantity", "count(*) filter (v > 298.15) as SU, count(*) filter (v > 293.15) as TR, count(*) filter (v < 273.15) as FD, count(*) filter (v < 273.15) as ID, round(sum(greatest(290.15 - v, 0)), 6) as HD17, round(sum(greatest(v - 277.15, 0)), 6) as GD4")
index_query("index_precipitation", ["PRCPTOT", "RR1", "SDII", "R10mm", "R20mm", "RX1day"], PR, "greatest(quantity - 20, 0)", "round(coalesce(sum(v) filter (v >= 1), 0), 6) as PRCPTOT, count(*) filter (v >= 1) as RR1, round(avg(v) filter (v >= 1), 6) as SDII, count(*) filter (v >= 10) as R10mm, count(*) filter (v >= 20) as R20mm, max(v) as RX1day")
index_query("index_snow", ["SD", "SD1", "SD5cm", "SD50cm"], PR, "greatest(quantity - 20, 0)", "round(avg(v), 6) as SD, count(*) filter (v >= 1) as SD1, count(*) filter (v >= 5) as SD5cm, count(*) filter (v >= 50) as SD50cm")


def spell(base: str, test: str) -> str:
    return f"with {base}, h as (select *, year(time) as yr, {test} as hit from t), i as (select *, row_number() over (partition by x, y, yr order by time) - row_number() over (partition by x, y, yr, hit order by time) as run from h), r as (select x, y, yr, run, count(*) as length from i where hit group by x, y, yr, run), k as (select distinct x, y, yr from h)"


for key, base, scale, test in (("CSU", TAS, "248 + quantity", "v > 298.15"), ("CFD", TAS, "248 + quantity", "v < 273.15"), ("CWD", PR, "greatest(quantity - 20, 0)", "v >= 1"), ("CDD", PR, "greatest(quantity - 20, 0)", "v < 1")):
    SQL[f"index_{key.lower()}"] = spell(base, test) + f" select k.x, k.y, cast(k.yr as int) as year, coalesce(max(length), 0) as {key} from k left join r using (x, y, yr) group by k.x, k.y, k.yr"

    def spells(spark: SparkSession, d: str, key: str = key, scale: str = scale) -> DataFrame:
        return calculate(daily(spark, d, scale, "v"), key, ["year"]).df.select("x", "y", "year", key)

    QUERIES[f"index_{key.lower()}"] = spells


@query(
    "index_ranges",
    f"with {LINES}, t as (select x, y, time, max(quantity) as hi, min(quantity) as lo from l group by x, y, time), s as (select *, abs((hi - lo) - lag(hi - lo) over (partition by x, y, year(time) order by time)) as step from t) select x, y, cast(year(time) as int) as year, round(avg(hi - lo), 6) as DTR, max(hi) - min(lo) as ETR, round(avg(step), 6) as vDTR from s group by x, y, year(time)",
)
def index_ranges(spark: SparkSession, d: str) -> DataFrame:
    df = lines(spark, d, False, "quantity").df.groupBy("x", "y", "time").agg(F.max("quantity").alias("hi"), F.min("quantity").alias("lo"))
    pair = {"tasmax": "hi", "tasmin": "lo"}
    return out(calculate(Field.of(df, ("hi", "lo")), [{"func": k, "kwds": pair} for k in ("DTR", "ETR", "vDTR")], ["year"]), "x", "y", "year", "DTR", "ETR", "vDTR")


@query("index_rx5day", f"with {PR}, w as (select *, case when count(*) over f = 5 then sum(v) over f end as five from t window f as (partition by x, y, year(time) order by time rows between 4 preceding and current row)) select x, y, cast(year(time) as int) as year, max(five) as RX5day from w group by x, y, year(time)")
def index_rx5day(spark: SparkSession, d: str) -> DataFrame:
    return calculate(daily(spark, d, "greatest(quantity - 20, 0)", "v"), "RX5day", ["year"]).df.select("x", "y", "year", "RX5day")


WET = PR + ", q as (select x, y, " + ", ".join(f"quantile_cont(v, 0.{p}) as q{p}" for p in (75, 95, 99)) + " from t where v >= 1 group by x, y)"


@query(
    "index_wet_percentiles",
    f"with {WET} select x, y, cast(year(time) as int) as year, "
    + ", ".join(f"count(*) filter (v >= 1 and v > q{p}) as R{p}p, round(100 * coalesce(sum(v) filter (v >= 1 and v > q{p}), 0) / nullif(sum(v) filter (v >= 1), 0), 6) as R{p}pTOT" for p in (75, 95, 99))
    + " from t left join q using (x, y) group by x, y, year(time)",
)
def index_wet_percentiles(spark: SparkSession, d: str) -> DataFrame:
    keys = [k for p in (75, 95, 99) for k in (f"R{p}p", f"R{p}pTOT")]
    return out(calculate(daily(spark, d, "greatest(quantity - 20, 0)", "v"), keys, ["year"]), "x", "y", "year", *keys)


BASIS = """k as (select distinct month(time) as m, day(time) as dd from t),
    p as (
        select t.x, t.y, k.m, k.dd, t.v from t join k on not (k.m = 2 and k.dd = 29)
            and exists (select 1 from (values (-1), (0), (1)) as o(n) where abs(date_diff('day', make_date(year(t.time) + o.n, k.m, case when k.m = 2 and k.dd = 29 then 28 else k.dd end), cast(t.time as date))) <= 2)
        union all
        select t.x, t.y, 2, 29, t.v from t join k on k.m = 2 and k.dd = 29 and date_diff('day', make_date(year(t.time), 2, 28), cast(t.time as date)) between -1 and 2
    ),
    q as (select x, y, m, dd, round(quantile_cont(v, 0.1), 9) as q10, round(quantile_cont(v, 0.9), 9) as q90 from p group by x, y, m, dd)"""

@query("index_day_percentiles", f"with {TAS}, {BASIS} select t.x, t.y, cast(year(time) as int) as year, count(*) filter (v < q10) as TG10p, count(*) filter (v < q10) as TX10p, count(*) filter (v < q10) as TN10p, count(*) filter (v > q90) as TG90p, count(*) filter (v > q90) as TX90p, count(*) filter (v > q90) as TN90p from t join q on t.x = q.x and t.y = q.y and month(time) = m and day(time) = dd group by t.x, t.y, year(time)")
def index_day_percentiles(spark: SparkSession, d: str) -> DataFrame:
    keys = ["TG10p", "TX10p", "TN10p", "TG90p", "TX90p", "TN90p"]
    return calculate(daily(spark, d, "248 + quantity", "v"), keys, ["year"]).df.select("x", "y", "year", *keys)


@query(
    "index_spell_durations",
    f"with {TAS}, {BASIS}, h as (select t.x, t.y, time, year(time) as yr, v > q90 as hot, v < q10 as cold from t join q on t.x = q.x and t.y = q.y and month(time) = m and day(time) = dd), "
    + ", ".join(f"i{c} as (select *, row_number() over (partition by x, y, yr order by time) - row_number() over (partition by x, y, yr, {c} order by time) as run from h), r{c} as (select x, y, yr, run, count(*) as n from i{c} where {c} group by x, y, yr, run having count(*) >= 6), s{c} as (select x, y, yr, sum(n) as n from r{c} group by x, y, yr)" for c in ("hot", "cold"))
    + " select k.x, k.y, cast(k.yr as int) as year, cast(coalesce(shot.n, 0) as bigint) as WSDI, cast(coalesce(scold.n, 0) as bigint) as CSDI from (select distinct x, y, yr from h) k left join shot using (x, y, yr) left join scold using (x, y, yr)",
)
def index_spell_durations(spark: SparkSession, d: str) -> DataFrame:
    return calculate(daily(spark, d, "248 + quantity", "v"), ["WSDI", "CSDI"], ["year"]).df.select("x", "y", "year", "WSDI", "CSDI")


# Filters.
FROM, TO = datetime(2024, 1, 5, 6), datetime(2024, 1, 12, 18)


@query("filter_time_range", f"with {EVENTS} select * from e where time between timestamp '2024-01-05 06:00:00' and timestamp '2024-01-12 18:00:00'")
def filter_time_range(spark: SparkSession, d: str) -> DataFrame:
    return filters.time_range(events(spark, d), FROM, TO).df


@query("filter_time_range_exclusive", f"with {LINES} select time, x, y, quantity from l where time > timestamp '1996-01-01' and time < timestamp '1996-01-10'")
def filter_time_range_exclusive(spark: SparkSession, d: str) -> DataFrame:
    return filters.time_range(lines(spark, d, False, "quantity"), datetime(1996, 1, 1), datetime(1996, 1, 10), exclusive=True).df


MONTHS = "m as (select date_trunc('month', l_shipdate) as lb_time, date_trunc('month', l_shipdate) + interval 1 month as ub_time, sum(l_quantity) as quantity from lineitem group by all)"


def months(spark: SparkSession, d: str) -> Field:
    df = spark.read.parquet(f"{d}/lineitem.parquet").groupBy(F.date_trunc("month", F.col("l_shipdate").cast("timestamp")).cast("timestamp_ntz").alias("lb_time")).agg(F.sum("l_quantity").alias("quantity"))
    df = df.withColumn("ub_time", F.col("lb_time") + F.expr("interval 1 month")).withColumn("time", F.col("lb_time") + F.expr("interval 15 days"))
    return Field.of(df, ("quantity",))


@query("filter_time_range_bounds", f"with {MONTHS} select lb_time, ub_time, quantity from m where (lb_time >= timestamp '1996-02-01' or ub_time > timestamp '1996-02-01') and (lb_time <= timestamp '1996-07-15' or ub_time < timestamp '1996-07-15')")
def filter_time_range_bounds(spark: SparkSession, d: str) -> DataFrame:
    return filters.time_range(months(spark, d), datetime(1996, 2, 1), datetime(1996, 7, 15), contiguous=True).df.select("lb_time", "ub_time", "quantity")


@query("filter_time_region", f"with {LINES} select time, x, y, quantity from l where month(time) in (6, 7) and year(time) in (1996, 1998)")
def filter_time_region(spark: SparkSession, d: str) -> DataFrame:
    return filters.time_region(lines(spark, d, False, "quantity"), {"month": [6, 7], "year": [1996, 1998]}).df


@query("filter_time_region_bounds", f"with {MONTHS} select lb_time, quantity from m where month(lb_time) in (12, 2)")
def filter_time_region_bounds(spark: SparkSession, d: str) -> DataFrame:
    return filters.time_region(months(spark, d), {"month": [2, 12]}).df.select("lb_time", "quantity")


@query("filter_time_function", f"with {EVENTS} select gid, time, value from e where hour(time) = 12")
def filter_time_function(spark: SparkSession, d: str) -> DataFrame:
    return filters.time_function(events(spark, d), lambda t, _: F.hour(t) == 12).df.select("gid", "time", "value")


@query("filter_level_range", f"with {LINES} select level, count(*) as n, sum(quantity) as quantity from l where level between 2 and 4 group by level")
def filter_level_range(spark: SparkSession, d: str) -> DataFrame:
    f = filters.level_range(lines(spark, d, True, "quantity"), 2, 4)
    return f.df.groupBy("level").agg(F.count("*").alias("n"), F.sum("quantity").alias("quantity"))


@query("filter_slice", f"with {LINES}, r as (select *, dense_rank() over (order by level) - 1 as lp, dense_rank() over (order by x) - 1 as xp, dense_rank() over (order by time desc) as tp from l) select time, level, x, y, quantity from r where lp = 1 and xp >= 2 and xp < 5 and tp <= 30")
def filter_slice(spark: SparkSession, d: str) -> DataFrame:
    return filters.slice_axes(lines(spark, d, True, "quantity"), [None, -30, 1, None, (2, 5)]).df.select("time", "level", "x", "y", "quantity")


@query("filter_snippet", f"with {LINES} select time, level, x, y, quantity from l where time = (select min(time) from l) and level = (select min(level) from l where time = (select min(time) from l))")
def filter_snippet(spark: SparkSession, d: str) -> DataFrame:
    return filters.snippet(lines(spark, d, True, "quantity")).df.select("time", "level", "x", "y", "quantity")


@query("mask_cascade", f"with {LINES} select x, y, case when quantity > 25 then null else price end as price, case when quantity > 25 then null else discount end as discount from l")
def mask_cascade(spark: SparkSession, d: str) -> DataFrame:
    f = lines(spark, d, False, "quantity", "price", "discount")
    return mask(f, F.col("quantity") > 25).df.select("x", "y", "price", "discount")


@query("date_parts", f"with {EVENTS} select gid, cast(year(time) as int) as YEAR, cast(month(time) as int) as MONTH, cast(day(time) as int) as DAY, value from e")
def date_parts(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("time")
    return events(spark, d).df.select("gid", F.year(t).alias("YEAR"), F.month(t).alias("MONTH"), F.dayofmonth(t).alias("DAY"), "value")


# Units.
@query("units_conform", f"with {EVENTS} select gid, round(value * 1.0 - 273.15, 6) as c, round(value * 1.8 - 459.67, 6) as f from e")
def units_conform(spark: SparkSession, d: str) -> DataFrame:
    f = events(spark, d)
    c, h = (U.conform(f, u).df.select("gid", F.round("value", 6).alias(n)) for u, n in (("C", "c"), ("F", "f")))
    return c.join(h, "gid")


# Sources and sinks.
@query("source_request", f"with {LINES} select time, x, y, quantity as amount from l where time between timestamp '1997-01-01' and timestamp '1997-01-31' and month(time) = 1")
def source_request(spark: SparkSession, d: str) -> DataFrame:
    found = Dataset(f"{d}/lineitem.parquet", variable=["quantity", "price"], columns=LINE_COLUMNS, time_range=(datetime(1997, 1, 1), datetime(1997, 1, 31)), time_region={"month": [1]}, predicate=lambda v: v != "price", rename_variable={"quantity": "amount"})
    return found.get(spark).df


@query("source_multi", f"with {LINES}, a as (select x, y, time, sum(quantity) as quantity from l group by x, y, time), b as (select x, y, time, max(price) as price from l group by x, y, time) select a.x, a.y, a.time, quantity, price from a join b using (x, y, time)")
def source_multi(spark: SparkSession, d: str) -> DataFrame:
    f = lines(spark, d)
    a = Field.of(f.df.groupBy("x", "y", "time").agg(F.sum("quantity").alias("quantity")), ("quantity",))
    b = Field.of(f.df.groupBy("x", "y", "time").agg(F.max("price").alias("price")), ("price",))
    return read_all(spark, [Dataset(a), Dataset(b)]).df.select("x", "y", "time", "quantity", "price")


@query("source_records", "select * from (values (1, 'a', 4.0), (2, 'b', 5.5)) as t(ugid, name, area)")
def source_records(spark: SparkSession, d: str) -> DataFrame:
    return from_records(spark, [{"name": "a", "area": 4.0}, {"name": "b", "area": 5.5}], "name string, area double").select("ugid", "name", F.col("area").cast("decimal(2,1)"))


@query("source_size", f"with {LINES} select v as variable, count(*) * 8 / 1024 as kb from l, (values ('quantity'), ('price')) as t(v) group by v")
def source_size(spark: SparkSession, d: str) -> DataFrame:
    return request_size(lines(spark, d))


@query("set_stack", f"with {EVENTS} select 'a' as part, gid, value from e where value < 250 union all select 'b', gid, value from e where value >= 250")
def set_stack(spark: SparkSession, d: str) -> DataFrame:
    f = events(spark, d)
    return stack([f.where("value < 250"), f.where("value >= 250")], "part", ["a", "b"]).df.select("part", "gid", "value")


@query("set_datasets", f"with {EVENTS} select 1 as DID, gid, value from e where rlz = 'click' union all select 2, gid, value from e where rlz <> 'click'")
def set_datasets(spark: SparkSession, d: str) -> DataFrame:
    f = events(spark, d)
    return Request([f.where("rlz = 'click'"), f.where("rlz <> 'click'")]).execute(spark).select("DID", "gid", "value")


@query("sink_header", f"with {EVENTS} select 1 as DID, gid as GID, rlz as RLZ, time as TIME, cast(year(time) as int) as YEAR, cast(month(time) as int) as MONTH, cast(day(time) as int) as DAY, value from e")
def sink_header(spark: SparkSession, d: str) -> DataFrame:
    return sinks.tabular(events(spark, d))


@query("sink_melted", f"with {LINES}, t as (select level, cast(year(time) as int) as YEAR, avg(quantity) as m, max(quantity) as h from l group by level, year(time)) select level as LEVEL, YEAR, 'mean' as VARIABLE, round(m, 6) as VALUE, 'mean' as CALC_KEY, 'quantity' as SRC_VAR from t union all select level, YEAR, 'high', h, 'max', 'quantity' from t")
def sink_melted(spark: SparkSession, d: str) -> DataFrame:
    f = lines(spark, d, True, "quantity")
    f = calculate(f.with_df(f.df.drop("x", "y")), [{"func": "mean", "name": "mean"}, {"func": "max", "name": "high"}], ["year"])
    f = Field(f.df.drop("year"), DimensionMap({"time": "time", "level": "level"}, {}), f.variables)
    return rounded(sinks.tabular(f, True, {"mean": "mean", "high": "max"}, {"mean": "quantity", "high": "quantity"}), "VALUE").select("LEVEL", "YEAR", "VARIABLE", "VALUE", "CALC_KEY", "SRC_VAR")


@query("sink_did", "select * from (values (1, 'quantity', cast(null as varchar), cast(null as varchar), 'K', 'a.nc', cast(null as varchar))) as t(DID, VARIABLE, STANDARD_NAME, LONG_NAME, UNITS, URI, \"GROUP\")")
def sink_did(spark: SparkSession, d: str) -> DataFrame:
    f = lines(spark, d, False, "quantity")
    return sinks.did_table(spark, [Field(f.df, f.dims, f.variables, {"quantity": "K"})], ["a.nc"])


@query("sink_geojson")
def sink_geojson(spark: SparkSession, d: str) -> DataFrame:
    return sinks.geojson(events(spark, d, True))


# Space.
@query("space_intersects", f"with {BOX_EVENTS}, {SEL} select ugid as UGID, gid, value from b join s on lb_x < x1 and ub_x > x0 and lb_y < y1 and ub_y > y0")
def space_intersects(spark: SparkSession, d: str) -> DataFrame:
    return spatial.intersects(events(spark, d, True), spatial.selections(spark, SELECTION)).df.select("UGID", "gid", "value")


@query("space_intersects_tiles", f"with {BOX_EVENTS}, {SEL} select ugid as UGID, gid, value from b join s on lb_x < x1 and ub_x > x0 and lb_y < y1 and ub_y > y0")
def space_intersects_tiles(spark: SparkSession, d: str) -> DataFrame:
    return spatial.intersects(events(spark, d, True), spatial.selections(spark, SELECTION), tile=2.0).df.select("UGID", "gid", "value")


@query("space_touches", f"with {BOX_EVENTS}, {SEL} select ugid as UGID, gid, value from b join s on lb_x <= x1 and ub_x >= x0 and lb_y <= y1 and ub_y >= y0")
def space_touches(spark: SparkSession, d: str) -> DataFrame:
    return spatial.intersects(events(spark, d, True), spatial.selections(spark, SELECTION), touch=True).df.select("UGID", "gid", "value")


@query("space_points", f"with {EVENTS}, {SEL} select ugid as UGID, gid, value from e join s on x between x0 and x1 and y between y0 and y1 where ugid in (1, 3)")
def space_points(spark: SparkSession, d: str) -> DataFrame:
    return Request(events(spark, d), geom=SELECTION, geom_select_uid=[1, 3]).execute(spark).select("UGID", "gid", "value")


@query("space_where", f"with {EVENTS}, {SEL} select ugid as UGID, gid, value from e join s on x between x0 and x1 and y between y0 and y1 where x1 - x0 > 2.2")
def space_where(spark: SparkSession, d: str) -> DataFrame:
    return Request(events(spark, d), geom=SELECTION, geom_select_sql_where="x1 - x0 > 2.2", optimized_bbox_subset=True).execute(spark).select("UGID", "gid", "value")


@query("space_union", f"with {BOX_EVENTS}, {SEL} select 1 as UGID, gid, value from b where exists (select 1 from s where lb_x < x1 and ub_x > x0 and lb_y < y1 and ub_y > y0)")
def space_union(spark: SparkSession, d: str) -> DataFrame:
    return Request(events(spark, d, True), geom=SELECTION, agg_selection=True).execute(spark).select("UGID", "gid", "value")


CLIPPED = f"{BOX_EVENTS}, {SEL}, c as (select ugid, gid, rlz, time, value, greatest(lb_x, x0) as lb_x, least(ub_x, x1) as ub_x, greatest(lb_y, y0) as lb_y, least(ub_y, y1) as ub_y from b join s on lb_x < x1 and ub_x > x0 and lb_y < y1 and ub_y > y0)"


@query("space_clip", f"with {CLIPPED} select ugid as UGID, gid, round(lb_x, 6) as lb_x, round(ub_x, 6) as ub_x, round(lb_y, 6) as lb_y, round(ub_y, 6) as ub_y, value from c")
def space_clip(spark: SparkSession, d: str) -> DataFrame:
    f = spatial.clip(events(spark, d, True), spatial.selections(spark, SELECTION))
    return rounded(f.df.select("UGID", "gid", "lb_x", "ub_x", "lb_y", "ub_y", "value"), "lb_x", "ub_x", "lb_y", "ub_y")


@query("space_average", f"with {CLIPPED}, w as (select *, (ub_x - lb_x) * (ub_y - lb_y) as a, date_trunc('day', time) as day from c) select ugid as UGID, rlz, round(sum(a * value) / sum(a), 6) as value from w group by ugid, rlz")
def space_average(spark: SparkSession, d: str) -> DataFrame:
    f = spatial.clip(events(spark, d, True), spatial.selections(spark, SELECTION))
    f = spatial.weighted_average(f.with_df(f.df.drop("time", "gid")))
    return rounded(f.df.select("UGID", "rlz", "value"), "value")


@query("space_average_calc", f"with {CLIPPED}, w as (select *, (ub_x - lb_x) * (ub_y - lb_y) as a from c), m as (select ugid, rlz, time, sum(a * value) / sum(a) as v from w group by ugid, rlz, time) select ugid as UGID, rlz, cast(day(time) as int) as day, round(avg(v), 6) as mean, round(max(v), 6) as max from m group by ugid, rlz, day(time)")
def space_average_calc(spark: SparkSession, d: str) -> DataFrame:
    r = Request(events(spark, d, True), geom=SELECTION, spatial_operation="clip", aggregate=True, calc=["mean", "max"], calc_grouping=["day"])
    return rounded(r.execute(spark).select("UGID", "rlz", "day", "mean", "max"), "mean", "max")


@query("space_calc_raw", f"with {EVENTS}, {SEL}, m as (select ugid, rlz, x, y, max(value) as v from e join s on x between x0 and x1 and y between y0 and y1 group by ugid, rlz, x, y) select ugid as UGID, rlz, round(avg(v), 6) as max from m group by ugid, rlz")
def space_calc_raw(spark: SparkSession, d: str) -> DataFrame:
    f = events(spark, d)
    r = Request(f.with_df(f.df.drop("gid")), geom=SELECTION, aggregate=True, calc="max", calc_grouping="all", calc_raw=True)
    return rounded(r.execute(spark).select("UGID", "rlz", "max"), "max")


@query(
    "space_calc_raw_day",
    f"with {CLIPPED}, m as (select ugid, rlz, lb_x, ub_x, lb_y, ub_y, day(time) as dd, max(value) as v, (ub_x - lb_x) * (ub_y - lb_y) as a from c group by all), "
    "g as (select ugid, day(time) as dd, min(time) as lb_time, max(time) as ub_time from c group by all) "
    "select ugid as UGID, rlz, cast(dd as int) as day, lb_time, ub_time, round(sum(a * v) / sum(a), 6) as max from m join g using (ugid, dd) group by all",
)
def space_calc_raw_day(spark: SparkSession, d: str) -> DataFrame:
    f = events(spark, d, True)
    r = Request(f.with_df(f.df.drop("gid")), geom=SELECTION, spatial_operation="clip", aggregate=True, calc="max", calc_grouping=["day"], calc_raw=True)
    return rounded(r.execute(spark).select("UGID", "rlz", "day", "lb_time", "ub_time", "max"), "max")


@query("space_nearest", f"with {EVENTS}, {SEL}, r as (select ugid, gid, row_number() over (partition by ugid order by power(x - (x0 + x1) / 2, 2) + power(y - (y0 + y1) / 2, 2), gid desc) as n from e, s) select ugid as UGID, r.gid, value from r join e using (gid) where n = 1")
def space_nearest(spark: SparkSession, d: str) -> DataFrame:
    return spatial.nearest(events(spark, d), spatial.selections(spark, SELECTION), "gid").df.select("UGID", "gid", "value")


@query("space_radius", f"with {EVENTS}, p as (select * from (values (1, -101.0, 38.0), (2, -97.5, 41.5)) as t(ugid, px, py)) select ugid as UGID, gid, value from e, p where power(x - px, 2) + power(y - py, 2) <= 2.25")
def space_radius(spark: SparkSession, d: str) -> DataFrame:
    return spatial.within_radius(events(spark, d), spatial.selections(spark, [(-101.0, 38.0), (-97.5, 41.5)]), 1.5).df.select("UGID", "gid", "value")


@query("space_buffer", f"with {EVENTS}, {SEL} select ugid as UGID, gid from e join s on x between x0 - 0.75 and x1 + 0.75 and y between y0 - 0.75 and y1 + 0.75")
def space_buffer(spark: SparkSession, d: str) -> DataFrame:
    return spatial.intersects(events(spark, d), spatial.buffered(spatial.selections(spark, SELECTION), 0.75)).df.select("UGID", "gid")


RING = [(-104.0, 35.0), (-96.0, 36.0), (-99.0, 43.0)]
#: The sides of RING, each with the ring's inside to its left: ax, ay, bx, by_.
SIDES = "r as (select * from (values (-104.0, 35.0, -96.0, 36.0), (-96.0, 36.0, -99.0, 43.0), (-99.0, 43.0, -104.0, 35.0)) as t(ax, ay, bx, by_))"
#: For each cell whether it and the triangle share area: no side of either parts them. far: distance of the triangle's line from the cell's centre.
TRIANGLE = f"""{BOX_EVENTS}, {SIDES}, cells as (select distinct x, y, lb_x, ub_x, lb_y, ub_y from b),
    corners as (select x, y, px, py from cells, lateral (values (lb_x, lb_y), (lb_x, ub_y), (ub_x, lb_y), (ub_x, ub_y)) as c(px, py)),
    parted as (select distinct x, y from (select x, y, ax, ay, max((bx - ax) * (py - ay) - (by_ - ay) * (px - ax)) as most from corners, r group by x, y, ax, ay) where most <= 0),
    inside as (select * from cells where lb_x < -96 and ub_x > -104 and lb_y < 43 and ub_y > 35 and not exists (select 1 from parted p where p.x = cells.x and p.y = cells.y)),
    near as (
        select x, y, min(sqrt(power(ax + t * (bx - ax) - x, 2) + power(ay + t * (by_ - ay) - y, 2))) as far, bool_and((bx - ax) * (y - ay) - (by_ - ay) * (x - ax) > 0) as within
        from (select *, greatest(0, least(1, ((x - ax) * (bx - ax) + (y - ay) * (by_ - ay)) / (power(bx - ax, 2) + power(by_ - ay, 2)))) as t from cells, r) group by x, y
    )"""


@query("space_polygon", f"with {TRIANGLE} select 9 as UGID, gid, value from b join inside using (x, y)")
def space_polygon(spark: SparkSession, d: str) -> DataFrame:
    return spatial.intersects(events(spark, d, True), spatial.selections(spark, [{"geom": RING, "properties": {"UGID": 9}}])).df.select("UGID", "gid", "value")


@query("space_union_ring", f"with {TRIANGLE}, {SEL} select 1 as UGID, gid, value from b where exists (select 1 from inside i where i.x = b.x and i.y = b.y) or exists (select 1 from s where ugid = 2 and lb_x < x1 and ub_x > x0 and lb_y < y1 and ub_y > y0)")
def space_union_ring(spark: SparkSession, d: str) -> DataFrame:
    return Request(events(spark, d, True), geom=[{"geom": RING}, {"geom": SELECTION[1]}], agg_selection=True).execute(spark).select("UGID", "gid", "value")


@query("space_buffer_ring", f"with {TRIANGLE} select 1 as UGID, gid from e join near using (x, y) where within or far <= 1.3")
def space_buffer_ring(spark: SparkSession, d: str) -> DataFrame:
    return spatial.intersects(events(spark, d), spatial.buffered(spatial.selections(spark, [RING]), 1.3)).df.select("UGID", "gid")


#: The triangle's area in a cell by the trapezoids under its sides, cut to the cell's columns and rows at breaks where nothing bends.
CUT = f"""{TRIANGLE}, bends as (
        select x, y, u from inside, lateral (values (lb_x), (ub_x), (-104.0), (-96.0), (-99.0)) as v(u)
        union select x, y, ax + (q - ay) * (bx - ax) / (by_ - ay) from inside, r, lateral (values (lb_y), (ub_y)) as v(q)
    ),
    strips as (select i.*, u as a, lead(u) over (partition by i.x, i.y order by u) as c from inside i join (select distinct x, y, u from bends) k on k.x = i.x and k.y = i.y and u between lb_x and ub_x),
    lines as (
        select s.x, s.y, a, c, lb_y, ub_y, ay + ((a + c) / 2 - ax) * (by_ - ay) / (bx - ax) as h from strips s, r
        where c is not null and (a + c) / 2 between least(ax, bx) and greatest(ax, bx)
    ),
    areas as (select x, y, sum(w) as area from (select x, y, a, (c - a) * (least(greatest(max(h), lb_y), ub_y) - least(greatest(min(h), lb_y), ub_y)) as w from lines group by x, y, a, c, lb_y, ub_y) group by x, y)"""


@query("space_polygon_average", f"with {CUT} select 1 as UGID, rlz, round(sum(area * value) / sum(area), 6) as value from b join areas using (x, y) where area > 0 group by rlz")
def space_polygon_average(spark: SparkSession, d: str) -> DataFrame:
    f = spatial.clip(events(spark, d, True), spatial.selections(spark, [RING]))
    return rounded(spatial.weighted_average(f.with_df(f.df.drop("time", "gid"))).df.select("UGID", "rlz", "value"), "value")


@query("space_extent", f"with {BOX_EVENTS} select min(lb_x) as min_x, min(lb_y) as min_y, max(ub_x) as max_x, max(ub_y) as max_y from b")
def space_extent(spark: SparkSession, d: str) -> DataFrame:
    return spatial.extent(events(spark, d, True))


@query("space_resolution", f"with {EVENTS}, c as (select distinct x from e), s as (select abs(abs(x) - abs(lag(x) over (order by x))) as step from c) select avg(step) as resolution from s")
def space_resolution(spark: SparkSession, d: str) -> DataFrame:
    return spatial.resolution(events(spark, d), "x")


@query("space_bounds", f"with {EVENTS}, c as (select distinct x * x / 100 as x from e), m as (select x, (x + lead(x) over (order by x)) / 2 as u, (x + lag(x) over (order by x)) / 2 as l from c), g as (select *, u - lag(u) over (order by x) as gap from m), a as (select avg(gap) as mean from g) select round(x, 6) as x, round(coalesce(l, u - mean), 6) as lb_x, round(coalesce(u, l + mean), 6) as ub_x from m, a")
def space_bounds(spark: SparkSession, d: str) -> DataFrame:
    return rounded(spatial.bounds_1d(events(spark, d).df.select((F.col("x") * F.col("x") / 100).alias("x")), "x"), "x", "lb_x", "ub_x")


@query("space_tiles", f"with {EVENTS} select cast(floor(x / 4) as bigint) as tile_x, cast(floor(y / 4) as bigint) as tile_y, count(*) as n from e group by all")
def space_tiles(spark: SparkSession, d: str) -> DataFrame:
    return spatial.tiles(events(spark, d), 4.0).df.groupBy("tile_x", "tile_y").agg(F.count("*").alias("n"))


@query("space_reorder", f"with {EVENTS} select gid, cast(dense_rank() over (order by x) - 1 as int) as x_index from e")
def space_reorder(spark: SparkSession, d: str) -> DataFrame:
    return spatial.reorder(events(spark, d)).df.select("gid", "x_index")


@query("wrap_unwrap", f"with {EVENTS}, u as (select gid, case when x < 0 then x + 360 else x end as u from e) select gid, u, case when u > 180 then u - 360 else u end as w from u")
def wrap_unwrap(spark: SparkSession, d: str) -> DataFrame:
    f = C.unwrap(events(spark, d))
    f = f.with_df(f.df.withColumn("u", F.col("x")))
    return C.wrap(f).df.select("gid", "u", F.col("x").alias("w"))


@query("wrap_selection", f"with {EVENTS}, u as (select gid, value, x + 283 as x, y from e) select 1 as UGID, gid, value from u where x between 179 and 186 and y between 36 and 41")
def wrap_selection(spark: SparkSession, d: str) -> DataFrame:
    f = events(spark, d)
    f = C.wrap(f.with_df(f.df.withColumn("x", F.col("x") + 283)))
    return spatial.intersects(f, spatial.wrap_selections(spatial.selections(spark, [(179.0, 36.0, 186.0, 41.0)]))).df.select("UGID", "gid", "value")


@query("crs_cartesian", f"with {EVENTS} select gid, round(cos(radians(y)) * cos(radians(x)), 9) as cx, round(cos(radians(y)) * sin(radians(x)), 9) as cy, round(sin(radians(y)), 9) as cz from e")
def crs_cartesian(spark: SparkSession, d: str) -> DataFrame:
    x, y, z = C.to_cartesian(F.col("x"), F.col("y"))
    return rounded(events(spark, d).df.select("gid", x.alias("cx"), y.alias("cy"), z.alias("cz")), "cx", "cy", "cz", places=9)


@query(
    "crs_rotated_pole",
    f"with {EVENTS}, t as (select gid, radians(x + 162) as l, radians(y) as p, radians(39.25) as q from e) select gid, round(degrees(atan2(-cos(p) * sin(l), sin(p) * cos(q) - cos(p) * cos(l) * sin(q))), 6) as rlon, round(degrees(asin(sin(p) * sin(q) + cos(p) * cos(l) * cos(q))), 6) as rlat from t",
)
def crs_rotated_pole(spark: SparkSession, d: str) -> DataFrame:
    x, y = C.geographic_to_rotated(F.col("x"), F.col("y"), -162.0, 39.25)
    return rounded(events(spark, d).df.select("gid", x.alias("rlon"), y.alias("rlat")), "rlon", "rlat")


@query(
    "crs_albers",
    f"with {EVENTS}, k as (select (sin(radians(29.5)) + sin(radians(45.5))) / 2 as n), t as (select gid, radians(x + 96) as l, radians(y) as p, n, cos(radians(29.5)) * cos(radians(29.5)) + 2 * n * sin(radians(29.5)) as c from e, k), r as (select *, 6370997.0 * sqrt(c - 2 * n * sin(p)) / n as rho, 6370997.0 * sqrt(c - 2 * n * sin(radians(23.0))) / n as rho0 from t) select gid, round(rho * sin(n * l), 3) as px, round(rho0 - rho * cos(n * l), 3) as py from r",
)
def crs_albers(spark: SparkSession, d: str) -> DataFrame:
    x, y = C.project(C.Crs("albers", {"lat_1": 29.5, "lat_2": 45.5, "lat_0": 23.0, "lon_0": -96.0}), F.col("x"), F.col("y"))
    return rounded(events(spark, d).df.select("gid", x.alias("px"), y.alias("py")), "px", "py", places=3)


@query("crs_analytic", f"with {EVENTS} select gid, round(2 + power(cos(radians(y)), 2) + cos(2 * radians(case when x < 0 then x + 360 else x end)), 9) as exact from e")
def crs_analytic(spark: SparkSession, d: str) -> DataFrame:
    lam, phi = F.radians(C.unwrap_x(F.col("x"))), F.radians(F.col("y"))
    return rounded(events(spark, d).df.select("gid", (2 + F.cos(phi) * F.cos(phi) + F.cos(2 * lam)).alias("exact")), "exact", places=9)


# Regridding.
def grid(spark: SparkSession, d: str) -> Field:
    """Average value of each cell."""
    f = events(spark, d, True)
    return Field.of(f.df.groupBy("x", "y", "lb_x", "ub_x", "lb_y", "ub_y").agg(F.avg("value").alias("value")), ("value",))


def target(spark: SparkSession, step: float = 2.5) -> Field:
    xs = spark.range(5).select((F.lit(-104.25) + F.col("id") * step).alias("x"))
    ys = spark.range(2).select((F.lit(36.25) + F.col("id") * step).alias("y"))
    df = xs.crossJoin(ys).withColumns({"lb_x": F.col("x") - step / 2, "ub_x": F.col("x") + step / 2, "lb_y": F.col("y") - step / 2, "ub_y": F.col("y") + step / 2, "value": F.lit(0.0)})
    return Field.of(df, ("value",))


GRID = BOX_EVENTS + ", g as (select x, y, lb_x, ub_x, lb_y, ub_y, avg(value) as value from b group by all), t as (select a.i * 2.5 - 104.25 as x, b.j * 2.5 + 36.25 as y from (select unnest(range(5)) as i) a, (select unnest(range(2)) as j) b)"


@query("regrid_conserve", f"with {GRID}, w as (select t.x, t.y, g.value, (least(ub_x, t.x + 1.25) - greatest(lb_x, t.x - 1.25)) * (degrees(sin(radians(least(ub_y, t.y + 1.25)))) - degrees(sin(radians(greatest(lb_y, t.y - 1.25))))) as w from t join g on lb_x < t.x + 1.25 and ub_x > t.x - 1.25 and lb_y < t.y + 1.25 and ub_y > t.y - 1.25) select cast(x as double) as x, cast(y as double) as y, round(sum(w * value) / sum(w), 6) as value from w group by x, y")
def regrid_conserve(spark: SparkSession, d: str) -> DataFrame:
    return out(regrid.regrid(grid(spark, d), target(spark)), "x", "y", "value")


@query(
    "regrid_bilinear",
    f"with {GRID}, w as (select t.x, t.y, g.value, (1 - abs(t.x - g.x)) * (1 - abs(t.y - g.y)) as w from t join g on abs(t.x - g.x) < 1 and abs(t.y - g.y) < 1), lim as (select min(x) as ax, max(x) as bx, min(y) as ay, max(y) as by_ from g) select cast(x as double) as x, cast(y as double) as y, round(sum(w * value) / sum(w), 6) as value from w, lim where x between ax and bx and y between ay and by_ group by x, y",
)
def regrid_bilinear(spark: SparkSession, d: str) -> DataFrame:
    return out(regrid.regrid(grid(spark, d), target(spark), "bilinear", allow_empty=True), "x", "y", "value")


@query("regrid_nearest", f"with {GRID}, r as (select t.x, t.y, g.value, row_number() over (partition by t.x, t.y order by abs(t.x - g.x), g.x desc, abs(t.y - g.y), g.y desc) as n from t, g) select cast(x as double) as x, cast(y as double) as y, round(value, 6) as value from r where n = 1")
def regrid_nearest(spark: SparkSession, d: str) -> DataFrame:
    return out(regrid.regrid(grid(spark, d), target(spark), "nearest"), "x", "y", "value")


@query("regrid_chunks", f"with {GRID}, w as (select t.x as dx, t.y as dy, g.x as sx, g.y as sy, (least(ub_x, t.x + 1.25) - greatest(lb_x, t.x - 1.25)) * (degrees(sin(radians(least(ub_y, t.y + 1.25)))) - degrees(sin(radians(greatest(lb_y, t.y - 1.25))))) as w from t join g on lb_x < t.x + 1.25 and ub_x > t.x - 1.25 and lb_y < t.y + 1.25 and ub_y > t.y - 1.25) select cast(floor(dx / 5) as bigint) as tile_x, cast(floor(dy / 5) as bigint) as tile_y, count(*) as n, round(sum(w), 6) as w from w group by all")
def regrid_chunks(spark: SparkSession, d: str) -> DataFrame:
    table = regrid.chunked_weights(grid(spark, d), target(spark), 5.0)
    return rounded(table.groupBy("tile_x", "tile_y").agg(F.count("*").alias("n"), F.sum("w").alias("w")), "w")


@query("regrid_insert", f"with {GRID} select x, y, round(case when x < -100 then value + 1000 else value end, 6) as value from g")
def regrid_insert(spark: SparkSession, d: str) -> DataFrame:
    f = grid(spark, d)
    return out(regrid.insert(f, f.where("x < -100").transform(lambda df: df.withColumn("value", F.col("value") + 1000))), "x", "y", "value")


# Meshes: cells as elements, their corners as nodes.
@query("mesh_nodes", f"with {BOX_EVENTS}, c as (select distinct x, y, lb_x, ub_x, lb_y, ub_y from b), p as (select lb_x as x, lb_y as y from c union select lb_x, ub_y from c union select ub_x, lb_y from c union select ub_x, ub_y from c) select x, y, cast(row_number() over (order by x, y) - 1 as int) as node from p")
def mesh_nodes(spark: SparkSession, d: str) -> DataFrame:
    return mesh_tables(spark, d)[0].select("x", "y", "node")


def mesh_tables(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    from isobar.sources import mesh

    f = events(spark, d, True)
    cells = f.df.select("x", "y", "lb_x", "ub_x", "lb_y", "ub_y").distinct()
    return mesh.connectivity(cells.select(F.concat_ws("_", "x", "y").alias("element"), spatial.corners(f).alias("ring")))


@query("mesh_elements", f"with {BOX_EVENTS} select distinct concat(cast(x as varchar), '_', cast(y as varchar)) as element, cast(4 as int) as corners, 1.0::double as area from b")
def mesh_elements(spark: SparkSession, d: str) -> DataFrame:
    from isobar.sources import mesh

    made = mesh.elements(*mesh_tables(spark, d))
    return made.select("element", F.size("ring").alias("corners"), F.round(spatial.ring_area(F.col("ring")), 6).alias("area"))


# Streams: the same aggregates over an unbounded source.
@query("stream_daily", f"with {EVENTS} select cast(date_trunc('day', time) as timestamp) as lb_time, rlz, round(avg(value), 6) as mean, max(value) as max, count(*) as n from e group by date_trunc('day', time), rlz")
def stream_daily(spark: SparkSession, d: str) -> DataFrame:
    from isobar.streaming.windows import folder, run_to_table, windowed

    path = f"{d}/events.parquet"
    source = spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{d}/{{events.parquet}}")  # a pattern, as a stream reads no lone file
    f = Field.of(source.selectExpr("ts as time", "event_type as rlz", "value", "value * 0 + 1 as one"), ("value", "one"))
    made = run_to_table(windowed(f, ["mean", "max", "sum"]), folder(spark, "stream-daily"), folder(spark, "stream-state"), "complete")
    return rounded(made.select(F.col("lb_time").cast("timestamp_ntz").alias("lb_time"), "rlz", F.col("mean_value").alias("mean"), F.col("max_value").alias("max"), F.col("sum_one").cast("long").alias("n")), "mean")

