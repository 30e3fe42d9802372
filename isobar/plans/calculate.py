"""Calculations over a field: those that can share one aggregation do; windows and runs sort once per cell."""

from __future__ import annotations

import re
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from isobar.errors import DefinitionError, UnitsError
from isobar.functions import expression, library
from isobar.functions import units as U
from isobar.model import Field
from isobar.operators.grouping import Grouping, keyed, stamped, summary


def parse_calc(calc: Any) -> list[dict]:
    """Definitions as dicts of func, name and kwds, from dicts, texts of the form key~name!parameter~value, or expressions."""
    out = []
    for x in calc if isinstance(calc, list | tuple) else [calc]:
        if isinstance(x, str) and "=" in x and "~" not in x:
            out.append({"func": None, "name": x.split("=")[0].strip(), "kwds": {}, "expression": x})
        elif isinstance(x, str):
            head, *kwds = x.split("!")
            func, _, name = head.partition("~")
            out.append({"func": func, "name": name or func, "kwds": dict(k.split("~", 1) for k in kwds)})
        else:
            out.append({"func": x["func"], "name": x.get("name") or x["func"], "kwds": dict(x.get("kwds") or {}), **({"meta_attrs": x["meta_attrs"]} if "meta_attrs" in x else {})})
    names = [x["name"] for x in out]
    if len(set(names)) != len(names):
        raise DefinitionError(f"calc: names repeat: {names}")
    return out


def named(name: str, variable: str, f: Field) -> str:
    return f"{name}_{variable}" if len(f.variables) > 1 else name


def group_keys(f: Field, grouping: Grouping) -> list[str]:
    return [*f.keys, *grouping.names]


def runs(f: Field, grouping: Grouping, test: Column) -> DataFrame:
    """(group's keys, length) of each run of consecutive steps of a cell and group in which the test holds."""
    keys = group_keys(f, grouping)
    w = W.partitionBy(*keys).orderBy(f.axis("time"))
    marked = keyed(f.df, f.axis("time"), grouping).withColumn("__hit", F.coalesce(test, F.lit(False)))
    marked = marked.withColumn("__run", F.sum(F.when(F.col("__hit"), 0).otherwise(1)).over(w.rowsBetween(W.unboundedPreceding, 0)))
    return marked.where("__hit").groupBy(*keys, "__run").agg(F.count("*").alias("length")).drop("__run")


def joined(base: DataFrame, more: DataFrame, keys: list[str]) -> DataFrame:
    """Two results of the same groups, with nulls among keys equal."""
    renamed = more.withColumnsRenamed({k: f"__{k}" for k in keys})
    test = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    return base.join(renamed, test, "left").drop(*[f"__{k}" for k in keys])


def shares(percentile: float | list[float]) -> Column:
    return F.array(*(F.lit(p / 100) for p in percentile)) if isinstance(percentile, list) else F.lit(percentile / 100)


def daily_percentile(f: Field, v: str, percentile: float | list[float], window_width: int, only_leap_years: bool = False) -> DataFrame:
    """(keys, month, day, value): the percentile of each calendar day over all years within half a window; of several an array.

    Each value goes out to the window_width calendar days that it counts for: as many rows per value, no join of days. 29
    February stands at 28 February, one day later at its end; with only_leap_years it counts from leap years alone.
    """
    h, t = window_width // 2, f.axis("time")
    day = F.explode(F.sequence(F.date_sub(t.cast("date"), h), F.date_add(t.cast("date"), h)))
    there = f.df.select(F.month(t).alias("__m"), F.dayofmonth(t).alias("__d")).distinct()
    rows = f.df.where(F.col(v).isNotNull()).withColumn("__day", day).withColumn("month", F.month("__day")).withColumn("day", F.dayofmonth("__day"))
    rows = rows.join(F.broadcast(there), (F.col("month") == F.col("__m")) & (F.col("day") == F.col("__d")), "left_semi")  # 366 rows at most
    keys = [*f.keys, "month", "day"]
    out = rows
    if not only_leap_years:
        end = F.make_date(F.year(t), F.lit(2), F.lit(28))
        near = f.df.where(F.col(v).isNotNull()).withColumn("__day", t.cast("date")).where((F.col("__day") >= F.date_sub(end, h - 1)) & (F.col("__day") <= F.date_add(end, h)))
        near = near.withColumn("month", F.lit(2)).withColumn("day", F.lit(29)).join(F.broadcast(there), (F.col("month") == F.col("__m")) & (F.col("day") == F.col("__d")), "left_semi")
        out = rows.where(~((F.col("month") == 2) & (F.col("day") == 29))).unionByName(near)
    return out.groupBy(*keys).agg(F.percentile(v, shares(percentile)).alias("value"))


def thaws(series: Column, threshold: float) -> Column:
    """Times that a series of degrees above freezing, an array in order of time, changes between frozen and thawed ground.

    Degree-days are summed from every change of sign on, and from the start. A sum is done when it first reaches the threshold,
    above or below; its sign is then the ground's state, if the sums begun before it are done and it began after the last change.
    The first state is no change, so a series that reaches none has -1. One pass keeps the sums that wait, oldest first.
    """
    waits = lambda begun: F.struct(begun.alias("begun"), F.lit(0.0).alias("sum"), F.lit(0).alias("done"), F.lit(0).alias("sign"))

    def settled(state: Column, last: bool) -> Column:
        """The state after the sums that are done; at the last, those that aren't done never will be."""

        def one(s: Column, x: Column) -> Column:
            change = (x.done > 0) & (x.sign != s.side) & (x.begun >= s.since)
            waiting = F.lit(False) if last else (F.size(s.open) > 0) | ((x.done == 0) & (x.begun >= s.since))
            now = lambda name, value: F.when(~waiting & change, value).otherwise(s[name]).alias(name)
            return F.struct(s.n.alias("n"), s.above.alias("above"), now("side", x.sign), now("since", x.done), now("changes", s.changes + 1), F.when(waiting, F.concat(s.open, F.array(x))).otherwise(s.open).alias("open"))

        none = F.filter(state.open, lambda _: F.lit(False)).alias("open")
        start = F.struct(*(state[x].alias(x) for x in ("n", "above", "side", "since", "changes")), none)
        return F.aggregate(state.open, start, one)

    def step(s: Column, v: Column) -> Column:
        begun = F.when((v >= 0) != s.above, F.concat(s.open, F.array(waits(s.n)))).otherwise(s.open)

        def moved(x: Column) -> Column:
            total = x["sum"] + v
            there = F.abs(total) >= threshold
            grown = F.struct(x.begun.alias("begun"), total.alias("sum"), F.when(there, s.n + 1).otherwise(0).alias("done"), F.when(there, F.signum(total).cast("int")).otherwise(0).alias("sign"))
            return F.when(x.done > 0, x).otherwise(grown)

        state = F.struct((s.n + 1).alias("n"), (v >= 0).alias("above"), s.side.alias("side"), s.since.alias("since"), s.changes.alias("changes"), F.transform(begun, moved).alias("open"))
        return settled(state, False)

    first = F.struct(F.lit(0).alias("n"), F.lit(True).alias("above"), F.lit(0).alias("side"), F.lit(0).alias("since"), F.lit(-1).alias("changes"), F.array(waits(F.lit(0))).alias("open"))
    return F.aggregate(series, first, step, lambda s: settled(s, True).changes.cast("double"))


def freezethaw(f: Field, v: str, grouping: Grouping, threshold: float = 15.0) -> DataFrame:
    """(group's keys, value): a fold over each cell's series in a group."""
    keys = group_keys(f, grouping)
    units = f.units.get(v)
    if not U.convertible(units, "K"):
        raise UnitsError("freezethaw: temperatures have to be in K or C")
    t = f.dims.column("time")
    rows = keyed(f.df, f.axis("time"), grouping).select(*keys, F.col(t).alias("__time"), U.convert(F.col(v).cast("double"), units, "C").alias("__value"))
    series = rows.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.when(F.col("__value").isNotNull(), F.struct("__time", "__value")))), lambda x: x["__value"]).alias("__series"))
    return series.select(*keys, F.when(F.size("__series") > 0, thaws(F.col("__series"), float(threshold))).alias("value"))


def near_basis(f: Field, v: str, percentile: float | list[float]) -> DataFrame:
    """A field's rows with __basis, the percentile of their calendar day and cell, or an array of several.

    It is rounded: a value that is the percentile, but for the last bits of its interpolation, isn't beyond it.
    """
    t = f.axis("time")
    own = F.transform("value", lambda x: F.round(x, 9)) if isinstance(percentile, list) else F.round("value", 9)
    basis = daily_percentile(f, v, percentile, 5).withColumnsRenamed({"month": "__month", "day": "__day"}).withColumn("__basis", own).drop("value")
    days = f.df.withColumns({"__month": F.month(t), "__day": F.dayofmonth(t)})
    return joined(days, basis, [*f.keys, "__month", "__day"]).drop("__month", "__day")


#: Indices of values beyond percentiles: TG10p to TN90p of the calendar day's, R75p to R99pTOT of wet days'.
BEYOND = re.compile(r"(?:T[GXN](?P<day>10|90)p|R(?P<wet>75|95|99)p(?:TOT)?)\Z")


def beyond(f: Field, v: str, named_keys: list[tuple[str, str]], grouping: Grouping) -> DataFrame:
    """(group's keys, a column for each name) of indices of one variable: their percentiles are made, and joined, together."""
    keys, made = group_keys(f, grouping), []
    days = [k for _, k in named_keys if BEYOND.match(k)["day"]]
    ranks = sorted({float(BEYOND.match(k)["day"] or BEYOND.match(k)["wet"]) for _, k in named_keys})
    if days:
        near = keyed(near_basis(f, v, ranks), f.axis("time"), grouping)
    else:
        basis = f.df.where(F.col(v) >= 1).groupBy(*f.keys).agg(F.percentile(v, shares(ranks)).alias("__basis"))
        near = joined(keyed(f.df, f.axis("time"), grouping), basis, f.keys)
    for name, key in named_keys:
        found = BEYOND.match(key)
        limit = F.col("__basis")[ranks.index(float(found["day"] or found["wet"]))]
        if found["day"]:
            value = F.count_if(F.col(v) > limit if found["day"] == "90" else F.col(v) < limit)
        else:
            wet = (F.col(v) >= 1) & (F.col(v) > limit)
            whole = F.nullif(F.sum(F.when(F.col(v) >= 1, F.col(v))), F.lit(0.0))
            value = 100 * F.coalesce(F.sum(F.when(wet, F.col(v))), F.lit(0.0)) / whole if key.endswith("TOT") else F.count_if(wet)
        made.append(value.alias(name))
    return near.groupBy(*keys).agg(*made)


def frame(f: Field, calc: dict, v: str, grouping: Grouping | None) -> DataFrame:
    """(group's keys, value) of calculations that are more than one aggregate."""
    key, params, t = calc["func"], calc["kwds"], f.axis("time")
    if key == "freezethaw":
        return freezethaw(f, v, grouping, **params)
    keys = group_keys(f, grouping)
    groups = keyed(f.df, t, grouping)
    w = W.partitionBy(*keys).orderBy(t)
    if key == "vDTR":
        spread = F.col(params["tasmax"]) - F.col(params["tasmin"])
        steps = groups.withColumn("__step", F.abs(spread - F.lag(spread).over(w)))
        return steps.groupBy(*keys).agg(F.avg("__step").alias("value"))
    if key == "RX5day":
        five = groups.withColumn("__five", F.when(F.count(F.lit(1)).over(w.rowsBetween(-4, 0)) == 5, F.sum(v).over(w.rowsBetween(-4, 0))))
        return five.groupBy(*keys).agg(F.max("__five").alias("value"))
    # WSDI and CSDI: days of spells of six and more beyond the calendar day's percentile
    high = key == "WSDI"
    limit = F.col("__basis")
    near = near_basis(f, v, 90.0 if high else 10.0).withColumn("__test", F.col(v) > limit if high else F.col(v) < limit)
    cells = f.with_df(near.drop("__basis"), variables=(*f.variables, "__test"))
    long = runs(cells, grouping, F.col("__test")).where("length >= 6").groupBy(*keys).agg(F.sum("length").alias("value"))
    return joined(groups.select(*keys).distinct(), long, keys).withColumn("value", F.coalesce("value", F.lit(0)))


def calculate(f: Field, calc: Any, grouping: Any = None, sample_size: bool = False) -> Field:
    """The field of the calculations' results, one row per cell and group, or per value without a grouping."""
    calcs, grouping = parse_calc(calc), Grouping.parse(grouping)
    for x in calcs:
        x["of"] = library.lookup(x["func"]) if x["func"] else None
        if x["of"]:
            x["kwds"] = x["of"].checked(x["kwds"])
            names = {k: x["kwds"][k] for k in x["of"].variables}
            lacking = [v for v in names.values() if v not in f.variables]
            if lacking:
                raise DefinitionError(f"{x['func']}: no variable {lacking}")
            x["of"].check_units(f, names)
    if grouping is None:
        return ungrouped(f, calcs)
    if any(x["of"] is None or x["of"].kind == "window" or x["func"] == "daily_perc" for x in calcs):
        raise DefinitionError("expressions and windows over time take no calc_grouping")
    keys = group_keys(f, grouping)
    aggregates, later, names, units = [], [], [], {}
    together: dict[tuple[str, bool], list[tuple[str, str]]] = {}
    for x in calcs:
        of, kwds = x["of"], x["kwds"]
        if of.kind in ("multi", "multiset"):
            column = of.build(**{k: F.col(v) for k, v in kwds.items()})
            aggregates.append((F.avg(column) if of.kind == "multi" else column).alias(x["name"]))
            names.append(x["name"])
            continue
        if of.variables:
            later.append((x["name"], frame(f, x, "", grouping)))
            names.append(x["name"])
            continue
        for v in f.variables:
            name = named(x["name"], v, f)
            names.append(name)
            units[name] = of.units if of.units is None or of.units else f.units.get(v)
            if of.kind == "set":
                aggregates.append(of.build(F.col(v), **kwds).alias(name))
            elif of.kind == "scalar":
                aggregates.append(F.avg(of.build(F.col(v), **kwds)).alias(name))
            elif of.kind == "runs":
                if x["func"] in ("duration", "freq_duration") and "year" not in grouping.names:
                    raise DefinitionError(f"{x['func']} needs year in calc_grouping")
                op, limit = library.RUN_TESTS.get(x["func"]) or (kwds["operation"], kwds["threshold"])
                found = runs(f, grouping, library.operation(op)(F.col(v), limit))
                if x["func"] == "freq_duration":
                    counts = found.groupBy(*keys, F.col("length").cast("int").alias("duration")).agg(F.count("*").cast("int").alias("count"))
                    found = counts.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("duration", "count"))).alias("value"))
                    found = joined(keyed(f.df, f.axis("time"), grouping).select(*keys).distinct(), found, keys)
                else:
                    every = joined(keyed(f.df, f.axis("time"), grouping).select(*keys).distinct(), found, keys)
                    found = every.groupBy(*keys).agg(of.build(F.col("length"), **{k: v for k, v in kwds.items() if k == "summary"}).alias("value"))
                later.append((name, found))
            elif found := BEYOND.match(x["func"]):
                together.setdefault((v, bool(found["day"])), []).append((name, x["func"]))
            else:
                later.append((name, frame(f, x, v, grouping)))
    if sample_size:
        aggregates += [F.count(v).alias(f"n_{v}") for v in f.variables]
        names += [f"n_{v}" for v in f.variables]
    out = stamped(keyed(f.df, f.axis("time"), grouping).groupBy(*keys).agg(*summary(f, grouping), *aggregates), grouping)
    for name, more in later:
        out = joined(out, more.withColumnRenamed("value", name), keys)
    for (v, _), wanted in together.items():
        out = joined(out, beyond(f, v, wanted, grouping), keys)
    axes = {**f.dims.axes, "time": "time"}
    dims = type(f.dims)(axes, {**f.dims.bounds, "time": ("lb_time", "ub_time")}, f.dims.crs)
    return Field(out, dims, tuple(names), units, f.attrs, f.name, f.did)


def ungrouped(f: Field, calcs: list[dict]) -> Field:
    made, units = {}, {}
    for x in calcs:
        if x["of"] is None:
            name, column = expression.parse(x["expression"], f.variables)
            made[name] = column
        elif x["func"] == "daily_perc":
            if len(calcs) > 1:
                raise DefinitionError("daily_perc stands alone")
            out = daily_percentile(f, f.variables[0], **x["kwds"]).withColumnRenamed("value", x["name"])
            return Field(out, f.dims, (x["name"],), {x["name"]: f.units.get(f.variables[0])}, f.attrs, f.name, f.did)
        elif x["of"].kind == "multi":
            made[x["name"]] = x["of"].build(**{k: F.col(v) for k, v in x["kwds"].items()})
        elif x["of"].kind in ("scalar", "window"):
            for v in f.variables:
                name = named(x["name"], v, f)
                made[name] = x["of"].build(F.col(v), **x["kwds"]) if x["of"].kind == "scalar" else x["of"].build(f, v, **x["kwds"])
                units[name] = f.units.get(v) if x["of"].units is not None else None
        elif x["of"].kind == "field":
            return x["of"].build(f, **x["kwds"])
        else:
            raise DefinitionError(f"{x['func']} needs calc_grouping")
    kept = [c for c in f.df.columns if c not in f.variables]
    return f.with_df(f.df.select(*kept, *(c.alias(n) for n, c in made.items())), variables=tuple(made), units=units)
