"""Mixing sources to target weights by systematic sampling [operator 8].

Method: each document of a source is expected target / size of the source times. The prefix sum of these expected
copies, plus one random offset for the source, crosses integers; a document is emitted once per integer crossed.
Within a source documents stand by size class, then in an order that md5 of the id makes random: so the sizes taken
are spread evenly and the taken words come near the target. Reruns agree.

The prefix sum is dealt out in cells (source, size class, leading hex digits of md5) whose rows are counted first;
more digits are used as the input grows, so that no source, however large, meets in one task. The digits don't change
the order, and so not the result.

Sources are numbered, and their shares found, by sums over ranges of the ordered sources, so they may be many.

Null text has size 0 and is taken at its source's rate with 0 words. Null source is a source of its own, the last.
Rows with one id tie and may swap places, which doesn't show. Null ids are kept, in an order by their texts. An empty table gives no rows. Columns
made on the way begin with two underscores; other columns of any name go through mix() unchanged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from isobar.llm.base import table, written

WEIGHTS = (5, 2, 1)
CAP = 3
#: Rows that share a cell at most, about.
CELL_ROWS = 500_000
SEED = "isobar"


def words(text: Column) -> Column:
    """Number of words, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long"), F.lit(0))


def running(rows: DataFrame, order: list[str], sums: list[str]) -> DataFrame:
    """rows with __k, their number in an order that has no ties, and for each column of sums the sum __before_ it.

    Rows are dealt out in ranges of the order; what meets in one task is a row for each range.
    """
    dealt = written(rows.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()), "ranges")
    totals = dealt.groupBy("__range").agg(F.count("*").alias("__n"), *(F.sum(c).alias(f"__sum_{c}") for c in sums))
    over = "over (order by __range rows between unbounded preceding and 1 preceding)"
    firsts = totals.select("__range", *(F.expr(f"coalesce(sum({a}) {over}, 0)").alias(b) for a, b in [("__n", "__first"), *((f"__sum_{c}", f"__first_{c}") for c in sums)]))
    within = f"over (partition by __range order by {', '.join(order)} rows between unbounded preceding and current row)"
    found = dealt.join(F.broadcast(firsts), "__range").withColumn("__k", F.expr(f"row_number() over (partition by __range order by {', '.join(order)}) + __first"))
    for c in sums:
        found = found.withColumn(f"__before_{c}", F.expr(f"sum({c}) {within} - {c} + __first_{c}"))
    return found.drop("__range", "__first", *(f"__first_{c}" for c in sums))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """(source, source_size, target) from (source, size) rows: shares by weight, none above cap times its source.

    Sources by cap / weight are full one after the other; the first that has room sets the share of those left.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("none", F.col("source").isNull())
    numbered = running(totals, ["none", "source"], [])
    turn = F.pmod(F.col("__k") - 1, F.lit(len(weights)))
    weight = F.element_at(F.array(*map(F.lit, weights)), turn.cast("int") + 1)
    weighed = written(numbered.select("none", "source", "source_size", weight.cast("long").alias("w"), (cap * F.col("source_size")).alias("most")), "sources")
    whole, all_weights = weighed.agg(F.sum("source_size"), F.sum("w")).first()
    ratio = F.col("most").cast("double") / F.col("w")
    levels = running(weighed.withColumn("ratio", ratio), ["ratio", "none", "source"], ["most", "w"])
    level = (F.lit(whole) - F.col("__before_most")).cast("double") / (F.lit(all_weights) - F.col("__before_w")).cast("double")
    levels = levels.withColumn("level", level)
    share = levels.where(F.col("most").cast("double") >= F.col("level") * F.col("w")).agg(F.min_by("level", "__k")).first()[0]
    return weighed.select("source", "source_size", F.least(F.col("most").cast("double"), F.lit(share).cast("double") * F.col("w")).alias("target"))


def offset(source: Column) -> Column:
    """The random offset of a source, from 0 to below 1."""
    code = F.md5(F.concat(F.lit(SEED), F.coalesce(F.concat(F.lit(":"), source), F.lit(""))).cast("binary"))
    return F.conv(F.substring(code, 1, 12), 16, 10).cast("double") / F.lit(float(1 << 48))


def order(id_col: str, text_col: str) -> Column:
    """A random place: of a row's id, or of its text if it has none."""
    text = F.concat(F.lit("null"), F.md5(F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")))
    return F.md5(F.coalesce(F.col(id_col).cast("string"), text).cast("binary"))


def counted(df: DataFrame, sizes: DataFrame, id_col: str = "doc_id", source_col: str = "source", size: Column | None = None, place: Column | None = None) -> DataFrame:
    """df with __size, __source_size, __target and __copies of each row. sizes: slim() of the same rows; place: their order()."""
    rows = sizes.count()
    digits = 0
    while rows > CELL_ROWS * 16**digits:
        digits += 1
    cell = lambda place, n: F.concat(F.lpad(F.length(F.bin(n)).cast("string"), 2, "0"), F.rpad(F.substring(F.bin(n), 1, 3), 3, "0"), F.substring(place, 1, digits))
    key = lambda name: F.coalesce(F.concat(F.lit(":"), F.col(name)), F.lit(""))
    cells = sizes.groupBy(key("source").alias("__key"), cell(F.col("place"), F.col("size")).alias("__cell")).agg(F.count("*").alias("__rows"))
    cells = cells.withColumn("__before", F.expr("sum(__rows) over (partition by __key order by __cell) - __rows")).drop("__rows")
    goals = targets(sizes.select("source", "size")).select(key("source").alias("__key"), F.col("source_size").alias("__source_size"), F.col("target").alias("__target"), offset(F.col("source")).alias("__offset"))
    facts = cells.join(goals, "__key")
    out = df.withColumn("__size", size if size is not None else words(F.col("text")))
    out = out.withColumn("__key", key(source_col)).withColumn("__order", F.col("place") if place is None else place).withColumn("__cell", cell(F.col("__order"), F.col("__size")))
    out = out.join(facts, ["__key", "__cell"])
    out = out.withColumn("__rank", F.expr(f"row_number() over (partition by __key, __cell order by __order, `{id_col}`) + __before"))
    rate = F.when(F.col("__source_size") > 0, F.col("__target") / F.col("__source_size").cast("double")).otherwise(0.0)
    copies = F.floor(rate * F.col("__rank") + F.col("__offset")) - F.floor(rate * (F.col("__rank") - 1) + F.col("__offset"))
    return out.withColumn("__copies", copies).drop("__key", "__cell", "__order", "__before", "__offset", "__rank")


def slim(df: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """(id, source, size, place), written once: texts are split into words in one pass."""
    return written(df.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), words(F.col(text_col)).alias("size"), order(id_col, text_col).alias("place")), "sizes")


def mix(df: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """The mix: each row of df as often as it is taken, with df's columns."""
    found = counted(df, slim(df, id_col, source_col, text_col), id_col, source_col, words(F.col(text_col)), order(id_col, text_col))
    return found.withColumn("__copy", F.explode(F.expr("sequence(1, if(__copies > 0, __copies, 1))"))).where("__copies > 0").select(*(f"`{c}`" for c in df.columns))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = slim(table(spark, sf_dir, "documents"))
    found = counted(sizes, sizes, "id", "source", F.col("size"))
    return found.select(F.col("id").alias("doc_id"), F.col("__size").alias("size"), F.col("__source_size").alias("source_size"), F.col("__target").alias("target"), (F.col("__copies") * F.col("__size")).alias("taken"))


OP8_SQL = f"""
with sized as (select doc_id, source, coalesce(cast(doc_id as varchar), 'null' || md5(coalesce(text, ''))) as name, cast(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) as bigint) as size from documents),
totals as (select source, cast(sum(size) as bigint) as source_size from sized group by source),
weighed as (select *, case (row_number() over (order by source is null, source) - 1) % 3 when 0 then 5 when 1 then 2 else 1 end as w from totals),
levels as (
    select w, source_size,
        cast(sum(source_size) over () - coalesce(sum(3 * source_size) over (o rows between unbounded preceding and 1 preceding), 0) as double)
            / cast(sum(w) over (o rows between current row and unbounded following) as double) as level,
        row_number() over o as k
    from weighed window o as (order by cast(3 * source_size as double) / w, source is null, source)
),
share as (select min_by(level, k) as level from levels where cast(3 * source_size as double) >= level * w),
goals as (
    select source, source_size, least(cast(3 * source_size as double), level * w) as target,
        cast(cast('0x' || substr(md5('{SEED}' || coalesce(':' || source, '')), 1, 12) as bigint) as double) / 281474976710656.0 as u
    from weighed cross join share
),
ranked as (
    select s.doc_id, s.size, g.source_size, g.target, g.u,
        case when g.source_size > 0 then g.target / cast(g.source_size as double) else 0.0 end as rate,
        row_number() over (partition by s.source order by length(bin(s.size)), rpad(substr(bin(s.size), 1, 3), 3, '0'), md5(s.name), s.doc_id) as k
    from sized s join goals g on s.source is not distinct from g.source
)
select doc_id, size, source_size, target, cast((floor(rate * k + u) - floor(rate * (k - 1) + u)) * size as bigint) as taken from ranked
"""
