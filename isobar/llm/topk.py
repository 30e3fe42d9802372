"""Exact top-k search [operator 10].

Method: block-at-a-time pruning. Components are terms, integer components weights. Candidates stand in blocks; for a
query each block has a bound, the sum over terms of the query's weight times the block's greatest (or, for negative
weights, least) weight. Blocks are scored through their forward index, the block's weights row by row, in order of
their bounds, until the next bound falls below the k-th score so far.

Candidates are ordered by whether their most varied components lie above the mean, so that blocks hold vectors alike.
Queries stand in groups of bounded size, in the same order. Groups first meet the blocks' extremes alone, in chunks: each
query's most promising block of a chunk is scored, whose k-th score is a floor of the final one. Only blocks whose bound
reaches the floor of a query of the group are sent to it, in slices of bounded size; a task searches a group in a slice, and
the few rows that it keeps are merged by query. So what is shuffled is what can matter, and nothing is collected or broadcast.

Vectors that are null or hold null or non-finite components take no part, as query or as candidate. Shorter vectors
count as padded with zeros. Weights and scores beyond the range of long saturate. Rows that share a query's vec_id are
its own. A null vec_id is no query; as a candidate it comes last among ties. Repeated query rows count once.
With fewer than k candidates all are returned; an empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from isobar.llm.base import bounded_batches, table, written
from isobar.llm.mixing import running

SCALE = 1024
QUERIES, SLICE_ROWS, BLOCK = 512, 8192, 256
#: Blocks whose extremes one task sees; components that order candidates.
CHUNK, CODED = 4096, 12
LEAST, MOST = -(1 << 63), (1 << 63) - 1


def usable(vector: Column) -> Column:
    return vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(float("inf"))))


def weights(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """A row of whole numbers, as doubles, for each vector."""
    array = column.combine_chunks()
    values = np.clip(np.floor(SCALE * array.flatten().to_numpy(zero_copy_only=False).astype(np.float64)), float(LEAST), float(1 << 63))
    lengths = np.diff(array.offsets.to_numpy()) if len(array) else np.zeros(0, int)
    if (lengths == width).all():
        return values.reshape(-1, width)
    out = np.zeros((len(array), width))
    out[np.arange(width) < lengths[:, None]] = values
    return out


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to the smaller id, best first."""
    if len(scores) > k:
        kth = np.partition(scores, len(scores) - k)[len(scores) - k]
        near = np.flatnonzero(scores >= kth)
    else:
        near = np.arange(len(scores))
    return near[np.lexsort((ids[near], -scores[near]))][:k]


def bounds_of(queries: np.ndarray, high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """For each query and block no less than the query's score with any row of the block."""
    return np.maximum(queries, 0) @ high.T + np.minimum(queries, 0) @ low.T


def search_slice(queries: np.ndarray, query_ids: np.ndarray, rows: np.ndarray, ids: np.ndarray, k: int, block: int = BLOCK, floors: np.ndarray | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each query the places and scores of its k best rows among those with other ids. ids: null as the largest long.

    Rows that score below a query's floor may be left out.
    """
    spread = rows.var(0)
    order = np.lexsort([rows[:, j] > np.median(rows[:, j]) for j in np.argsort(spread)[-8:]]) if len(rows) > block else np.arange(len(rows))
    rows, ids = rows[order], ids[order]
    starts = np.arange(0, len(rows), block)
    high, low = np.maximum.reduceat(rows, starts), np.minimum.reduceat(rows, starts)
    bounds = bounds_of(queries, high, low)
    floors = np.full(len(queries), -np.inf) if floors is None else floors
    turns = np.argsort(-bounds, axis=1, kind="stable")
    found = [(np.zeros(0, np.int64), np.zeros(0)) for _ in queries]
    live = np.arange(len(queries))
    for turn in range(len(starts)):
        going = [q for q in live if bounds[q, turns[q, turn]] >= (max(floors[q], found[q][1][-1]) if len(found[q][1]) >= k else floors[q])]
        if not going:
            break
        live = np.array(going)
        at = turns[live, turn]
        for b in np.unique(at):
            some, begin = live[at == b], starts[b]
            scores = queries[some] @ rows[begin : begin + block].T
            for q, s in zip(some, scores, strict=True):
                places, kept = found[q]
                own = np.flatnonzero((ids[begin : begin + block] != query_ids[q]) & (s >= kept[-1] if len(kept) == k else True))
                if len(own):
                    places, kept = np.concatenate([places, own + begin]), np.concatenate([kept, s[own]])
                    top = best(kept, ids[places], k)
                    found[q] = (places[top], kept[top])
    return [(order[p], s) for p, s in found]


def search_exactly(queries: np.ndarray, query_ids: np.ndarray, rows: np.ndarray, ids: np.ndarray, k: int) -> list[tuple[np.ndarray, list[int]]]:
    """As search_slice, in whole numbers of any size, without bounds: for vectors whose scores doubles can't hold."""
    whole = lambda m: [[min(int(x), MOST) for x in r] for r in m]
    candidates, out = whole(rows), []
    for q, own in zip(whole(queries), query_ids, strict=True):
        scored = sorted((-max(LEAST, min(MOST, sum(a * b for a, b in zip(q, c, strict=True)))), i, p) for p, (c, i) in enumerate(zip(candidates, ids.tolist(), strict=True)) if i != own)[:k]
        out.append((np.array([p for _, _, p in scored], np.int64), [-s for s, _, _ in scored]))
    return out


def code_of(rows: DataFrame) -> Column:
    """A number by which vectors alike stand near each other: which of the CODED most varied components lie above their mean."""
    parts = rows.select(F.posexplode("vector").alias("at", "x")).groupBy("at").agg(F.avg("x").alias("mean"), F.var_pop("x").alias("spread"))
    most = parts.orderBy(F.desc("spread"), "at").limit(CODED).collect()
    above = lambda r: F.when(F.get("vector", F.lit(r["at"])) > F.lit(r["mean"]), 1).otherwise(0)
    return sum((above(r) * (1 << k) for k, r in enumerate(reversed(most))), F.lit(0)).cast("long")


BLOCKS = "block long, n int, most double, high array<double>, low array<double>, ids array<long>, raw binary"


def blocked(rows: DataFrame, code: Column) -> DataFrame:
    """Blocks of candidates (vec_id, vector): their extremes, and their forward index, the weights row by row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, made = TaskContext.get().partitionId() << 32, 0
        kept: list[pa.RecordBatch] = []

        def block(part: pa.Table) -> pa.RecordBatch:
            w = weights(part.column("vector"), widest(part.column("vector")))
            row = {"block": first + made, "n": len(w), "most": float(np.abs(w).max(initial=0)), "high": w.max(0).tolist(), "low": w.min(0).tolist(), "ids": part.column("vec_id").to_pylist(), "raw": w.tobytes()}
            return pa.RecordBatch.from_pylist([row], schema)

        schema = pa.schema([("block", pa.int64()), ("n", pa.int32()), ("most", pa.float64()), ("high", pa.list_(pa.float64())), ("low", pa.list_(pa.float64())), ("ids", pa.list_(pa.int64())), ("raw", pa.binary())])
        for batch in batches:
            kept.append(batch)
            while sum(x.num_rows for x in kept) >= BLOCK:
                whole = pa.Table.from_batches(kept)
                yield block(whole.slice(0, BLOCK))
                made += 1
                kept = whole.slice(BLOCK).to_batches()
        if sum(x.num_rows for x in kept):
            yield block(pa.Table.from_batches(kept))

    ordered = rows.withColumn("code", code).withColumn("order", F.xxhash64("vec_id", "vector"))
    ordered = ordered.repartitionByRange("code", "order").sortWithinPartitions("code", "order")
    return ordered.select("vec_id", "vector").mapInArrow(run, BLOCKS)


def padded(lists: list[list[float]], width: int) -> np.ndarray:
    out = np.zeros((len(lists), width))
    for k, x in enumerate(lists):
        out[k, : len(x)] = x
    return out


def widest(*columns: pa.ChunkedArray) -> int:
    return max((int(np.diff(c.combine_chunks().offsets.to_numpy()).max(initial=0)) for c in columns), default=0)


def whole_numbers(queries: np.ndarray, most: np.ndarray) -> np.ndarray:
    """For each query and block whether doubles hold all their scores exactly."""
    return np.abs(queries).max(1, initial=0)[:, None] * most * max(1, queries.shape[1]) < 2**53


def meeting(left: pa.Table, right: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(weights of queries, their bounds in blocks, which are exact) of a group and the extremes of a chunk of blocks."""
    width = widest(left.column("vector"), right.column("high"))
    q = weights(left.column("vector"), width)
    bounds = bounds_of(q, padded(right.column("high").to_pylist(), width), padded(right.column("low").to_pylist(), width))
    return q, bounds, whole_numbers(q, right.column("most").to_numpy())


def candidates(blocks: pa.Table, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(weights, ids) of all rows of blocks; ids: null as the largest long."""
    rows = [np.frombuffer(raw.as_py()).reshape(n, -1) if n else np.zeros((0, width)) for raw, n in zip(blocks.column("raw"), blocks.column("n").to_pylist(), strict=True)]
    wide = [x if x.shape[1] == width else np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in rows]
    return np.concatenate(wide), pa.concat_arrays([x.values for x in blocks.column("ids")]).fill_null(MOST).to_numpy()


def apart(df: DataFrame, *names: str) -> DataFrame:
    """Columns of df as columns of their own, for the other side of a cogroup."""
    return df.select(*(F.col(c).alias(c) for c in names))


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k best rows of vectors for each row of queries."""
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("vector")).where(usable(F.col("vector")))
    asked = queries.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("vector")).where(usable(F.col("vector")) & F.col("vec_id").isNotNull()).distinct()
    code = code_of(rows)
    blocks = written(blocked(rows, code), "blocks")
    numbered = running(asked.withColumn("code", code).withColumn("query", F.xxhash64("vec_id", "vector")), ["code", "query", "vec_id"], [])
    asked = written(numbered.select("query", "vec_id", "vector", F.floor((F.col("__k") - 1) / QUERIES).alias("group")), "queries")
    groups = max(1, -(-asked.count() // QUERIES))
    count, total = blocks.agg(F.count("*"), F.sum("n")).first()
    chunks, slices_ = max(1, -(-count // CHUNK)), max(1, -(-(total or 0) // SLICE_ROWS))
    heads = blocks.select("block", "n", "most", "high", "low", F.pmod(F.xxhash64("block"), F.lit(chunks)).cast("int").alias("chunk"))
    heads = heads.withColumn("group", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))))
    each = lambda df: df.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1)))).groupBy("group", "chunk")

    def promising(left: pa.Table, right: pa.Table) -> pa.Table:
        """Each query's block of the greatest bound."""
        at = np.empty(0, np.int64)
        if left.num_rows and right.num_rows:
            at = meeting(left, right)[1].argmax(1)
        mine = left if len(at) else left.slice(0, 0)
        return pa.table({"group": mine.column("group"), "block": right.column("block").take(pa.array(at)), "query": mine.column("query"), "vec_id": mine.column("vec_id"), "vector": mine.column("vector")})

    kind = asked.schema["vector"].dataType.simpleString()
    first = written(each(asked).cogroup(heads.groupBy("group", "chunk")).applyInArrow(promising, f"group long, block long, query long, vec_id long, vector {kind}"), "promising")

    def floor(left: pa.Table, right: pa.Table) -> pa.Table:
        """The k-th score of each query in a block, where that is exact."""
        out = np.full(left.num_rows, -np.inf)
        if left.num_rows and right.num_rows:
            width = widest(left.column("vector"), right.column("high"))
            q, (c, ids) = weights(left.column("vector"), width), candidates(right, width)
            scores = q @ c.T
            scores[left.column("vec_id").to_numpy()[:, None] == ids] = -np.inf
            if len(ids) >= k:
                kth = np.partition(scores, len(ids) - k, axis=1)[:, len(ids) - k]
                out = np.where(whole_numbers(q, right.column("most").to_numpy()).all(1), kth, -np.inf)
        return pa.table({"query": left.column("query"), "vec_id": left.column("vec_id"), "floor": pa.array(out)})

    seeded = blocks.join(apart(first, "block", "group").distinct(), "block")
    floors = first.groupBy("block", "group").cogroup(seeded.groupBy("block", "group")).applyInArrow(floor, "query long, vec_id long, floor double")
    asked = written(asked.join(floors.groupBy("query", "vec_id").agg(F.max("floor").alias("floor")), ["query", "vec_id"], "left").withColumn("floor", F.coalesce("floor", F.lit(float("-inf")))), "floors")

    def surviving(left: pa.Table, right: pa.Table) -> pa.Table:
        """Blocks that any query of a group may need."""
        kept = np.zeros(right.num_rows, bool)
        if left.num_rows and right.num_rows:
            _, bounds, exact = meeting(left, right)
            kept = ((bounds >= left.column("floor").to_numpy()[:, None]) | ~exact).any(0)
        left_ = right.filter(pa.array(kept))
        return pa.table({"group": left_.column("group"), "block": left_.column("block")})

    pairs = each(asked).cogroup(heads.groupBy("group", "chunk")).applyInArrow(surviving, "group long, block long")
    pairs = written(pairs.withColumn("slice", F.pmod(F.xxhash64("block"), F.lit(slices_)).cast("int")), "survivors")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        empty = pa.table({"query": pa.array([], pa.int64()), "query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.int64())})
        if not left.num_rows or not right.num_rows:
            return empty
        width = widest(left.column("vector"), right.column("high"))
        q, (c, ids) = weights(left.column("vector"), width), candidates(right, width)
        query_ids = left.column("vec_id").to_numpy()
        exact = width > 0 and whole_numbers(q, right.column("most").to_numpy()).all()
        found = search_slice(q, query_ids, c, ids, k, floors=left.column("floor").to_numpy()) if exact else search_exactly(q, query_ids, c, ids, k)
        places = np.concatenate([p for p, _ in found]).astype(np.int64)
        at = np.repeat(np.arange(len(found)), [len(p) for p, _ in found])
        scores = pa.array([int(x) for _, s in found for x in s], pa.int64())
        known = pa.concat_arrays([x.values for x in right.column("ids")])
        return pa.table({"query": left.column("query").take(at), "query_id": left.column("vec_id").take(at), "vec_id": known.take(pa.array(places)), "score": scores})

    sent = blocks.join(pairs, "block")
    there = asked.join(apart(pairs, "group", "slice").distinct(), "group")
    found = there.groupBy("group", "slice").cogroup(sent.groupBy("group", "slice")).applyInArrow(run, "query long, query_id long, vec_id long, score long")
    ranked = found.withColumn("rank", F.expr("row_number() over (partition by query, query_id order by score desc, vec_id asc nulls last)"))
    return ranked.where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op10_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounded_batches(spark, 2000)
    rows = table(spark, sf_dir, "embeddings")
    return top_k(rows, rows.where(F.col("vec_id") % 100 == 0))


OP10_SQL = """
with v as (
    select vec_id, list_transform(embedding, lambda x: floor(1024 * cast(x as double))) as w from embeddings
    where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
),
s as (
    select q.vec_id as query_id, c.vec_id, cast(list_dot_product(q.w, c.w) as bigint) as score
    from v q join v c on q.vec_id % 100 = 0 and c.vec_id is distinct from q.vec_id
),
r as (select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id asc nulls last) as integer) as rank, vec_id, score from s)
select query_id, rank, vec_id, score from r where rank <= 10
"""
