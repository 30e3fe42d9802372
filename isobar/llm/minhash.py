"""MinHash near-dedup [operator 1].

Method: fast similarity sketching. In round i each shingle is thrown into one of T bins and leaves there i plus a
random fraction, if that is the least so far; rounds go on until no bin is empty, and rounds T to 2T - 1 throw into bin
i - T, so every bin fills. Each coordinate of two sketches agrees with the probability of the sets' Jaccard similarity,
with concentration as for full independence. Bands of ROWS coordinates make buckets, and candidates are verified on
the full sets.

Equal sets are first collapsed by a 128-bit digest, so copies never pair. A set's name is the least (id, hash of the text)
that has it, so two texts of one id are two documents. Then three steps find every link:
1. In each bucket every member is paired with the bucket's centre: as many pairs as members, however hot the bucket.
2. Pairs are verified on full sets, dealt out by centre and chunk; links give components (large star, small star).
3. A bucket whose members lie in several components may hide more links. Members outside its largest component meet all
   its members on full sets, block by block (never a whole hot bucket in one task), where intersections are counted through
   an inverted index; only links that join components come out, fewer than members, whatever the group. Buckets with the
   same members count once.
Only texts of documents in shared buckets are shuffled: a bitmap of fixed size leaves out the others first.
At similarity 0.8 a pair misses all bands with probability (1 - 0.8^4)^32 < 1e-7.

Null, empty and blank texts have no shingles, link with nothing and are kept. Texts with fewer than k words have one
shingle. Rows with a null id link like others, as the largest id; they are reported with a null component and kept, and
first tells whether their group keeps another. Rows that repeat an id are documents of their own, unless their texts are
equal too. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from isobar.llm.base import bounded_batches, removed, screened, slices, table, written
from isobar.llm.components import components
from isobar.llm.shingles import mixed, shingle_set

T, ROWS = 128, 4
#: Similarity from which documents are linked, as a fraction.
OVER, UNDER = 80, 100
#: Members of a centre in one verification; members of a block of a bucket.
CHUNK, BLOCK, SALTS = 256, 512, 16
#: Hits of an inverted index that are in memory at once.
HITS = 1 << 20
#: A set that more than one in so many rows have is hot; there are at most as many of them, which are broadcast.
HOT_SETS = 1024
#: What stands for a null id in names of sets.
NO_ID = (1 << 63) - 1
LINK = "a_rep long, a_key long, b_rep long, b_key long"


def sketches(sets: list[np.ndarray]) -> np.ndarray:
    """A row of T coordinates for each set; sets without shingles get all ones."""
    out = np.full((len(sets), T), np.iinfo(np.uint64).max, np.uint64)
    flat, live = out.reshape(-1), [k for k, x in enumerate(sets) if len(x)]
    for i in range(2 * T):
        if not live:
            break
        values = mixed(np.concatenate([sets[k] for k in live]), i + 1)
        rows = np.repeat(np.array(live) * T, [len(sets[k]) for k in live])
        bins = (values >> np.uint64(57)).astype(np.int64) if i < T else i - T
        np.minimum.at(flat, rows + bins, np.uint64(i) << np.uint64(56) | values >> np.uint64(8))
        if i < T - 1 or i == 2 * T - 1:
            live = [k for k, full in zip(live, (out[live] != np.iinfo(np.uint64).max).all(1), strict=True) if not full]
    return out


def bands(sketch: np.ndarray) -> np.ndarray:
    """A number for each band of each row; the band's place counts."""
    x = sketch.reshape(len(sketch), T // ROWS, ROWS)
    out = np.zeros(x.shape[:2], np.uint64) + np.arange(T // ROWS, dtype=np.uint64)
    for j in range(ROWS):
        out = mixed(out + x[:, :, j], j + 1)
    return out


def digest(of: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(of.tobytes())


def name_of(id_col: str, text_col: str) -> tuple[Column, Column]:
    """What names a row's text: its id, or NO_ID, and a hash."""
    return F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)), F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit("")))


def named(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, rep, key, text) for each row."""
    rep, key = name_of(id_col, text_col)
    return df.select(F.col(id_col).cast("long").alias("doc_id"), rep.alias("rep"), key.alias("key"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def sketched(texts: DataFrame, k: int) -> DataFrame:
    """(doc_id, rep, key, n, digest, bands) for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = [shingle_set(x.as_py(), k) for x in batch.column(3)]
            numbers = pa.array(bands(sketches(sets)).view(np.int64).reshape(-1))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * (T // ROWS)), numbers)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([len(x) for x in sets], pa.int64()), pa.array([digest(x) for x in sets], pa.binary()), lists], names=["doc_id", "rep", "key", "n", "digest", "bands"])

    return texts.mapInArrow(run, "doc_id long, rep long, key long, n long, digest binary, bands array<long>")


def with_sets(texts: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """wanted (rep, key, tasks) with raw, the full set of the text of that name. Repeated rows give theirs once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            raws = pa.array([shingle_set(x.as_py(), k).tobytes() for x in batch.column(0)], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], raws], names=[*batch.schema.names[1:], "raw"])

    found = screened(texts, wanted, ["rep", "key"]).where("__maybe").groupBy("rep", "key").agg(F.first("text").alias("text"))
    tasks = wanted.schema["tasks"].dataType.simpleString()
    return found.join(wanted, ["rep", "key"]).select("text", "rep", "key", "tasks").mapInArrow(run, f"rep long, key long, tasks {tasks}, raw binary")


def linked(found: DataFrame) -> DataFrame:
    return found.select(F.struct(F.col("a_rep").alias("rep"), F.col("a_key").alias("key")).alias("a"), F.struct(F.col("b_rep").alias("rep"), F.col("b_key").alias("key")).alias("b"))


def link_table(found: list[tuple[tuple[int, int], tuple[int, int]]]) -> pa.Table:
    return pa.table({name: pa.array([x[i][j] for x in found], pa.int64()) for name, i, j in (("a_rep", 0, 0), ("a_key", 0, 1), ("b_rep", 1, 0), ("b_key", 1, 1))})


def verified(texts: DataFrame, pairs: DataFrame, k: int) -> DataFrame:
    """The links (a, b) among pairs (a, b) of names; b is the centre. Sets are made again from whole texts."""
    hot = pairs.groupBy("b").agg(F.count("*").alias("n")).where(F.col("n") > CHUNK)
    hot = hot.select("b", F.ceil(F.col("n") / CHUNK).cast("int").alias("parts"), F.explode(F.expr(f"sequence(0, {SALTS - 1})")).alias("salt"))
    dealt = pairs.withColumn("salt", F.pmod(F.xxhash64("a"), F.lit(SALTS)).cast("int")).join(hot, ["b", "salt"], "left")
    dealt = dealt.withColumn("task", F.struct(F.col("b.rep").alias("c_rep"), F.col("b.key").alias("c_key"), F.pmod(F.xxhash64("a", F.lit(1)), F.coalesce("parts", F.lit(1))).cast("int").alias("chunk")))
    wanted = dealt.select("a.rep", "a.key", "task").unionByName(dealt.select("b.rep", "b.key", "task").distinct()).groupBy("rep", "key").agg(F.collect_list("task").alias("tasks"))

    def links(group: pa.Table) -> pa.Table:
        names = zip(group.column("rep").to_pylist(), group.column("key").to_pylist(), strict=True)
        centre = group.column("c_rep")[0].as_py(), group.column("c_key")[0].as_py()
        of = dict(zip(names, group.column("raw"), strict=True))
        core = np.frombuffer(of.pop(centre).as_py(), np.uint64)
        out = []
        for name, raw in of.items():
            own = np.frombuffer(raw.as_py(), np.uint64)
            if len(own) < len(core):
                at = np.searchsorted(core, own)
                shared = int((core[np.minimum(at, len(core) - 1)] == own).sum())
            else:
                at = np.searchsorted(own, core)
                shared = int((own[np.minimum(at, len(own) - 1)] == core).sum())
            if UNDER * shared >= OVER * (len(own) + len(core) - shared):
                out.append((name, centre))
        return link_table(out)

    rows = with_sets(texts, written(wanted, "tasks"), k).select("rep", "key", "raw", F.inline("tasks"))
    return linked(rows.groupBy("c_rep", "c_key", "chunk").applyInArrow(links, LINK))


def alike(size: Column, other: Column) -> Column:
    """Whether sets of these sizes can be similar enough."""
    return F.least(size, other) * UNDER >= F.greatest(size, other) * OVER


def shared(left: list[np.ndarray], right: list[np.ndarray]) -> Iterator[np.ndarray]:
    """For each left set the sizes of its intersections with all right sets, through an inverted index of the right ones."""
    flat = np.concatenate(right)
    owner = np.repeat(np.arange(len(right), dtype=np.int32), [len(x) for x in right])
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    for of in left:
        low, high = np.searchsorted(flat, of, "left"), np.searchsorted(flat, of, "right")
        ends = np.cumsum(high - low)
        out = np.zeros(len(right), np.int64)
        for at in range(0, int(ends[-1]), HITS):  # a part of the hits at a time: sets may be long and copies many
            a, b = np.searchsorted(ends, [at, at + HITS], "right")
            n = (high - low)[a:b]
            hits = np.repeat(low[a:b] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            out += np.bincount(owner[hits], minlength=len(right))
        yield out


def joining(group: pa.Table) -> pa.Table:
    """Links between components among the sets of one or two blocks of a bucket: no more than join them, so fewer than sets.

    Block one holds minor members, which meet all of block two; a lone block may hold all members.
    """
    block, one, two = group.column("block").to_numpy(), group.column("one")[0].as_py(), group.column("two")[0].as_py()
    names = list(zip(group.column("rep").to_pylist(), group.column("key").to_pylist(), strict=True))
    codes: dict[tuple[int, int], int] = {}
    component = np.array([codes.setdefault(x, len(codes)) for x in zip(group.column("c_rep").to_pylist(), group.column("c_key").to_pylist(), strict=True)])
    left = np.flatnonzero((block == one) & group.column("minor").to_numpy())
    right = np.flatnonzero(block == two)
    out = []
    if len(left) and len(right) and len(codes) > 1:
        sets = {k: np.frombuffer(group.column("raw")[k].as_py(), np.uint64) for k in {*left.tolist(), *right.tolist()}}
        sizes = np.array([len(sets[k]) for k in right.tolist()])
        root = list(range(len(codes)))

        def top(x: int) -> int:
            while root[x] != x:
                root[x] = x = root[root[x]]
            return x

        for i, inter in zip(left.tolist(), shared([sets[k] for k in left.tolist()], [sets[k] for k in right.tolist()]), strict=True):
            good = (UNDER * inter >= OVER * (len(sets[i]) + sizes - inter)) & (component[right] != component[i])
            for j in right[good].tolist():
                a, b = top(int(component[i])), top(int(component[j]))
                if a != b:
                    root[max(a, b)] = min(a, b)
                    out.append((names[i], names[j]))
    return link_table(out)


def opened(placed: DataFrame) -> DataFrame:
    """Places of the members of buckets that lie in several components: (rep, key, place). placed: (bucket, rep, key, component).

    A bucket's largest component is the major one. A bucket of up to BLOCK members is one block; else its minor members are
    dealt over the first blocks and its major ones over the others. Of buckets with the same members one is taken.
    """
    name = lambda seed: F.bit_xor(F.xxhash64("rep", "key", F.lit(seed)))
    per = placed.groupBy("bucket", "component").agg(F.count("*").alias("m"), name(0).alias("x"), name(1).alias("y"))
    per = per.groupBy("bucket").agg(F.count("*").alias("kinds"), F.sum("m").alias("size"), F.max(F.struct("m", "component")).alias("top"), F.bit_xor("x").alias("x"), F.bit_xor("y").alias("y"))
    facts = per.where("kinds > 1 and size > 2").groupBy("x", "y", "size").agg(F.min(F.struct("bucket", "top")).alias("one")).select("one.bucket", "one.top", "size")
    blocks = lambda n: F.when(F.col("size") > BLOCK, F.ceil(n / BLOCK)).otherwise(1).cast("int")
    facts = facts.select("bucket", F.col("top.component").alias("major"), blocks(F.col("size") - F.col("top.m")).alias("minors"), F.when(F.col("size") > BLOCK, blocks(F.col("top.m"))).otherwise(0).alias("majors"))
    found = placed.join(written(facts, "open"), "bucket").withColumn("minor", F.col("component") != F.col("major"))
    spread = lambda n: F.pmod(F.xxhash64("rep", "key", F.lit(2)), F.col(n)).cast("int")
    block = F.when(F.col("minor") | (F.col("majors") == 0), spread("minors")).otherwise(F.col("minors") + spread("majors"))
    others = F.when(F.col("minor"), F.col("minors") + F.col("majors")).otherwise(F.col("minors"))
    place = F.struct("bucket", F.col("component.rep").alias("c_rep"), F.col("component.key").alias("c_key"), "minor", block.alias("block"), others.alias("others"))
    return found.select("rep", "key", place.alias("place"))


def across(texts: DataFrame, places: DataFrame, k: int) -> DataFrame:
    """Links (a, b) between components in the buckets of places (rep, key, place)."""
    wanted = places.groupBy("rep", "key").agg(F.collect_list("place").alias("tasks"))
    rows = with_sets(texts, written(wanted, "places"), k).select("rep", "key", "raw", F.inline("tasks"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("others") - 1)))
    rows = rows.withColumn("one", F.least("block", "other")).withColumn("two", F.greatest("block", "other")).drop("others", "other")
    return linked(rows.groupBy("bucket", "one", "two").applyInArrow(joining, LINK))


def near_duplicates(df: DataFrame, k: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept, rep, key, first) for each row of df.

    rep and key name a row's text, as name_of() does. first: whether the group keeps that text; texts that repeat under one id
    are all first or none.
    """
    texts = named(df, id_col, text_col)
    rows = written(sketched(texts, k), "sketches")
    node = F.struct("rep", "key")
    reps = rows.where("n > 0").groupBy("digest", "n").agg(F.min(node).alias("node"), F.min_by("bands", node).alias("bands"), F.count("*").alias("copies"))
    reps = written(reps.select("digest", "n", "node.rep", "node.key", "bands", "copies"), "sets")
    buckets = reps.select("rep", "key", "n", F.explode("bands").alias("bucket"))
    sizes = written(buckets.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1"), "buckets")
    members = written(screened(buckets, sizes, ["bucket"]).where("__maybe").join(sizes, "bucket").select("bucket", "rep", "key", "n"), "members")
    centres = members.groupBy("bucket").agg(F.min(F.struct("rep", "key", "n")).alias("centre"))
    # the centre comes with each member; pairs of one centre in several buckets count once
    beside = members.join(centres, "bucket").select(F.struct("rep", "key").alias("a"), "n", F.struct("centre.rep", "centre.key").alias("b"), F.col("centre.n").alias("other"))
    pairs = written(beside.where((F.col("a") != F.col("b")) & alike(F.col("n"), F.col("other"))).select("a", "b").distinct(), "pairs")
    links = written(verified(texts, pairs, k), "links")
    label = lambda found: found.select("id.rep", "id.key", "component")
    labelled = lambda some, found: some.join(label(found), ["rep", "key"], "left").withColumn("component", F.coalesce("component", F.struct("rep", "key")))
    found = components(links)
    places = written(opened(labelled(members, found).select("bucket", "rep", "key", "component")), "places")
    if not places.isEmpty():
        found = components(written(links.unionByName(across(texts, places, k)), "all-links"))
    labels = written(labelled(reps.select("digest", "n", "rep", "key", "copies"), found).select("digest", "n", "component", "copies"), "labels")
    for done in (reps, sizes, members, pairs, links, places):
        removed(done)
    # sets that are a large part of all rows meet their label by broadcast, the others by digest
    hot = F.broadcast(labels.where(F.col("copies") * HOT_SETS > rows.count()).drop("copies"))
    rows = rows.select("doc_id", "rep", "key", "n", "digest")
    out = rows.join(hot, ["digest", "n"]).unionByName(rows.join(hot, ["digest", "n"], "left_anti").join(labels.drop("copies"), ["digest", "n"], "left"))
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component.rep", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"), "rep", "key", F.coalesce(F.col("component") == F.struct("rep", "key"), F.lit(True)).alias("first"))


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    return near_duplicates(table(spark, sf_dir, "documents"), k=4).select("doc_id", "n_shingles", "component_id", "kept")
