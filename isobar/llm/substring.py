"""Substring dedup: words covered by windows that repeat anywhere go [operator 7].

Method: a compressed FM-index per shard. Documents are streamed against the index of their shard by backward search over
its wavelet matrix; matching statistics give the intervals of at least SIZE words that the index holds twice.

What can match must share a shard, and no more: every window of SIZE words has a minimiser, the least number among its
runs of GRAM words, and equal windows have equal minimisers. Neighbouring windows with the same minimiser form one
segment; segments meet by minimiser. So the work is linear in the input, unlike a search of all documents against
every shard's index. Before the search, counts decide what they can:
- a minimiser that occurs once belongs to windows that occur once;
- segments of equal words repeat as a whole, so copies, however many, are counted and never indexed more than once;
- what is left, segments that share a minimiser but differ, is indexed and searched, in shards of about SHARD words.
Minimisers with over HOT different segments (a passage that a large part of all documents holds, with other words around) would
overfill a shard: their windows are counted one by one by a 128-bit digest instead, which deals them out evenly.

Words are 64-bit numbers, so different words are taken as equal with negligible probability. Null and blank texts have no
words, and keep the empty text. Rows that repeat a document repeat its windows; what is told of them is told once, so
their work is linear. Only documents with windows to remove or to look at are shuffled: a bitmap of fixed size lets the
others pass. Null ids are kept. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from isobar.llm.base import bounded_batches, removed, screened, slices, table, written
from isobar.llm.shingles import mixed, numbers, words
from isobar.llm.wavelet import Index, repeated

SIZE, GRAM = 35, 8
SHARD, HOT = 600_000, 20_000
#: Words that are removed with a segment or searched in it: bits of what a document's pass is told.
#: AGAIN tells that equal rows say the same, of which one is enough.
WHOLE, SEARCH, INDEX, WINDOWS, AGAIN = 1, 2, 4, 8, 16
#: A kind of segment that more than one in so many segments is of is hot; there are fewer than that.
HOT_KINDS = 1024


def gram_numbers(of: np.ndarray) -> np.ndarray:
    """A number for each run of GRAM words, by doubling."""
    k, out = 1, mixed(of)
    while k < GRAM:
        out = mixed(out[:-k] + out[k:] * np.uint64(0x9E3779B97F4A7C15), k)
        k *= 2
    return out


def segments(of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(minimiser, first window, last window) of each run of windows with one minimiser."""
    if len(of) < SIZE:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    gram = gram_numbers(of)
    place = np.lib.stride_tricks.sliding_window_view(gram, SIZE - GRAM + 1).argmin(1) + np.arange(len(of) - SIZE + 1)
    first = np.flatnonzero(np.diff(place, prepend=-1))
    return gram[place[first]], first, np.append(first[1:], len(place)) - 1


def located(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, key, text): a row's id and a number of its id and text, by which its pieces find it again."""
    return df.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).withColumn("key", F.xxhash64("id", "text"))


def segmented(rows: DataFrame) -> DataFrame:
    """(least, digest, id, key, first, last) of every segment."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            least, digest, doc, first, last = [], [], [], [], []
            for k, text in enumerate(batch.column(2)):
                of = numbers(words(text.as_py()))
                h, a, b = segments(of)
                raw = of.tobytes()
                digest += [xxhash.xxh3_64_intdigest(raw[8 * x : 8 * (y + SIZE)]) for x, y in zip(a.tolist(), b.tolist(), strict=True)]
                least.append(h)
                first.append(a)
                last.append(b)
                doc.append(np.full(len(h), k))
            at = pa.array(np.concatenate(doc))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(least).view(np.int64)), pa.array(np.array(digest, np.uint64).view(np.int64)), batch.column(0).take(at), batch.column(1).take(at), pa.array(np.concatenate(first).astype(np.int32)), pa.array(np.concatenate(last).astype(np.int32))],
                names=["least", "digest", "id", "key", "first", "last"],
            )

    return rows.select("id", "key", "text").mapInArrow(run, "least long, digest long, id long, key long, first int, last int")


def repeated_kinds(found: DataFrame, counts: DataFrame) -> DataFrame:
    """The segments of found whose words stand in several. Kinds that are a large part of all, few by their share, are broadcast."""
    many = counts.where("n > 1").select("least", "digest", "n")
    hot = F.broadcast(many.where(F.col("n") * HOT_KINDS > found.count()).drop("n"))
    cold = found.join(hot, ["least", "digest"], "left_anti").join(many.drop("n"), ["least", "digest"], "left_semi")
    return found.join(hot, ["least", "digest"], "left_semi").unionByName(cold)


def told(segs: DataFrame) -> DataFrame:
    """(id, key, marks): for each document the segments that its pass has to remove, search, index or count."""
    by_least = segs.groupBy("least").agg(F.count("*").alias("n"), F.min("digest").alias("low"), F.max("digest").alias("high")).where("n > 1")
    seen = written(by_least.select("least", (F.col("low") == F.col("high")).alias("same")), "minimisers")
    found = written(screened(segs, seen, ["least"]).where("__maybe").drop("__maybe").join(seen, "least"), "segments-seen")
    mixed_ = found.where("not same").drop("same")
    rows = mixed_.groupBy("least", "digest", "id", "key", "first").agg(F.count("*").alias("n"))  # rows that are equal count together
    counts = rows.groupBy("least", "digest").agg(F.sum("n").alias("n"), F.min(F.struct("id", "key", "first", F.col("n").alias("rows"))).alias("one"))
    counts = written(counts, "segment-counts")
    by_least = counts.groupBy("least").agg(F.count("*").alias("kinds"), F.min("n").alias("fewest"))
    facts = counts.join(by_least.where("fewest = 1"), "least").select("least", "digest", "n", "one", F.when(F.col("kinds") > HOT, WINDOWS).otherwise(INDEX).alias("how"))
    # a segment's first window names it within its document; its last is known to the pass over the words
    what = F.when((F.col("n") > 1) | (F.col("how") == WINDOWS), F.col("how")).otherwise(SEARCH + INDEX) + F.when(F.col("one.rows") > 1, AGAIN).otherwise(0)
    others = facts.select("one.id", "one.key", "one.first", F.lit(-1).alias("last"), "least", what.alias("what"))
    whole = found.where("same").drop("same").unionByName(repeated_kinds(mixed_, counts))
    whole = whole.select("id", "key", "first", "last", "least", F.lit(WHOLE).alias("what"))
    return whole.unionByName(others).groupBy("id", "key").agg(F.collect_set(F.struct("first", "last", "what", "least")).alias("marks"))


def covered(count: int, runs: list[tuple[int, int]]) -> np.ndarray:
    """Which of count words lie in windows; runs: first and last window."""
    steps = np.zeros(count + 1, np.int64)
    for a, b in runs:
        steps[a] += 1
        steps[b + SIZE] -= 1
    return np.cumsum(steps[:-1]) > 0


def kept(found: list[bytes], runs: list[tuple[int, int]]) -> tuple[int, str, str]:
    """(words removed, the text that stays, its digest)."""
    if runs:
        gone = covered(len(found), runs)
        found = [w for w, x in zip(found, gone.tolist(), strict=True) if not x]
        n = int(gone.sum())
    else:
        n = 0
    raw = b" ".join(found)
    return n, raw.decode("utf-8", "surrogatepass"), hashlib.sha256(raw).hexdigest()


PASS = "id long, key long, n_words long, n_removed long, kept string, kept_sha256 string, text string, runs array<struct<first:int,last:int>>, least long, first int, what int, raw binary"


def passed(rows: DataFrame, marks: DataFrame, texts: bool = False) -> DataFrame:
    """One pass over the texts with their marks. Documents with nothing to search are done; the others keep their text for the
    next pass and send out the words of segments to search or to index, or the digests of windows to count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("id", pa.int64()), ("key", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string()), ("kept_sha256", pa.string()), ("text", pa.string()), ("runs", pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))), ("least", pa.int64()), ("first", pa.int32()), ("what", pa.int32()), ("raw", pa.binary())])
        for batch in slices(batches):
            out = []
            for id_, key, text, marks_ in zip(*(batch.column(c).to_pylist() for c in ("id", "key", "text", "marks")), strict=True):
                found, row = words(text), {"id": id_, "key": key}
                runs = [(x["first"], x["last"]) for x in marks_ or () if x["what"] == WHOLE]
                asked = {x["first"]: x for x in marks_ or () if x["what"] != WHOLE}
                if asked:
                    of = numbers(found)
                    for least, a, b in zip(*(x.tolist() for x in segments(of)), strict=True):
                        if a in asked:
                            piece = {"first": a, "what": asked[a]["what"], "least": asked[a]["least"]}
                            if asked[a]["what"] & WINDOWS:
                                out += [row | piece | {"first": s, "raw": xxhash.xxh3_128_digest(of[s : s + SIZE].tobytes())} for s in range(a, b + 1)]
                            else:
                                out.append(row | piece | {"raw": of[a : b + SIZE].tobytes()})
                    out.append(row | {"n_words": len(found), "text": text, "runs": [{"first": a, "last": b} for a, b in runs]})
                else:
                    n, text, digest = kept(found, runs)
                    out.append(row | {"n_words": len(found), "n_removed": n, "kept": text if texts else None, "kept_sha256": digest})
            yield from pa.Table.from_pylist(out, schema).to_batches()

    near = screened(rows, marks, ["id", "key"])
    some = near.where("__maybe")
    told_ = some.join(marks, (some["id"].eqNullSafe(marks["id"])) & (some["key"] == marks["key"]), "left").select(some["id"], some["key"], "text", "marks")
    free = near.where("not __maybe").select("id", "key", "text", F.lit(None).cast(marks.schema["marks"].dataType).alias("marks"))
    return free.unionByName(told_).mapInArrow(run, PASS)


def searched(pieces: DataFrame) -> DataFrame:
    """(id, key, first, last): windows that repeat, from an FM-index per shard of the pieces' words."""
    size = pieces.agg(F.sum(F.length("raw")) / 8).first()[0] or 0
    shards = max(1, int(-(-size // SHARD)))

    def run(shard: pa.Table) -> pa.Table:
        raws = shard.column("raw").to_pylist()
        lengths = np.array([len(x) // 8 for x in raws])
        of = np.frombuffer(b"".join(raws), np.uint64)
        ends = np.cumsum(lengths + 1)
        symbols = np.zeros(ends[-1], np.int64)
        inside = np.ones(ends[-1], bool)
        inside[ends - 1] = False
        symbols[inside] = np.unique(of, return_inverse=True)[1] + 1
        query = np.flatnonzero(np.array(shard.column("what").to_pylist()) & SEARCH)
        found = repeated(Index(symbols, 2 * SIZE), symbols, (ends - lengths - 1)[query], (ends - 1)[query], SIZE)
        at = pa.array(query[[d for d, _, _ in found]] if found else np.empty(0, np.int64))
        begin = np.array(shard.column("first").take(at).to_pylist(), np.int32)
        return pa.table({"id": shard.column("id").take(at), "key": shard.column("key").take(at), "first": pa.array(begin + np.array([a for _, a, _ in found], np.int32)), "last": pa.array(begin + np.array([b for _, _, b in found], np.int32))})

    dealt = pieces.withColumn("shard", F.pmod(F.xxhash64("least"), F.lit(shards)).cast("int"))
    return dealt.groupBy("shard").applyInArrow(run, "id long, key long, first int, last int")


def without_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", texts: bool = False) -> DataFrame:
    """(id, n_words, n_removed, kept, kept_sha256) for each row; kept, the text that stays, is null unless texts are asked for."""
    rows = located(df, id_col, text_col)
    segs = written(segmented(rows), "segments")
    marks = written(told(segs), "marks")
    removed(segs)
    out = written(passed(rows, marks, texts), "pass")
    removed(marks)
    pieces = out.where("raw is not null")
    again = F.col("what").bitwiseAND(AGAIN) > 0
    pieces = pieces.where(~again).unionByName(pieces.where(again).dropDuplicates(["id", "key", "first", "least", "what"]))
    counted = pieces.where(F.col("what").bitwiseAND(WINDOWS) > 0)
    twice = counted.groupBy("raw").agg(F.count("*").alias("n")).where("n > 1").select("raw")
    windows = counted.join(twice, "raw", "left_semi").select("id", "key", "first", F.col("first").alias("last"))
    runs = searched(pieces.where(F.col("what").bitwiseAND(WINDOWS) == 0)).unionByName(windows).groupBy("id", "key").agg(F.collect_set(F.struct("first", "last")).alias("more"))
    waiting = out.where("text is not null").select("id", "key", "text", "runs")
    rest = waiting.join(runs, waiting["id"].eqNullSafe(runs["id"]) & (waiting["key"] == runs["key"]), "left").select(waiting["id"], "text", "runs", "more")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            made = []
            for text, own, more in zip(*(batch.column(c).to_pylist() for c in ("text", "runs", "more")), strict=True):
                found = words(text)
                made.append((len(found), *kept(found, [(x["first"], x["last"]) for x in [*own, *(more or ())]])))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x[0] for x in made], pa.int64()), pa.array([x[1] for x in made], pa.int64()), pa.array([x[2] if texts else None for x in made], pa.string()), pa.array([x[3] for x in made], pa.string())], names=["id", "n_words", "n_removed", "kept", "kept_sha256"])

    done = out.where("kept_sha256 is not null").select("id", "n_words", "n_removed", "kept", "kept_sha256")
    return done.unionByName(rest.mapInArrow(finish, "id long, n_words long, n_removed long, kept string, kept_sha256 string")).withColumnRenamed("id", id_col)


def op7_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    return without_repeats(table(spark, sf_dir, "documents")).drop("kept")
