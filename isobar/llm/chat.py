"""Chat formatting with a prefix tree [operator 3].

Method: conversations that share initial turns are merged in a prefix tree. Each node holds one turn's formatted text;
trees are emitted depth-first into packs, shared text once. A node carries the position of its first token on its path
(position ids count on from there) and the intervals of the pack that it attends to: those of its ancestors, then its
own. Tokens are code points here. The loss mask is the interval of a node's assistant text.

The template writes a turn as "### role: text</turn>" and a line end; in roles and texts a backslash stands before each
of the characters that control strings need, which is undone on reading.

Rows of a conversation stand by turn, then role, then text (nulls first). Null role or text is empty. A row with a null
conv_id is a conversation of its own. Repeated rows are turns of their own. Equal conversations are leaves only once, with
their ids in a table of members, so a conversation that many ids share stays small.

Leaves stand in the order of their paths, so those that share turns are neighbours, whatever share of all conversations a
root holds. Ranges of this order are cut into packs of about PACK characters: a token that conversations share is emitted
once in its pack, and again only in the next one, for the one path that a cut goes through. An empty table gives no
packs. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from isobar.llm.base import bounded_batches, table, written

#: Characters of a pack, about: it is closed by the conversation that reaches them.
PACK = 1 << 17
CONTROL = re.compile(r"[\\#<:\n]")
ESCAPED = re.compile(r"\\(.)", re.S)
TURN = re.compile(r"### ([^\\#<:\n]*(?:\\.[^\\#<:\n]*)*): ([^\\#<]*(?:\\.[^\\#<]*)*)</turn>\n", re.S)
TEXT_CONTROL = re.compile(r"[\\#<]")
NODES = "array<struct<start:int,stop:int,position:int,loss_start:int,loss_stop:int,attends:array<struct<start:int,stop:int>>>>"
PACKS = f"text string, nodes {NODES}, leaves array<struct<leaf:string,node:int>>"
READ = "leaf string, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def escaped(text: str, role: bool = False) -> str:
    return (CONTROL if role else TEXT_CONTROL).sub(lambda m: "\\" + m[0], text)


def unescaped(text: str) -> str:
    return ESCAPED.sub(r"\1", text) if "\\" in text else text


def formatted(role: str, text: str) -> tuple[str, int, int]:
    """A turn's text, and the interval of it that holds the turn's own text."""
    head, body = f"### {escaped(role, True)}: ", escaped(text)
    return f"{head}{body}</turn>\n", len(head), len(head) + len(body)


def conversations(df: DataFrame) -> DataFrame:
    """(conv_id, leaf, turns): the turns in order, and the digest of all of them."""
    turn = F.struct(F.col("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    ordered = F.transform(F.sort_array(F.collect_list(turn)), lambda x: F.struct(x.role.alias("role"), x.text.alias("text")))
    own = F.when(F.col("conv_id").isNull(), F.monotonically_increasing_id())
    whole = df.select("conv_id", "turn", "role", "text", own.alias("own")).groupBy("conv_id", "own").agg(ordered.alias("turns"))
    return whole.select("conv_id", F.sha2(F.to_json("turns").cast("binary"), 256).alias("leaf"), "turns")


class Pack:
    """A tree that is emitted depth-first as conversations come in the order of their paths."""

    def __init__(self) -> None:
        self.parts: list[str] = []
        self.size = 0
        self.nodes: list[tuple] = []  # (start, stop, position, loss_start, loss_stop, attends)
        self.leaves: list[tuple[str, int]] = []
        self.path: list[tuple[tuple[str, str], int]] = []  # the last conversation's turns and their nodes

    def add(self, leaf: str, turns: list[tuple[str, str]]) -> None:
        shared = 0
        while shared < min(len(self.path), len(turns)) and self.path[shared][0] == turns[shared]:
            shared += 1
        del self.path[shared:]
        for role, text in turns[shared:]:
            written_, a, b = formatted(role, text)
            place, stop = self.size, self.size + len(written_)
            above, position = (), 0
            if self.path:
                start, end, before, _, _, above = self.nodes[self.path[-1][1]]
                position = before + end - start
            # intervals that touch are one
            attends = (*above[:-1], (above[-1][0], stop)) if above and above[-1][1] == place else (*above, (place, stop))
            loss = (place + a, place + b) if role == "assistant" else (place, place)
            self.path.append(((role, text), len(self.nodes)))
            self.nodes.append((place, stop, position, *loss, attends))
            self.parts.append(written_)
            self.size = stop
        self.leaves.append((leaf, self.path[-1][1]))

    def row(self) -> dict:
        names = ("start", "stop", "position", "loss_start", "loss_stop")
        nodes = [dict(zip(names, x[:5], strict=True)) | {"attends": [{"start": a, "stop": b} for a, b in x[5]]} for x in self.nodes]
        return {"text": "".join(self.parts), "nodes": nodes, "leaves": [{"leaf": x, "node": k} for x, k in self.leaves]}


def packs(convs: DataFrame) -> DataFrame:
    """Packs of the distinct conversations among (leaf, turns), one row each."""
    interval = pa.struct([("start", pa.int32()), ("stop", pa.int32())])
    node = pa.struct([*((x, pa.int32()) for x in ("start", "stop", "position", "loss_start", "loss_stop")), ("attends", pa.list_(interval))])
    schema = pa.schema([("text", pa.string()), ("nodes", pa.list_(node)), ("leaves", pa.list_(pa.struct([("leaf", pa.string()), ("node", pa.int32())])))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = Pack()
        for batch in batches:
            turns, ends = batch.column("turns").flatten(), batch.column("turns").offsets.to_pylist()
            said = list(zip(turns.field("role").to_pylist(), turns.field("text").to_pylist(), strict=True))
            first = ends[0]
            for leaf, a, b in zip(batch.column("leaf").to_pylist(), ends, ends[1:]):  # noqa: B905
                pack.add(leaf, said[a - first : b - first])
                if pack.size >= PACK:
                    yield pa.RecordBatch.from_pylist([pack.row()], schema)
                    pack = Pack()
        if pack.leaves:
            yield pa.RecordBatch.from_pylist([pack.row()], schema)

    leaves = convs.groupBy("leaf").agg(F.first("turns").alias("turns"))
    # a number for each beginning of a conversation: equal beginnings have equal numbers, and shorter ones stand first
    path = F.aggregate("turns", F.array().cast("array<long>"), lambda done, x: F.concat(done, F.array(F.xxhash64(F.try_element_at(done, F.lit(-1)), x.role, x.text))))
    ordered = leaves.withColumn("path", path).repartitionByRange("path", "leaf").sortWithinPartitions("path", "leaf")
    return ordered.select("leaf", "turns").mapInArrow(run, PACKS)


def position_ids(nodes: list[dict]) -> list[int]:
    """The position of each token of a pack on its path."""
    return [k for x in nodes for k in range(x["position"], x["position"] + x["stop"] - x["start"])]


def read_pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From a pack's text and nodes alone: each leaf's conversation, unescaped, and the texts under the loss mask."""
    types = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
    for batch in batches:
        for text, nodes, leaves in zip(*(batch.column(c) for c in ("text", "nodes", "leaves")), strict=True):
            text, nodes, rows = text.as_py(), nodes.values, []
            attends = nodes.field("attends")
            ends = (attends.offsets.to_numpy() - attends.offsets[0].as_py()).tolist()
            intervals = list(zip(*(attends.flatten().field(k).to_pylist() for k in (0, 1)), strict=True))
            masks = [(a, b) for a, b in zip(nodes.field("loss_start").to_pylist(), nodes.field("loss_stop").to_pylist(), strict=True) if b > a]
            for leaf, node in zip(leaves.values.field("leaf").to_pylist(), leaves.values.field("node").to_pylist(), strict=True):
                path = intervals[ends[node] : ends[node + 1]]
                whole = "".join([text[s:e] for s, e in path])
                turns = [(unescaped(r), unescaped(t)) for r, t in TURN.findall(whole)]
                loss = under(text, masks, path)
                digest = hashlib.sha256("".join([f"{r}\n{t}\n" for r, t in turns]).encode()).hexdigest()
                rows.append((leaf, len(turns), digest, len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(whole)))
            columns = zip(*rows, strict=True) if rows else [()] * len(types)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, types, strict=True)], names=[x.split(" ")[0] for x in READ.split(", ")])


def under(text: str, masks: list[tuple[int, int]], path: list[tuple[int, int]]) -> str:
    """Unescaped text of the masks inside a path's intervals; both are in order."""
    return "".join(unescaped(text[s:e]) for a, b in path for s, e in masks[bisect_left(masks, (a, 0)) : bisect_left(masks, (b, 0))] if e <= b)


def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounded_batches(spark, 200)
    said = "\\### Assistant: </turn> ok"
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    convs = written(conversations(rows.unionByName(more)), "conversations")
    out = written(packs(convs), "packs")
    read = out.select("text", "nodes", "leaves").mapInArrow(read_pack, READ)
    return convs.select("conv_id", "leaf").join(read, "leaf").drop("leaf")


OP3_SQL = r"""
with c as (
    select conv_id, case when conv_id is null then row_number() over () end as own, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
    union all select -7, null, 0, 'user', '\### Assistant: </turn> ok' union all select -7, null, 1, 'assistant', '\### Assistant: </turn> ok'
),
t as (
    select conv_id, count(*) as n_turns, string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text) as turns,
        coalesce(string_agg(case when role = 'assistant' then text end, '' order by turn, role, text), '') as loss,
        cast(sum(4 + length(regexp_replace(role, '([\\#<:\n])', '\\\1', 'g')) + 2 + length(regexp_replace(text, '([\\#<])', '\\\1', 'g')) + 8) as bigint) as formatted_chars
    from c group by conv_id, own
)
select conv_id, n_turns, sha256(turns) as turns_sha256, cast(length(loss) as bigint) as loss_chars, sha256(loss) as loss_sha256, formatted_chars from t
"""
