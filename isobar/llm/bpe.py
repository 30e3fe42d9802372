"""Byte-level BPE encoding and decoding [operator 4].

Method: per word, a contiguous array of part boundaries beside the ranks of adjacent parts; the smallest rank is
found by a scan, its boundary goes, and the ranks of its neighbours are looked up again. Words are cached across tasks, so a
worker merges a word again only after its cache, bounded by bytes, has lost it. Words of more than LONG bytes take a heap instead of the scan, with the
same result, so that a long run without spaces stays near linear.

Null and empty texts have no ids and decode to the empty text. Rows are independent: repeated rows give repeated
results, a null id is kept, an empty table gives no rows, and other columns are not read.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from isobar.llm.base import bounded_batches, slices, table

#: Fixed value: the split of byte-level BPE into words. White space is Unicode's, as in the library.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
LONG = 200
#: Bytes that the ids of words, and those of pieces after a space, may hold in a worker, twice; those of an entry besides its text and ids.
CACHED_WORDS, CACHED_PIECES, ENTRY = 8 << 20, 36 << 20, 150
NONE = 1 << 30
#: A space that white space or the end follows.
DOUBLE = re.compile(r" (?=\s|\Z)")


def byte_letters() -> dict[str, int]:
    """The vocabulary's letter for each byte: itself if visible, else the next free one from 256 on."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(seen)]
    return {chr(b): b for b in seen} | {chr(256 + k): b for k, b in enumerate(hidden)}


class Cache(dict):
    """Ids by text, across batches and tasks. At a bound on bytes all become old ones; what is still used comes back."""

    def __init__(self, most: int):
        super().__init__()
        self.most, self.held, self.old = most, 0, {}

    def learn(self, values: Iterable[tuple[str, bytes]]) -> None:
        found = dict(values)
        self.update(found)
        self.held += sum(map(len, found)) + sum(map(len, found.values())) + ENTRY * len(found)

    def missing(self, texts: Iterable[str]) -> list[str]:
        """Those of texts, none of them here, that aren't among the old ones either."""
        old, out, back = self.old, [], []
        for x in texts:
            ids = old.get(x)
            if ids is None:
                out.append(x)
            else:
                back.append((x, ids))
        self.learn(back)
        return out

    def trimmed(self) -> None:
        """Called between batches, so that what a batch has learnt stays until its end."""
        if self.held > self.most:
            self.old = dict(self)
            self.clear()
            self.held = 0


class Bpe:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        letters, model = byte_letters(), file["model"]
        vocab: dict[str, int] = model["vocab"]
        self.added = {x["content"]: x["id"] for x in file["added_tokens"]}
        self.of_byte = [0] * 256
        for letter, byte in letters.items():
            self.of_byte[byte] = vocab[letter]
        self.byte_ids = np.array(self.of_byte, np.int32)
        self.bytes = {i: (bytes(letters[c] for c in t) if t not in self.added else t.encode()) for t, i in vocab.items()}
        self.bytes |= {i: t.encode() for t, i in self.added.items()}
        self.pairs: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.pairs.setdefault((vocab[a], vocab[b]), (rank, vocab[a + b]))
        self.split = regex.compile(PATTERN)
        self.special = regex.compile("|".join(regex.escape(x) for x in sorted(self.added, key=len, reverse=True))) if self.added else None
        self.words, self.spaced = Cache(CACHED_WORDS), Cache(CACHED_PIECES)
        self.keys = np.sort(np.array([a << 20 | b for a, b in self.pairs], np.int64))
        found = [self.pairs[int(x) >> 20, int(x) & 0xFFFFF] for x in self.keys]
        self.ranks = np.array([x[0] for x in found], np.int32)
        self.merged = np.zeros(len(model["merges"]), np.int32)
        self.merged[self.ranks] = [x[1] for x in found]
        top = 1 + max(self.bytes)
        self.lengths = np.array([len(self.bytes.get(i, b"")) for i in range(top)], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.letters = np.frombuffer(b"".join(self.bytes.get(i, b"") for i in range(top)), np.uint8)

    def merge(self, word: bytes) -> list[int]:
        ids = [self.of_byte[b] for b in word]
        if len(ids) > LONG:
            return self.merge_long(ids)
        pairs, nothing = self.pairs, (NONE, 0)
        bounds = list(range(len(ids) + 1))  # part k of the word is word[bounds[k]:bounds[k + 1]], its id ids[k]
        ranks = [pairs.get(x, nothing)[0] for x in zip(ids, ids[1:])]
        while ranks:
            least = min(ranks)
            if least == NONE:
                break
            k = ranks.index(least)
            ids[k] = pairs[ids[k], ids[k + 1]][1]
            del ids[k + 1], bounds[k + 1], ranks[k]
            if k < len(ranks):
                ranks[k] = pairs.get((ids[k], ids[k + 1]), nothing)[0]
            if k:
                ranks[k - 1] = pairs.get((ids[k - 1], ids[k]), nothing)[0]
        return ids

    def merge_long(self, ids: list[int]) -> list[int]:
        """As merge: the smallest rank first, the leftmost of equals; parts are linked and ranks wait in a heap."""
        n, pairs = len(ids), self.pairs
        after, before = [*range(1, n + 1)], [*range(-1, n - 1)]
        heap = [(pairs[x][0], k, *x) for k, x in enumerate(zip(ids, ids[1:])) if x in pairs]
        heapq.heapify(heap)
        while heap:
            _, k, a, b = heapq.heappop(heap)
            r = after[k]
            if ids[k] != a or r >= n or ids[r] != b:
                continue
            ids[k], ids[r], after[k] = pairs[a, b][1], -1, after[r]
            if after[r] < n:
                before[after[r]] = k
            for x, y in ((before[k], k), (k, after[k])):
                if x >= 0 and y < n and (found := pairs.get((ids[x], ids[y]))):
                    heapq.heappush(heap, (found[0], x, ids[x], ids[y]))
        return [x for x in ids if x >= 0]

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) << 20 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], np.int32(NONE))

    def merge_block(self, words: list[bytes]) -> list[bytes]:
        """merge() for many words of one length: row by row the same scan, deletion and refreshing. Ids as int32 bytes.

        Each step takes one part from every row that is left, so the rows stay equally long.
        """
        ids = self.byte_ids[np.frombuffer(b"".join(words), np.uint8)].reshape(len(words), -1)
        ranks = self.rank(ids[:, :-1], ids[:, 1:])
        rows, out = np.arange(len(words)), [b""] * len(words)
        while True:
            width = ids.shape[1]
            k = ranks.argmin(1) if width > 1 else np.zeros(len(rows), int)
            least = ranks[np.arange(len(rows)), k] if width > 1 else np.full(len(rows), NONE, np.int32)
            going = least < NONE
            if not going.all():
                ended = np.ascontiguousarray(ids[~going]).tobytes()
                for n, row in enumerate(rows[~going].tolist()):
                    out[row] = ended[4 * width * n : 4 * width * (n + 1)]
                if not going.any():
                    return out
                ids, ranks, rows, k, least = ids[going], ranks[going], rows[going], k[going], least[going]
            each, at = np.arange(len(rows)), np.arange(width)
            ids = np.where(at[:-1] <= k[:, None], ids[:, :-1], ids[:, 1:])
            ids[each, k] = self.merged[least]
            ranks = np.where(at[:-2] < k[:, None], ranks[:, :-1], ranks[:, 1:])
            r = each[k < width - 2]
            ranks[r, k[r]] = self.rank(ids[r, k[r]], ids[r, k[r] + 1])
            r = each[k > 0]
            ranks[r, k[r] - 1] = self.rank(ids[r, k[r] - 1], ids[r, k[r]])

    def merged_ids(self, words: Iterable[tuple[str, str]]) -> Iterator[tuple[str, bytes]]:
        """(name, ids as int32 bytes) of each (name, word)."""
        by_length: dict[int, tuple[list[str], list[bytes]]] = {}
        for name, x in words:
            raw = x.encode()
            names, raws = by_length.setdefault(len(raw), ([], []))
            names.append(name)
            raws.append(raw)
        for n, (names, raws) in by_length.items():
            if n > 40 or len(raws) < 8:
                yield from zip(names, (np.array(self.merge(raw), np.int32).tobytes() for raw in raws), strict=True)
            else:
                yield from zip(names, self.merge_block(raws), strict=True)

    def learn_words(self, words: set[str]) -> None:
        self.words.learn(self.merged_ids((x, x) for x in self.words.missing(words.difference(self.words))))

    def learn_pieces(self, pieces: set[str]) -> None:
        """Pieces that a space stands before. One of letters alone is one word with its space, and needs no split."""
        new = self.spaced.missing(pieces)
        plain = [x for x in new if x.isalpha()]
        other = [x for x in new if not x.isalpha()]
        split = [self.split.findall(" " + x) for x in other]
        self.learn_words(set(chain.from_iterable(split)))
        word = self.words.__getitem__
        self.spaced.learn(self.merged_ids((x, " " + x) for x in plain))
        self.spaced.learn((x, b"".join(map(word, s))) for x, s in zip(other, split, strict=True))

    def encode_many(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text.

        A word always begins at a space that non-space follows. Where every space is of that kind, a text is split at its
        spaces, and each piece has ids of its own; other texts are split by the pattern at once.
        """
        self.words.trimmed()
        self.spaced.trimmed()
        for content, i in self.added.items():
            self.words[content] = np.int32(i).tobytes()
        plans: list[list[tuple[bool, list[str]]]] = []  # per text its parts: pieces after a space, or words
        for text in texts:
            plan, at = [], 0
            cuts = [*self.special.finditer(text)] if self.special else []
            for m in [*cuts, None]:
                part = text[at : m.start()] if m else text[at:] if at else text
                if DOUBLE.search(part):
                    plan.append((False, self.split.findall(part)))
                else:
                    first, *pieces = part.split(" ")
                    plan += [(False, self.split.findall(first)), (True, pieces)]
                if m:
                    plan.append((False, [m[0]]))
                    at = m.end()
            plans.append(plan)
        get = {True: self.spaced.get, False: self.words.get}
        found = [[[*map(get[own], x)] for own, x in plan] for plan in plans]
        new: dict[bool, set[str]] = {True: set(), False: set()}
        short = []  # parts that lack ids of some of theirs
        for plan, ids in zip(plans, found, strict=True):
            for k, (own, x) in enumerate(plan):
                if None in ids[k]:
                    new[own].update(w for w, v in zip(x, ids[k], strict=True) if v is None)
                    short.append((own, x, ids, k))
        self.learn_words(new[False])
        self.learn_pieces(new[True])
        for own, x, ids, k in short:
            ids[k] = [v if v is not None else get[own](w) for w, v in zip(x, ids[k], strict=True)]
        return [np.frombuffer(b"".join(chain.from_iterable(ids)), np.int32) for ids in found]

    def decode_many(self, ids: np.ndarray, ends: np.ndarray) -> list[str]:
        """Texts of lists of ids that stand one after the other. Unknown ids are nothing; bytes that aren't UTF-8 become U+FFFD."""
        known = (ids >= 0) & (ids < len(self.lengths))
        safe = np.where(known, ids, 0)
        lengths = np.where(known, self.lengths[safe], 0)
        place = np.concatenate([[0], np.cumsum(lengths)])
        letters = self.letters[np.repeat(self.starts[safe] - place[:-1], lengths) + np.arange(place[-1])].tobytes()
        cuts = place[ends].tolist()
        return [letters[a:b].decode("utf-8", "replace") for a, b in zip([0, *cuts], cuts)]  # noqa: B905


@lru_cache(maxsize=2)
def loaded(path: str) -> Bpe:
    return Bpe(path)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def encode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """(id, ids array<int>) for each row. The vocabulary is read on the executors from the path given."""
    path = vocabulary or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path)
        for batch in slices(batches, 512):
            parts = bpe.encode_many([x.as_py() or "" for x in batch.column(1)])
            ends = np.cumsum([0, *map(len, parts)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(parts)))], names=[id_col, "ids"])

    kind = df.select(F.col(id_col)).schema[0].dataType.simpleString()
    return df.select(id_col, F.col(text_col).cast("string")).mapInArrow(run, f"`{id_col}` {kind}, ids array<int>")


def decode(df: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", vocabulary: str | None = None) -> DataFrame:
    """(id, ids, decoded text) for each row; null ids decode to the empty text."""
    path = vocabulary or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path)
        for batch in slices(batches):
            ids = batch.column(1)
            ends = np.cumsum(pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False))
            texts = bpe.decode_many(pc.fill_null(ids.flatten(), -1).to_numpy(zero_copy_only=False), ends)
            yield pa.RecordBatch.from_arrays([batch.column(0), ids, pa.array(texts, pa.string())], names=[id_col, "ids", "decoded"])

    kind = df.select(F.col(id_col)).schema[0].dataType.simpleString()
    return df.select(id_col, F.col(ids_col)).mapInArrow(run, f"`{id_col}` {kind}, ids array<int>, decoded string")


def round_trip(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """(id, ids, decoded): encode and decode in one pass, so that ids needn't go out to be read again."""
    path = vocabulary or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path)
        for batch in slices(batches, 256):
            parts = bpe.encode_many([x.as_py() or "" for x in batch.column(1)])
            ids, ends = np.concatenate(parts), np.cumsum([0, *map(len, parts)]).astype(np.int32)
            decoded = pa.array([x for at in range(0, len(parts), 32) for x in bpe.decode_many(ids[ends[at] : ends[min(at + 32, len(parts))]], ends[at + 1 : at + 33] - ends[at])], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(ids)), decoded], names=[id_col, "ids", "decoded"])

    kind = df.select(F.col(id_col)).schema[0].dataType.simpleString()
    return df.select(id_col, F.col(text_col).cast("string")).mapInArrow(run, f"`{id_col}` {kind}, ids array<int>, decoded string")


def digests(df: DataFrame) -> DataFrame:
    """Per document the number of ids, the digest of the decimal ids and that of the decoded text."""
    return round_trip(df).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    return digests(table(spark, sf_dir, "documents"))
