"""Personal data: offset-preserving deobfuscation [operator 6].

Method: small transducers rewrite a text (homoglyphs one for one; spelled digits; at and dot disguises) and keep, for
each piece of the rewriting, the source interval that it stands for. Detectors run on the source (base spans) and on
the rewriting; spans found there are carried back to source characters and added unless they lie inside a base span of
their kind, where the source really is disguised. Base spans are never changed, so an added span may overlap them.

Null text is empty and has no spans. Rows are independent: repeated rows give repeated results, null ids are kept, an
empty table gives no rows, and other columns are not read. Each detector is linear in the text, however long.
Plain words "at" and "dot" count only where the domain ends in a well-known top-level domain, a plain "at" before a
domain with plain dots only after a local part that is no word (jane.doe, joe99), spelled digits only in runs of four or
more, so that prose is left alone. What is looked for first, to save time, is a part of each match.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from isobar.llm.base import bounded_batches, slices, table

KINDS = ("email", "ip", "card", "phone")
SPANS = "array<struct<kind:string,start:int,end:int,base:boolean>>"
Span = tuple[int, int]

# The detectors. Possessive forms match the same as the plain ones, without backtracking.
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9]){12,}+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
# Cyrillic and Greek letters that look like Latin ones, and the Latin ones.
ALIKE = dict(zip("АВЕКМНОРСТУХаеорсухіјѕԁԛԝһΑΒΕΖΗΙΚΜΝΟΡΤΥΧονρυ", "ABEKMHOPCTYXaeopcyxijsdqwhABEZHIKMNOPTYXovpu", strict=True))
# Spelled digits.
DIGITS = {"zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9"}
TLD = "com|org|net|edu|gov|mil|int|info|biz|io|co|ai|app|dev|me|us|uk|de|fr|es|it|nl|eu|ch|at|be|ru|cn|jp|in|br|ca|au"
WORD = "|".join(DIGITS)
RUN = re.compile(rf"\b(?:plus[ -]+)?(?:(?:{WORD})(?:[ ,-]{{1,3}}|[ ,-]{{1,3}}(?:dot|point)[ ,-]{{1,3}})){{3,}}(?:{WORD})\b", re.I)
RUN_START = re.compile(rf"(?:{WORD})[ ,-]{{1,3}}(?:{WORD}|dot|point)")  # a part of each match of RUN in lower case, quick to look for
RUN_PART = re.compile(rf"plus[ -]+|(?:{WORD})|[ ,-]+(?:dot|point)[ ,-]+|[ ,-]+", re.I)
AT = re.compile(r" ?[\[({<] ?(?:at|@) ?[\])}>] ?", re.I)
DOT = re.compile(r" ?[\[({<] ?(?:dot|\.) ?[\])}>] ?", re.I)
BRACKETED = re.compile(r"[\[({<] ?(?:at|@|dot|\.) ?[\])}>]", re.I)  # a part of each match of AT and of DOT, quick to look for
SPOKEN = re.compile(rf"(?<=[A-Za-z0-9_%+-])( at | @ | ?@ ?)((?:[A-Za-z0-9-]+(?: dot | \. |\.)){{1,6}})(?:{TLD})\b(?!-)", re.I)
SPOKEN_PART = re.compile(r"(?: at |@ ?)[A-Za-z0-9-]+(?: dot | \. |\.)", re.I)  # a part of each match of SPOKEN, quick to look for
# Fixed value: local parts that are no words, before a plain "at" and a domain with plain dots ("look at example.com").
HANDLE = re.compile(r"(?<![A-Za-z0-9._%+-])(?:[A-Za-z][A-Za-z0-9%+-]*(?:[._][A-Za-z0-9%+-]+)+|[A-Za-z]+[0-9][A-Za-z0-9]*)\Z")
ENDED = re.compile(rf"(?:[A-Za-z0-9-]+\.)+(?:{TLD}) \. ", re.I)  # a plain domain and the end of a sentence
SPOKEN_DOT = re.compile(r" dot | \. |\.", re.I)


@lru_cache(maxsize=1)
def homoglyphs() -> dict[int, str]:
    """One character for one: compatibility forms of visible ASCII, by rule, and the letters alike."""
    found = {c: x for c in range(0x80, 0x20000) if not 0xD800 <= c < 0xE000 and len(x := unicodedata.normalize("NFKC", chr(c))) == 1 and " " <= x <= "~"}
    found |= {c: str(unicodedata.digit(chr(c))) for c in range(0x80, 0x20000) if unicodedata.category(chr(c)) == "Nd"}
    found |= {0x2010: "-", 0x2011: "-", 0x2012: "-", 0x2013: "-", 0x2212: "-", 0x2024: ".", 0x3002: ".", 0xFF61: "."}
    return found | {ord(a): b for a, b in ALIKE.items()}


def emails(text: str) -> list[Span]:
    """From each @, back over the local part and on over the domain: the leftmost matches, without retries."""
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        domain = DOMAIN.match(text, at + 1) if at > last and text[at - 1] in LOCAL else None
        if domain:
            start = at
            while start > last and text[start - 1] in LOCAL:
                start -= 1
            out.append((start, last := domain.end()))
        at = text.find("@", max(last, at + 1))
    return out


def ips(text: str) -> list[Span]:
    small = lambda part: len(x := part.lstrip("0")) <= 3 and int(x or "0") <= 255
    return [m.span() for m in IP.finditer(text) if all(map(small, m[0].split(".")))]


def luhn(digits: str) -> bool:
    double = sum(sum(divmod(2 * int(x), 10)) for x in digits[-2::-2])
    return (double + sum(map(int, digits[-1::-2]))) % 10 == 0


def cards(text: str) -> list[Span]:
    out = []
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if len(digits) <= 19 and luhn(digits):
            out.append(m.span())
    return out


def phones(text: str) -> list[Span]:
    return [m.span() for m in PHONE.finditer(text) if 9 <= sum(map(str.isdigit, m[0])) <= 15] if "+" in text else []


DETECT = dict(zip(KINDS, (emails, ips, cards, phones), strict=True))


def rewritings(text: str) -> list[tuple[int, int, str]]:
    """(start, end, what it stands for) of the disguised pieces, in order, apart from each other."""
    low, found = text.lower(), []
    if BRACKETED.search(text):
        found += [(*m.span(), "@") for m in AT.finditer(text)]
        found += [(*m.span(), ".") for m in DOT.finditer(text)]
    if SPOKEN_PART.search(text):
        for m in SPOKEN.finditer(text):
            if m[1] == "@" and m[2].count(".") and (" " not in m[2] or ENDED.match(m[2])):
                continue
            if m[1].lower() == " at " and " " not in m[2] and not HANDLE.search(text[max(0, m.start() - 64) : m.start()]):
                continue
            found.append((*m.span(1), "@"))
            found += [(m.start(2) + x.start(), m.start(2) + x.end(), ".") for x in SPOKEN_DOT.finditer(m[2])]
    if sum(map(low.count, DIGITS)) >= 4 and RUN_START.search(low):
        for m in RUN.finditer(text):
            for x in RUN_PART.finditer(text, *m.span()):
                word = x[0].lower().strip(" ,-")
                found.append((*x.span(), DIGITS.get(word) or {"plus": "+", "dot": ".", "point": "."}.get(word, "")))
    found.sort()
    apart, last = [], 0
    for x in found:
        if x[0] >= last:
            apart.append(x)
            last = x[1]
    return apart


def added(text: str, base: dict[str, list[Span]]) -> dict[str, list[Span]]:
    """Spans of disguised identifiers, in source characters."""
    folded = text if text.isascii() else text.translate(homoglyphs())
    pieces = rewritings(folded)
    if not pieces and folded == text:
        return {}
    parts: list[str] = []
    norm, source = [0], [0]  # where each piece begins; odd pieces are rewritten
    at = place = 0
    for start, end, to in pieces:
        for part, here in ((folded[at:start], start), (to, end)):
            parts.append(part)
            place += len(part)
            norm.append(place)
            source.append(here)
        at = end
    parts.append(folded[at:])
    normal = "".join(parts)
    out = {}
    for kind, detect in DETECT.items():
        taken, new = base[kind], []
        starts = [a for a, _ in taken]
        for start, end in detect(normal):
            i, j = bisect_right(norm, start) - 1, bisect_right(norm, end - 1) - 1
            s = source[i] if i % 2 else source[i] + start - norm[i]
            e = source[j + 1] if j % 2 else source[j] + end - norm[j]
            k = bisect_right(starts, s) - 1
            if text[s:e] != normal[start:end] and not (k >= 0 and e <= taken[k][1]):
                new.append((s, e))
        if new:
            out[kind] = new
    return out


def spans(text: str | None) -> list[dict]:
    """All spans by kind, then start."""
    text = text or ""
    base = {kind: detect(text) for kind, detect in DETECT.items()}
    more = added(text, base)
    return [{"kind": kind, "start": s, "end": e, "base": own} for kind in KINDS for s, e, own in sorted([(*x, True) for x in base[kind]] + [(*x, False) for x in more.get(kind, ())])]


def find(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, spans) for each row; offsets in code points, ends exclusive."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())]))
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([spans(x.as_py()) for x in batch.column(1)], kind)], names=[id_col, "spans"])

    kind = df.select(F.col(id_col)).schema[0].dataType.simpleString()
    return df.select(id_col, F.col(text_col).cast("string")).mapInArrow(run, f"`{id_col}` {kind}, spans {SPANS}")


def masked_text(text: str | None) -> str | None:
    """The text with each stretch of personal data replaced by the kind of its first span, in capitals and brackets."""
    found = sorted((x["start"], x["end"], x["kind"]) for x in spans(text))
    if not found:
        return text
    out, at = [], 0
    for start, end, kind in found:
        if start >= at:
            out += [text[at:start], f"<{kind.upper()}>"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def mask(df: DataFrame, text_col: str = "text") -> DataFrame:
    """df with personal data replaced in its texts; all other columns and the order of columns stay."""
    schema = df.schema
    k = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = pa.array([masked_text(x.as_py()) for x in batch.column(k)], pa.string())
            yield batch.set_column(k, batch.schema.names[k], texts)

    return df.mapInArrow(run, schema)


def joined(of: Column) -> Column:
    return F.array_join(F.transform(of, lambda x: F.concat_ws(":", x.kind, x.start.cast("string"), x.end.cast("string"))), ",")


def digests(found: DataFrame) -> DataFrame:
    """n_ columns and base_sha256 tell of base spans; spans lists all, n_added counts those that the method adds."""
    own = lambda kind: lambda x: x.base & (x.kind == kind)
    count = lambda test: F.size(F.filter("spans", test)).cast("long")
    return found.select(
        "doc_id",
        *(count(own(kind)).alias(f"n_{kind}") for kind in KINDS),
        F.sha2(joined(F.filter("spans", lambda x: x.base)), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
        count(lambda x: ~x.base).alias("n_added"),
    )


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    return digests(find(table(spark, sf_dir, "documents")))
