"""Operators on single texts: tokens, personal data, media."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from isobar.llm import bpe, media, pii

from .conftest import documents


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(bpe.default_vocabulary())


@pytest.fixture(scope="module")
def own():
    return bpe.loaded(bpe.default_vocabulary())


def test_bpe_matches_library_on_odd_texts(library, own):
    letters = "ab  \n\t'sS1é́　\U0001f600\x00\x1c\x85 €ñ.,!-"
    r = random.Random(5)
    texts = ["".join(r.choices(letters, k=r.randint(0, 60))) for _ in range(3000)]
    texts += ["", " ", "a" * 4000, "ab" * 3000, "<|endoftext|>", "x<|endoftext|> y", "<|endoftext|><|endoftext|>", "it's I'LL we'd"]
    found = own.encode_many(texts)
    for text, ids in zip(texts, found, strict=True):
        want = library.encode(text, add_special_tokens=False).ids
        assert ids.tolist() == want, text
    ends = np.cumsum([len(x) for x in found])
    assert own.decode_many(np.concatenate(found), ends) == [library.decode(x.tolist(), skip_special_tokens=False) for x in found]


def test_bpe_decodes_broken_and_unknown_ids(library, own):
    ids = [200, 201, 94, 50256, 300]
    assert own.decode_many(np.array([*ids, -1, 10**6]), np.array([5, 7])) == [library.decode(ids, skip_special_tokens=False), ""]


def test_bpe_long_words_as_short_ones(own):
    r = random.Random(1)
    for _ in range(300):
        word = "".join(r.choices("abcdeinrst ", k=r.randint(2, 60))).encode()
        start = [own.of_byte[b] for b in word]
        assert own.merge_long([*start]) == own.merge(word)


def test_bpe_cache_moves_on(library):
    cache = bpe.Cache(400)
    cache.learn([("a", b"1"), ("b", b"2"), ("c", b"3")])
    cache.trimmed()
    assert not cache and cache.missing(["a", "d"]) == ["d"] and cache == {"a": b"1"}
    for _ in range(3):
        cache.learn((str(k), b"1234") for k in range(10))
        cache.trimmed()
    assert cache.held <= 400 and len(cache.old) == 10
    small = bpe.Bpe(bpe.default_vocabulary())
    small.words, small.spaced = bpe.Cache(300), bpe.Cache(300)
    texts = [" ".join(f"{w}{k % 7}{e}" for k, w in enumerate("the cat sat on a mat and ǅ º ª ሀ slept".split())) for e in ("", ".", ",\nThe", "ñ")] * 2
    for text in texts:  # every batch empties the caches
        assert small.encode_many([text])[0].tolist() == library.encode(text, add_special_tokens=False).ids


def test_bpe_query(docs, no_docs, library):
    found = bpe.digests(docs).collect()
    want = sorted((-1 if i is None else i, library.encode(t or "", add_special_tokens=False).ids, t or "") for i, t, *_ in documents())
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in found)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert got == [(i, len(ids), sha(",".join(map(str, ids))), sha(t)) for i, ids, t in want]
    assert bpe.digests(no_docs).count() == 0
    two = {r.doc_id: (r.ids, r.decoded) for r in bpe.decode(bpe.encode(docs)).collect()}
    assert two == {r.doc_id: (r.ids, r.decoded) for r in bpe.round_trip(docs).collect()}


PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def brute_spans(text):
    out = []
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, text):
            digits = [int(c) for c in m[0] if c.isdigit()]
            luhn = sum(sum(divmod(2 * x, 10)) if k % 2 else x for k, x in enumerate(reversed(digits))) % 10 == 0
            good = {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else False, "card": 13 <= len(digits) <= 19 and luhn, "phone": 9 <= len(digits) <= 15}[kind]
            if good:
                out.append((kind, *m.span()))
    return out


def test_pii_base_is_the_patterns():
    r = random.Random(2)
    for n in range(20_000):
        text = "".join(r.choices("ab.@-_ 0123456789+()é" if n % 2 else "0 4-.+1@a", k=r.randint(0, 40)))
        assert [(x["kind"], x["start"], x["end"]) for x in pii.spans(text) if x["base"]] == brute_spans(text), text


@pytest.mark.parametrize(
    ("text", "kind", "span"),
    [
        ("mail john [at] x [dot] com. Then", "email", "john [at] x [dot] com"),
        ("write jane.doe at example dot com now", "email", "jane.doe at example dot com"),
        ("call plus one five five five one two three four five six seven ok", "phone", "plus one five five five one two three four five six seven"),
        ("ip one nine two dot one six eight dot one dot two end", "ip", "one nine two dot one six eight dot one dot two"),
        ("ｊｏｅ＠ｅｘａｍｐｌｅ．ｃｏｍ", "email", "ｊｏｅ＠ｅｘａｍｐｌｅ．ｃｏｍ"),
        ("jоhn@exаmple.com", "email", "jоhn@exаmple.com"),
        ("tel +１ ５５５ 123 4567", "phone", "+１ ５５５ 123 4567"),
    ],
)
def test_pii_adds_disguised(text, kind, span):
    added = [(x["kind"], text[x["start"] : x["end"]]) for x in pii.spans(text) if not x["base"]]
    assert (kind, span) in added
    assert pii.masked_text(text) == text.replace(span, f"<{kind.upper()}>")


@pytest.mark.parametrize("text", ["we met at noon", "look at example.com", "one or two or three", "Привет, мир", "it was (at) last (dot)", "seven eight nine", "", None])
def test_pii_leaves_prose(text):
    assert pii.spans(text) == [] and pii.masked_text(text) == text


@pytest.mark.parametrize("opening, closing", ["[]", "()", "{}", "<>", "[)"])
@pytest.mark.parametrize("before", ["", " "])
@pytest.mark.parametrize("inner", ["", " "])
@pytest.mark.parametrize("after", ["", " "])
def test_pii_finds_every_bracket_and_spacing(opening, closing, before, inner, after):
    form = lambda x: before + opening + inner + x + inner + closing + after
    for at in ("at", "AT", "@"):
        text = f"john{form(at)}example.com"
        assert [(x["kind"], x["start"], x["end"]) for x in pii.spans(text)] == [("email", 0, len(text))], text
        for dot in ("dot", "Dot", "."):
            text = f"john{form(at)}example{form(dot)}com"
            assert [(x["kind"], x["start"], x["end"]) for x in pii.spans(text)] == [("email", 0, len(text))], text
    for dot in ("dot", "."):
        text = f"john@example{form(dot)}com"
        assert pii.masked_text(text) == "<EMAIL>", text


@pytest.mark.parametrize("more", ["", " and a dot here", " or x @ y", " see @ here"])
def test_pii_at_is_told_by_the_match_alone(more):
    for text in ("john at example.com", "look at example.com"):
        assert pii.masked_text(text + more) == text + more
    for text in ("jane.doe at example.com", "joe99 at example.com", "john at example dot com", "john@example . com"):
        assert pii.masked_text(text + more) == "<EMAIL>" + more


def test_pii_finds_runs_of_common_digits():
    assert pii.masked_text("ip one oh dot oh dot oh dot one end") == "ip <IP> end"


@pytest.mark.parametrize(
    ("text", "base", "span"),
    [
        ("jоhn@example.com", "hn@example.com", "jоhn@example.com"),
        ("john@mail.example [dot] com", "john@mail.example", "john@mail.example [dot] com"),
        ("john@example.cоm", "john@example.c", "john@example.cоm"),
        ("john [dot] doe@example.com", "doe@example.com", "john [dot] doe@example.com"),
        ("10.0.0.1２", "10.0.0.1", "10.0.0.1２"),
    ],
)
def test_pii_adds_spans_longer_than_base(text, base, span):
    found = pii.spans(f"a {text} b")
    assert {(f"a {text} b"[x["start"] : x["end"]], x["base"]) for x in found} == {(base, True), (span, False)}
    tag = f"<{found[0]['kind'].upper()}>"
    assert pii.masked_text(f"a {text} b") == f"a {tag} b"


@pytest.mark.parametrize("text", ["to john@example.com . It works", "(аt) john@example.com, о", "Да: john@example.com"])
def test_pii_adds_nothing_to_plain_spans(text):
    assert [text[x["start"] : x["end"]] for x in pii.spans(text)] == ["john@example.com"]


def test_pii_is_linear():
    for text in ("a" * 200_000, "1" * 100_000, "1." * 50_000, "+1 (" * 20_000, "a@" * 50_000, "1 " * 50_000):
        pii.spans(text)


def test_pii_query(docs, no_docs):
    rows = pii.digests(pii.find(docs)).collect()
    texts = {i: t or "" for i, t, *_ in documents()}
    for r in rows:
        want = brute_spans(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in want).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(x[0] == k for x in want) for k in pii.KINDS]
    assert next(r.n_added for r in rows if r.doc_id == 13) == 1
    assert pii.digests(pii.find(no_docs)).count() == 0
    masked = pii.mask(docs)
    assert masked.columns == docs.columns
    assert [r.text for r in masked.where("doc_id = 13").collect()] == ["mail <EMAIL> or <EMAIL>, <IP>, <PHONE>"]
    assert masked.where("text is null").count() == 1 and pii.mask(no_docs).count() == 0


def plain_unfilter(lines, channels):
    out = np.zeros((len(lines), lines.shape[1] - 1), int)
    for r in range(len(out)):
        for c in range(out.shape[1]):
            a = out[r, c - channels] if c >= channels else 0
            b = out[r - 1, c] if r else 0
            corner = out[r - 1, c - channels] if r and c >= channels else 0
            p = a + b - corner
            paeth = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - corner), 2, corner))[2]
            out[r, c] = (int(lines[r, 1 + c]) + [0, a, b, (a + b) // 2, paeth][lines[r, 0]]) % 256
    return out


def test_png_filters():
    r = np.random.default_rng(3)
    for channels in (1, 2, 3, 4):
        lines = r.integers(0, 256, (25, 1 + 5 * channels)).astype(np.uint8)
        lines[:, 0] = r.integers(0, 5, 25)
        assert (media.unfiltered(lines, channels) == plain_unfilter(lines, channels)).all()


def test_png_damage_is_seen():
    png = media.write_png(media.padded("some text")[1])
    for bad in (b"", png[:-5], png[:40] + bytes([png[40] ^ 1]) + png[41:], png[8:]):
        with pytest.raises(ValueError):
            media.read_png(bad)


def test_feature_is_perceptual():
    # every low frequency is there: signs of frequencies that an image lacks would be noise alone
    k, x = np.arange(8)[:, None], np.arange(64)[None, :]
    waves = np.cos(np.pi * k * (2 * x + 1) / 128)
    image = 128 + 6 * (waves.T @ np.random.default_rng(1).normal(size=(8, 8)) @ waves)
    image = np.clip(image, 0, 255)[:, :, None].repeat(3, 2).astype(np.uint8)
    noisy = np.clip(image.astype(int) + np.random.default_rng(0).integers(-2, 3, image.shape), 0, 255).astype(np.uint8)
    bits = lambda x: np.unpackbits(np.frombuffer(bytes.fromhex(media.feature(x)), np.uint8))
    assert (bits(image) != bits(noisy)).sum() <= 8


def test_media_query(docs, no_docs):
    texts = {i: (t or "").encode() for i, t, *_ in documents()}
    rows = media.digests(docs).collect()
    for r in rows:
        raw = texts[r.doc_id]
        payload = raw + b" " * (-len(raw) % 192 if raw else 192)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
    by_text = {}
    for r in rows:
        assert by_text.setdefault(texts[r.doc_id], (r.media_sha256, r.feature, r.media_bytes)) == (r.media_sha256, r.feature, r.media_bytes)
    assert media.digests(no_docs).count() == 0


def plain_feature(pixels):
    """The hash by plain sums: block means, then each low frequency on its own."""
    grey = pixels.sum(axis=2).tolist()

    def means(values):
        n = len(values)
        if n < 32:
            return [values[k * n // 32] for k in range(32)]
        cuts = [k * n // 32 for k in range(33)]
        return [sum(values[a:b]) / (b - a) for a, b in zip(cuts, cuts[1:], strict=False)]

    tall = list(zip(*(means(list(c)) for c in zip(*grey, strict=True)), strict=True))
    small = [means(list(r)) for r in tall]
    wave = lambda k, x: np.cos(np.pi * k * (2 * x + 1) / 64)
    low = [round(sum(small[y][x] * wave(u, y) * wave(v, x) for y in range(32) for x in range(32)), 6) for u in range(8) for v in range(8)]
    middle = sorted(low[1:])[31]
    return f"{int(''.join('1' if x > middle else '0' for x in low), 2):016x}"


@pytest.mark.parametrize("rows", [1, 20, 32, 75])
def test_media_features_are_plain_cosine_sums(rows):
    pixels = np.random.default_rng(rows).integers(0, 256, (rows, 64, 3), dtype=np.uint8)
    assert media.feature(pixels) == plain_feature(pixels.astype(int))


def test_media_inflates_no_more_than_the_header_tells():
    def file(rows, data):
        head = media.chunk(b"IHDR", media.struct.pack(">IIBBBBB", 64, rows, 8, 2, 0, 0, 0))
        return media.SIGNATURE + head + media.chunk(b"IDAT", data) + media.chunk(b"IEND", b"")

    whole = zlib.compress(bytes(193 * 2))
    assert media.read_png(file(2, whole)).shape == (2, 64, 3)
    for rows, data in ((1, whole), (3, whole), (1, zlib.compress(bytes(50_000_000))), (2, whole[:-3]), (2, b"no zlib")):
        with pytest.raises(ValueError, match="PNG"):
            media.read_png(file(rows, data))
