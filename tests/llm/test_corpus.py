"""Operators on the whole corpus: near-duplicates, repeated windows, mixing, quality and the pipeline."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from isobar.llm import minhash, mixing, quality, substring
from isobar.llm.base import screened
from isobar.llm.components import components
from isobar.llm.shingles import words
from isobar.llm.wavelet import Index, repeated

from .conftest import SCHEMA, documents, prose, with_clashes

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_groups(rows, k):
    """(set size, smallest id reachable) by id, comparing all pairs."""
    sets = {}
    for i, t, *_ in rows:
        w = words((t or "").translate(LOWER))
        sets[i] = frozenset(tuple(w[j : j + k]) for j in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])
    label = {i: i for i in sets}
    ids = sorted(i for i in sets if i is not None)
    changed = True
    links = [(a, b) for a in ids for b in ids if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    while changed:
        changed = False
        for a, b in links:
            low = min(label[a], label[b])
            changed |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    return {i: (len(sets[i]), label[i]) for i in sets}


def family():
    """Copies that link in chains and stars, and a group that meets in buckets without links."""
    rows = documents()
    base = prose(50, 90).split(" ")
    for k in range(40):
        w = [*base]
        for j in random.Random(k).sample(range(90), 1 + k % 6):
            w[j] = f"x{k}_{j}"
        rows.append((200 + k, " ".join(w), "en", "a"))
    chain = prose(60, 100).split(" ")
    for k in range(12):
        rows.append((300 + k, " ".join([*chain[k * 4 :], *(f"c{k}_{j}" for j in range(2))]), "en", "a"))
    return rows


@pytest.mark.parametrize("k", [4, 5])
def test_near_duplicates(spark, k):
    rows = family()
    df = with_clashes(spark.createDataFrame(rows, SCHEMA)).repartition(5)
    want = brute_groups(rows, k)
    for r in minhash.near_duplicates(df, k).collect():
        assert (r.n_shingles, r.component_id) == want[r.doc_id], r
        assert r.kept == (r.doc_id == r.component_id or r.doc_id is None)


def test_near_duplicates_of_nothing(no_docs):
    assert minhash.near_duplicates(no_docs).count() == 0


def test_sketch_estimates_similarity():
    r = np.random.default_rng(4)
    for size, shared in ((1000, 800), (40, 32), (5, 4)):
        agree = []
        for _ in range(30):
            both = np.unique(r.integers(0, 2**63, size + (size - shared), dtype=np.uint64))
            a, b = minhash.sketches([np.sort(both[:size]), np.sort(both[size - shared :])])
            assert (a != np.iinfo(np.uint64).max).all()
            agree.append((a == b).mean())
        assert abs(np.mean(agree) - shared / len(both)) < 0.05


def test_blocks_of_a_hot_bucket(spark, monkeypatch):
    """Small blocks and chunks give the same result as large ones."""
    monkeypatch.setattr(minhash, "BLOCK", 4)
    monkeypatch.setattr(minhash, "CHUNK", 3)
    rows = family()
    want = brute_groups(rows, 4)
    found = minhash.near_duplicates(spark.createDataFrame(rows, SCHEMA), 4).collect()
    assert all((r.n_shingles, r.component_id) == want[r.doc_id] for r in found)


def test_intersections_in_parts(monkeypatch):
    r = np.random.default_rng(9)
    sets = [np.unique(r.integers(0, 60, n, dtype=np.uint64)) for n in (5, 40, 80, 1, 30)]
    want = [[len(np.intersect1d(a, b)) for b in sets] for a in sets]
    for hits in (1, 2, 3, 7, 50, 1 << 20):
        monkeypatch.setattr(minhash, "HITS", hits)
        assert [x.tolist() for x in minhash.shared(sets, sets)] == want


def brute_rows(rows, k):
    """(id, text) to (least id of its group, whether the group keeps it): each text of an id is a document, a null id the largest."""
    sets = {}
    for i, t, *_ in rows:
        w = words((t or "").translate(LOWER))
        sets[(i is None, i or 0, t or "")] = frozenset(tuple(w[j : j + k]) for j in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])
    label = {x: x[:2] for x in sets}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    for _ in sets:
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    return {(None if x[0] else x[1], x[2]): label[x] for x in sets}, label


def two_texts():
    """Ids with several texts, some of which others copy; null ids with copies; repeated rows."""
    x, y, z = prose(90, 80), prose(91, 80), prose(92, 80)
    near = " ".join(["other", *x.split(" ")[1:]])
    own = prose(93, 60)
    rows = [(2, x), (5, x), (5, y), (5, y), (7, near), (9, y), (9, z), (9, near), (None, z), (None, own), (None, own), (None, ""), (None, None), (4, ""), (4, None)]
    return [(i, t, "en", "a") for i, t in rows]


def test_near_duplicates_of_ids_with_several_texts(spark):
    want, _ = brute_rows(two_texts(), 5)
    df = spark.createDataFrame(two_texts(), SCHEMA).repartition(3)
    facts = minhash.near_duplicates(df, 5).collect()
    assert len(facts) == len(two_texts())
    names = {(r.doc_id, r.text or ""): (r.rep, r.key) for r in minhash.named(df, "doc_id", "text").collect()}
    by_name = {(r.rep, r.key): r for r in facts}
    for (i, t), (none, least) in want.items():
        r = by_name[names[i, t]]
        assert r.component_id == (None if i is None else least), (i, t)
        assert r.kept == (i is None or r.component_id == i)
        assert r.first == ((i is None, i or 0) == (none, least))


def test_pipeline_keeps_every_distinct_text(spark):
    rows = two_texts()
    got = sorted((repr(r.doc_id), r.text or "") for r in corpus_pipeline.deduplicated(spark, spark.createDataFrame(rows, SCHEMA).repartition(4), "").collect())
    want, _ = brute_rows(rows, 5)
    left = [(repr(i), t) for (i, t), (none, least) in want.items() if (i is None, i or 0) == (none, least)]
    assert got == sorted([*left, ("None", "")])  # both blank rows without an id stay


def test_screen_lets_all_wanted_rows_pass(spark):
    rows = spark.range(-5000, 60_000).select(F.col("id").alias("a"), F.when(F.col("id") % 11 > 0, F.col("id").cast("string")).alias("b"))
    wanted = rows.where("a % 7 = 3")
    found = screened(rows, wanted, ["a", "b"])
    assert found.columns == ["a", "b", "__maybe"] and found.count() == 65_000
    assert found.where("a % 7 = 3 and not __maybe").count() == 0
    assert found.where("a % 7 <> 3 and __maybe").count() < 50  # 9,286 of 67 million places are marked
    assert screened(rows, wanted.limit(0), ["a", "b"]).where("__maybe").count() == 0


def test_components(spark):
    r = random.Random(8)
    pairs = [(r.randrange(300), r.randrange(300)) for _ in range(220)] + [(1000 + k, 1001 + k) for k in range(60)] + [(5000, 5000 + k) for k in range(1, 80)]
    label = {x: x for p in pairs for x in p}
    for _ in range(400):
        for a, b in pairs:
            label[a] = label[b] = min(label[a], label[b])
    found = {x.id: x.component for x in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    linked = {x for a, b in pairs if a != b for x in (a, b)}
    assert found == {x: label[x] for x in linked}


def brute_windows(rows, size=35):
    found = [(i, words(t)) for i, t, *_ in rows]
    count = Counter(tuple(w[s : s + size]) for _, w in found for s in range(len(w) - size + 1))
    out = []
    for i, w in found:
        gone = set()
        for s in range(len(w) - size + 1):
            if count[tuple(w[s : s + size])] > 1:
                gone.update(range(s, s + size))
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((-1 if i is None else i, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def repeats():
    """Passages in many documents, at all offsets, overlapping themselves, and just too short."""
    rows = documents()
    passage = prose(70, 60)
    for k in range(30):
        rows.append((400 + k, f"{prose(500 + k, k)} {passage} {prose(600 + k, 3 * k)}", "en", "a"))
    rows.append((500, "la " * 100, "en", "a"))
    rows.append((501, f"{prose(80, 34)} q {prose(80, 34)}", "en", "a"))
    rows.append((502, f"{prose(81, 35)} q {prose(81, 35)} {prose(81, 36)}", "en", "a"))
    return rows


@pytest.mark.parametrize(("hot", "shard"), [(substring.HOT, substring.SHARD), (2, 500)])
def test_substrings(spark, monkeypatch, hot, shard):
    monkeypatch.setattr(substring, "HOT", hot)
    monkeypatch.setattr(substring, "SHARD", shard)
    rows = repeats()
    found = substring.without_repeats(with_clashes(spark.createDataFrame(rows, SCHEMA)).repartition(6), texts=True).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in found) == brute_windows(rows)
    assert all(hashlib.sha256(r.kept.encode()).hexdigest() == r.kept_sha256 for r in found)


@pytest.mark.parametrize("hot", [substring.HOT, 1])
def test_substrings_of_many_equal_rows(spark, monkeypatch, hot):
    """What equal rows are told, and what they index, doesn't grow with their number."""
    monkeypatch.setattr(substring, "HOT", hot)
    text, other = prose(30, 120), f"{prose(31, 20)} {' '.join(prose(30, 120).split(' ')[30:80])} {prose(32, 20)}"
    rows = [(1, text, "en", "a")] * 400 + [(None, text, "en", "a")] * 300 + [(2, other, "en", "a")]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    marks = substring.told(substring.segmented(substring.located(df, "doc_id", "text"))).collect()
    assert max(len(r.marks) for r in marks) < 40
    found = substring.without_repeats(df).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in found) == brute_windows(rows)


def test_substrings_of_nothing(no_docs):
    assert substring.without_repeats(no_docs).count() == 0


def test_backward_search():
    r = np.random.default_rng(0)
    for _ in range(100):
        parts = [r.integers(1, r.integers(3, 9), r.integers(5, 14)) for _ in range(r.integers(2, 9))]
        symbols = np.concatenate([[*p, 0] for p in parts])
        stops = np.cumsum([len(p) + 1 for p in parts]) - 1
        got = {(d, s) for d, a, b in repeated(Index(symbols, 10), symbols, stops - [len(p) for p in parts], stops, 5) for s in range(a, b + 1)}
        count = Counter(tuple(p[s : s + 5]) for p in parts for s in range(len(p) - 4))
        assert got == {(d, s) for d, p in enumerate(parts) for s in range(len(p) - 4) if count[tuple(p[s : s + 5])] > 1}


def plan_targets(sizes):
    """Targets by repeated resharing."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    total, full = sum(sizes.values()), {}
    while True:
        rest = [s for s in order if s not in full]
        share = (total - sum(full.values())) / sum(weight[s] for s in rest) if rest else 0
        over = [s for s in rest if share * weight[s] > 3 * sizes[s]]
        if not over:
            return {s: full.get(s, share * weight[s]) for s in order}
        full |= {s: 3 * sizes[s] for s in over}


def mixed_rows(df):
    sizes = mixing.slim(df)
    found = mixing.counted(sizes, sizes, "id", "source", F.col("size"))
    return found.select("id", "source", "size", "__source_size", "__target", "__copies").collect()


def test_mixing(spark, docs, no_docs, monkeypatch):
    rows = mixed_rows(docs)
    sizes = defaultdict(int)
    for _, t, _, s in documents():
        sizes[s] += len(words(t))
    goals = plan_targets(sizes)
    for r in rows:
        assert r["__source_size"] == sizes[r.source] and r["__target"] == pytest.approx(goals[r.source])
        assert 0 <= r["__copies"] <= 3
    assert len(rows) == len(documents()) and mixed_rows(no_docs) == []
    monkeypatch.setattr(mixing, "CELL_ROWS", 2)  # more cells, the same order
    assert sorted(map(repr, mixed_rows(docs))) == sorted(map(repr, rows))


def test_mix_comes_near_its_targets(spark):
    r = random.Random(0)
    rows = [(k, "w " * int(2 ** r.uniform(0, 9)), "en", "abcdef"[min(5, int(r.expovariate(0.9)))]) for k in range(3000)]
    found = mixed_rows(spark.createDataFrame(rows, SCHEMA))
    taken, goals = defaultdict(int), {}
    for x in found:
        taken[x.source] += x["__copies"] * x.size
        goals[x.source] = x["__target"]
    for s, goal in goals.items():
        assert taken[s] == pytest.approx(goal, rel=0.05, abs=600)


def test_mix_repeats_rows(spark, docs, no_docs):
    out = mixing.mix(docs)
    copies = Counter()
    for x in mixed_rows(docs):
        copies[x.id] += x["__copies"]
    assert out.columns == docs.columns
    assert Counter(r.doc_id for r in out.collect()) == +copies
    assert mixing.mix(no_docs).count() == 0


def rated_corpus(spark):
    r, rows, labels = random.Random(3), [], []
    for k in range(600):
        text = prose(k, 80).split(" ")
        toxic, low = k % 5 == 0, k % 7 == 0
        if toxic:
            for _ in range(3):
                text[r.randrange(80)] = r.choice(["vile", "scum"])
        if low:
            text = [w.upper() + "!!" for w in text]
        rows.append((k, " ".join(text), "en", "a"))
        labels.append((k, int(not low), int(toxic)))
    return spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_quality_on_held_out(spark):
    docs, labels = rated_corpus(spark)
    model = quality.train(docs, labels.where("doc_id < 400"))
    assert (np.diff(model.thresholds) > 0).all()
    truth = {r.doc_id: (r.quality, r.toxic) for r in labels.collect()}
    right = [(r["__tail"] >= quality.KEEP) == (truth[r.doc_id] == (1, 0)) for r in quality.rate(docs.where("doc_id >= 400"), model).collect()]
    assert np.mean(right) > 0.95


def test_quality_learns_rare_words_of_small_samples():
    plain = [f"some usual words number w{k} here" for k in range(84)]
    toxic = [f"some usual words number w{k} here scum" for k in range(84, 87)]
    model = quality.fit([quality.features(x) for x in plain + toxic], np.array([2] * 84 + [0] * 3))
    score = model.score([quality.features(x) for x in ("some usual words number w1 here", "some usual words number w1 here scum")])
    with_word, without = score[1], score[0]
    assert with_word < without - 0.5


def plain_loss(weights, thresholds, places, grades, each):
    """Cumulative-link likelihood, row by row."""
    out = quality.DECAY / 2 * sum(float(w) ** 2 for w in weights)
    edges = [-np.inf, *thresholds, np.inf]
    for p, g, e in zip(places, grades, each, strict=True):
        s = sum(float(weights[k]) for k in p)
        out -= e * np.log(1 / (1 + np.exp(s - edges[g + 1])) - 1 / (1 + np.exp(s - edges[g])))
    return out


def test_quality_likelihood_and_gradient():
    r = np.random.default_rng(6)
    places = [np.unique(r.integers(0, 9, r.integers(1, 6))) for _ in range(30)]
    grades, each = r.integers(0, 3, 30), r.random(30)
    w, cuts = r.normal(size=9), np.array([-0.7, 1.3])
    sums = lambda x: np.array([x[p].sum() for p in places])
    back = lambda x: np.bincount(np.concatenate(places), np.repeat(x, [len(p) for p in places]), 9)
    loss, by_w, by_cuts = quality.likelihood(w, cuts, sums, back, grades, each)
    plain = lambda w, cuts: plain_loss(w, np.cumsum(cuts), places, grades, each)
    assert loss == pytest.approx(plain(w, cuts))
    step = 1e-6
    for k in range(9):
        d = np.eye(9)[k] * step
        assert by_w[k] == pytest.approx((plain(w + d, cuts) - plain(w - d, cuts)) / (2 * step), abs=1e-5)
    for k in range(2):
        d = np.eye(2)[k] * step
        assert by_cuts[k] == pytest.approx((plain(w, cuts + d) - plain(w, cuts - d)) / (2 * step), abs=1e-5)


def test_quality_fit_finds_a_minimum():
    texts = [quality.features(f"{prose(k, 30)} {'vile scum' if k % 5 == 0 else 'kind word'}") for k in range(120)]
    grades = np.array([0 if k % 5 == 0 else 1 + k % 2 for k in range(120)])
    model = quality.fit(texts, grades)
    counts = np.bincount(grades)
    each = np.sqrt(counts.sum() / counts)[grades]
    each /= each.sum()
    seen = np.bincount(np.concatenate(texts), minlength=quality.DIM) >= quality.LEAST_TEXTS
    used = np.flatnonzero(seen)
    small = [np.searchsorted(used, p[seen[p]]) for p in texts]
    best = plain_loss(model.weights[used], model.thresholds, small, grades, each)
    assert not model.weights[~seen].any() and best < plain_loss(np.zeros(len(used)), model.thresholds, small, grades, each)
    r = np.random.default_rng(0)
    for _ in range(20):
        nudged = model.weights[used] + r.normal(size=len(used)) * 0.02
        assert plain_loss(nudged, model.thresholds, small, grades, each) > best


def test_quality_scores_are_plain_sums(spark):
    docs, labels = rated_corpus(spark)
    model = quality.train(docs, labels, 60)
    for r in quality.rate(docs.where("doc_id < 25"), model).collect():
        s = sum(float(model.weights[k]) for k in set(quality.features(r.text).tolist()))
        above = [1 / (1 + np.exp(t - s)) for t in model.thresholds]
        assert r["__expected"] == pytest.approx(sum(above), abs=2e-6) and r["__tail"] == pytest.approx(above[-1], abs=1e-6)


def test_quality_sample_is_bounded_whatever_repeats(spark, monkeypatch):
    rows = [(1, prose(k % 3, 40), "en", "a") for k in range(300)] + [(k, prose(k, 40), "en", "a") for k in range(2, 12)]
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(1, 12)], "doc_id long, quality int, toxic int")
    seen = []
    monkeypatch.setattr(quality, "fit", lambda places, grades: seen.append((len(places), len(grades))))
    quality.train(spark.createDataFrame(rows, SCHEMA).repartition(4), labels, 8)
    quality.train(spark.createDataFrame(rows, SCHEMA).repartition(4), labels)
    assert seen == [(8, 8), (11, 11)]


def test_quality_edges(spark, docs, no_docs):
    labels = spark.createDataFrame([(1, 1, 0), (1, 1, 1), (None, 1, 0), (3, None, 1), (4, 0, None), (999, 1, 0), (8, 0, 0), (13, 1, 0)], "doc_id long, quality int, toxic int")
    assert sorted((r.doc_id, r.grade) for r in quality.grades(labels).collect()) == [(1, 1), (8, 1), (13, 2), (999, 2)]
    kept = quality.select(docs, labels)
    assert kept.columns == docs.columns
    none = quality.select(docs, labels.limit(0))
    assert none.count() == len(documents())
    assert quality.select(no_docs, labels).count() == 0


def test_quality_fit_is_repeatable(spark):
    docs, labels = rated_corpus(spark)
    a, b = quality.train(docs, labels, 100), quality.train(docs.repartition(7), labels.repartition(3), 100)
    assert np.allclose(a.weights, b.weights) and np.allclose(a.thresholds, b.thresholds)


def test_pipeline(spark, tmp_path, docs):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "near_dedup", "personal_data", "mixing", "tokens"]
    at = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, at, str(tmp_path))
        if name == "near_dedup":
            left = [r.doc_id for r in out.collect()]
            groups = brute_groups([(r.doc_id, r.text) for r in at.collect()], 5)
            ids = {r.doc_id for r in at.collect()}
            assert sorted(x for x in left if x is not None) == sorted({groups[i][1] for i in ids if i is not None})
        if name != "tokens":
            assert out.columns == at.columns
        out.write.parquet(f"{tmp_path}/{name}")
        at = spark.read.parquet(f"{tmp_path}/{name}")
    want = sorted(map(repr, at.collect()))
    assert sorted(map(repr, corpus_pipeline.run(spark, str(tmp_path)).collect())) == want
