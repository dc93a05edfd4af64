"""Defined cases of the training-data operators, and brute-force versions on small tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import ann, common, components, decontam, html, langid, mixing, neardup, quality, substring, suffixes, tokens
from tidemark.llm.queries import tokenizer_path

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, k bigint"  # clashing names too
WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def docs_of(spark, texts, lang="en", source="s"):
    rows = [(i, t, lang, source, len(t or ""), 0.5, 7) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS).repartition(3)


def prose(rnd, n, vocabulary=400):
    return " ".join(f"w{int(vocabulary * rnd.random() ** 2)}" for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    """Texts with shared passages, near and exact copies, runs, nulls, empties and one long text."""
    rnd = random.Random(5)
    texts = [prose(rnd, rnd.randrange(1, 300)) for _ in range(40)]
    passage = prose(rnd, 60)
    for i in range(0, 12):
        texts[i] = f"{prose(rnd, 20)} {passage if i % 2 else ' '.join(passage.split()[i:50])} {prose(rnd, 30)}"
    base = prose(rnd, 200).split()
    for _ in range(8):
        w = list(base)
        for _ in range(5):
            w[rnd.randrange(len(w))] = "edit%d" % rnd.randrange(1000)
        texts.append(" ".join(w))
    texts += [texts[0], texts[0], None, "", " \t\n", "a", "a " * 80, "a " * 50 + "b " + "a " * 70, "é" * 900, "é" * 500 + "x", "tab\tnew\nline\x0bform\x0cfeed " * 20]
    texts.append(prose(rnd, 30000, 5000) + " " + passage)
    return texts


def brute_words(texts, n):
    words = [WORD.findall((t or "").encode()) for t in texts]
    seen = Counter(tuple(w[i : i + n]) for w in words for i in range(len(w) - n + 1))
    out = []
    for w in words:
        gone = [False] * len(w)
        for i in range(len(w) - n + 1):
            if seen[tuple(w[i : i + n])] > 1:
                gone[i : i + n] = [True] * n
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        out.append((len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return out


def test_substring_matches_brute_force(spark, corpus):
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring.removal_digest(docs_of(spark, corpus)).collect()}
    assert [got[i] for i in range(len(corpus))] == brute_words(corpus, 35)


def test_substring_pieces_give_the_same(monkeypatch, corpus):
    texts = [t for t in corpus if t]
    raw = [t.encode() for t in texts]
    buf, offsets = np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])])

    def keys_by_window(units):
        return {(t, p): u for t, u, f, e in zip(units.text, units.u, units.first, units.last) for p in range(f, e + 1)}

    whole = keys_by_window(substring.word_units(buf, offsets))
    monkeypatch.setattr(substring, "PIECE", 64)
    assert keys_by_window(substring.word_units(buf, offsets)) == whole


def brute_bytes(texts, n):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(hashlib.md5(t[i : i + n]).digest() for t in raw for i in range(len(t) - n + 1))
    out = []
    for t in raw:
        edge = np.zeros(len(t) + 1, int)
        for i in range(len(t) - n + 1):
            if seen[hashlib.md5(t[i : i + n]).digest()] > 1:
                edge[i] += 1
                edge[i + n] -= 1
        gone = np.cumsum(edge[:-1]) > 0
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((len(t), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(t, np.uint8)[~gone].tobytes()).hexdigest()))
    return out


@pytest.mark.parametrize("most", [2000, 1])
def test_suffixes_match_brute_force(spark, corpus, most):
    """With ``most`` = 1 every bucket is compared by fingerprints instead of sorting."""
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixes.removal_digest(docs_of(spark, corpus), most=most, block_bytes=20_000).collect()}
    assert [got[i] for i in range(len(corpus))] == brute_bytes(corpus, 400)


def test_crowded_buckets_go_through_the_texts_once(spark, monkeypatch):
    """Buckets of few and of many contents are settled from the same contents."""
    rng, passes = random.Random(5), []
    passage = "".join(rng.choice("abcdefgh ") for _ in range(900))
    texts = ["".join(rng.choice("ijklmnop ") for _ in range(300)) + passage[k * 20 : 450 + k * 30] for k in range(12)]
    texts += [t[:650] for t in texts[:3]]
    monkeypatch.setattr(suffixes, "with_speakers", lambda *a, f=suffixes.with_speakers: passes.append(1) or f(*a))
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixes.removal_digest(docs_of(spark, texts), most=4).collect()}
    assert len(passes) == 1 and [got[i] for i in range(len(texts))] == brute_bytes(texts, 400)


def test_difference_cover():
    for v in (8, 32, 64):
        d = suffixes.difference_cover(v)
        assert {(a - b) % v for a in d for b in d} == set(range(v)) and len(d) < v / 2 + 2


def test_kept_texts(spark, corpus):
    docs = docs_of(spark, corpus)
    for r in substring.remove_repeats(docs).collect():
        assert len(r.kept.split()) == r.n_words - r.n_removed
    for r in suffixes.remove_repeats(docs).collect():
        assert len(r.kept) == r.n_bytes - r.n_removed


def brute_components(rows, n, threshold):
    """rows: (doc_id, text)."""
    sets = []
    for _, t in rows:
        w = WORD.findall((t or "").encode().lower() if (t or "").isascii() else re.sub(rb"[A-Z]", lambda m: m[0].lower(), (t or "").encode()))
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if rows[i][0] == rows[j][0] or sets[i] and 100 * len(sets[i] & sets[j]) >= round(threshold * 100) * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        least[find(i)].append(d)
    return sorted((d, len(sets[i]), min(least[find(i)])) for i, (d, _) in enumerate(rows))


def test_near_duplicates_match_brute_force(spark, corpus):
    rnd = random.Random(9)
    base = prose(rnd, 120, 5000).split()
    chain = []
    for i in range(25):  # neighbours are similar, the ends are not
        base = list(base)
        for _ in range(4):
            base[rnd.randrange(len(base))] = f"c{i}x{rnd.randrange(99)}"
        chain.append(" ".join(base).upper() if i % 5 == 0 else " ".join(base))
    texts = corpus[:-1] + chain
    for n in (2, 5):
        got = neardup.near_duplicates(docs_of(spark, texts), n, 0.8).collect()
        assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute_components(list(enumerate(texts)), n, 0.8)
        assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_near_duplicates_of_repeated_and_null_ids(spark):
    t = ["a b c d e f", "g h i j k l", "m n o p q r"]
    rows = [(1, t[0]), (1, t[1]), (5, t[1]), (7, t[2]), (7, t[2]), (None, t[2]), (9, None)]
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), 2, 0.8).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0) for r in got) == [(0, 0), (1, 1), (1, 1), (5, 1), (7, 0), (7, 0), (9, 9)]
    left = neardup.deduplicated(spark.createDataFrame(rows, "doc_id bigint, text string"), 2).collect()
    assert sorted((r.doc_id or 0) for r in left) == [0, 1, 9]


def test_rare_token_pairs_are_complete(spark):
    rnd = random.Random(2)
    sets = [sorted(rnd.sample(range(60), rnd.randrange(5, 40))) for _ in range(60)]
    for i in range(0, 60, 3):
        sets[i] = sets[i + 1][:-1] if len(sets[i + 1]) > 5 else sets[i + 1]
    frame = spark.createDataFrame([(i, len(s), s) for i, s in enumerate(sets)], "node bigint, size bigint, shingles array<bigint>")
    members = spark.createDataFrame([(0, i, i) for i in range(60)], "band bigint, node bigint, component bigint")
    pairs = {(r.a, r.b) for r in neardup.rare_token_pairs(members, frame, 0.8).collect()}
    want = {(i, j) for j in range(60) for i in range(j) if 100 * len(set(sets[i]) & set(sets[j])) >= 80 * len(set(sets[i]) | set(sets[j]))}
    assert want <= pairs


def test_sketches_estimate_and_merge():
    rng = np.random.default_rng(3)
    x = rng.integers(0, 2**63, 1200, dtype=np.uint64)
    for shared in (0, 300, 800):
        a, b = x[:800], x[800 - shared : 1600 - shared][:800]
        k = neardup.sketches(np.concatenate([a, b]), np.array([len(a), len(b)]))
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        assert abs(neardup.likely_similarity(k[:1], k[1:], np.array([float(len(a))]), np.array([float(len(b))]))[0] - true) < 0.12
        both = neardup.sketches(np.union1d(a, b), np.array([len(np.union1d(a, b))]))
        assert (np.maximum(k[0], k[1]) == both[0]).all()


def test_components(spark):
    rnd = random.Random(4)
    edges = [(i, i + 1) for i in range(0, 60)] + [(rnd.randrange(100, 140), rnd.randrange(100, 140)) for _ in range(25)] + [(200, 201), (5, 5)]
    root = list(range(300))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    want = {i: find(i) for e in edges if e[0] != e[1] for i in e}
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == want


def test_nearest_neighbours_small_tables_are_exact(spark):
    rng = np.random.default_rng(1)
    v = rng.standard_normal((300, 12)).astype(np.float32)
    v[100:160] = v[7]  # a hot vector
    rows = [(i, [float(x) for x in r], 0) for i, r in enumerate(v)]
    rows += [(300, None, 0), (320, [0.0] * 12, 0), (340, [math.nan] * 12, 0), (360, [None] * 12, 0), (380, [1.0, 2.0], 0), (400, [2.0, 1.0], 0), (400, [2.0, 1.0], 0)]
    got = ann.nearest(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, score int"), F.col("vec_id") % 20 == 0, 20).collect()
    by = defaultdict(list)
    for r in sorted(got, key=lambda r: (r.query_id, r["rank"])):
        by[r.query_id].append((r.vec_id, r.score))
    assert set(by) == {*range(0, 300, 20), 380, 400}
    x = v.astype(float)
    for q in range(0, 300, 20):
        s = np.cumsum(x * x[q], axis=1)[:, -1]
        want = sorted((i for i in range(300) if i != q), key=lambda i: (-s[i], i))[:20]
        assert [i for i, _ in by[q]] == want and [t for _, t in by[q]] == [s[i] for i in want]
    assert by[380] == [(400, 4.0)] and by[400] == [(380, 4.0)]


def test_nearest_neighbours_recall(spark):
    rng = np.random.default_rng(2)
    v = rng.standard_normal((12000, 16)).astype(np.float32)
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(v)], "vec_id bigint, embedding array<float>")
    got = defaultdict(set)
    for r in ann.nearest(df, F.col("vec_id") % 400 == 0, 20, sample=4000, least=0).collect():
        got[r.query_id].add(r.vec_id)
    x = v.astype(float)
    hits = []
    for q in range(0, 12000, 400):
        s = x @ x[q]
        s[q] = -np.inf
        hits.append(len(got[q] & set(np.argsort(-s)[:20].tolist())) / 20)
    assert np.mean(hits) >= 0.9


@pytest.mark.parametrize("n", [2000, 12000, 25000])
def test_nearest_neighbours_lists_are_full(spark, n):
    """What the trees miss is replaced by the next best found; some leaves stay closed at each size."""
    v = np.random.default_rng(3).standard_normal((n, 16)).astype(np.float32)
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(v)], "vec_id bigint, embedding array<float>")
    got = Counter(r.query_id for r in ann.nearest(df, F.col("vec_id") % 100 == 0, 20).collect())
    assert got == {q: 20 for q in range(0, n, 100)}


LATIN = {"en": "the of and to in that was his with for", "de": "der die und das nicht ist ein mit von auf", "fr": "le la les des une est dans pour que qui"}


def language_docs(spark, n=120):
    rnd = random.Random(3)
    rows = []
    for i in range(n):
        lang = list(LATIN)[i % 3]
        rows.append((i, " ".join(rnd.choice(LATIN[lang].split()) for _ in range(rnd.randrange(6, 80))), lang))
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string")


def test_language_id(spark):
    train = language_docs(spark)
    model = langid.fit(train)
    assert model.languages == ["de", "en", "fr"]
    tests = [(0, "das ist nicht der mit"), (1, "que dans les des pour"), (2, None), (3, ""), (4, "123 !? 45"), (5, "the of " * 300_000)]
    got = {r.doc_id: r for r in langid.identify(spark.createDataFrame(tests, "doc_id bigint, text string"), model).collect()}
    assert [got[i].lang_pred for i in range(6)] == ["de", "fr", "und", "und", "und", "en"]
    assert all(0 <= r.score <= 1 for r in got.values()) and got[2].score == 0
    none = langid.fit(train.limit(0))
    assert {r.lang_pred for r in langid.identify(train, none).collect()} == {"und"}
    assert langid.identify(train.limit(0), model).count() == 0
    # a long text counts as the sum of its pieces
    text = "abc def ghi " * 100
    whole = langid.bucket_counts(text)
    langid.PIECE, before = 7, langid.PIECE
    parts = sum(np.bincount(langid.grams(langid.code_points(text), n, langid.BUCKETS), minlength=langid.BUCKETS) for n in langid.SIZES)
    langid.PIECE = before
    assert (whole == parts).all()


def brute_bayes(train, texts):
    """Naive Bayes over all n-grams, one n-gram at a time."""
    def grams(text):
        text = text.lower()
        for size in langid.SIZES:
            for i in range(len(text) - size + 1):
                h = size * 0x9E3779B1 & 0xFFFFFFFF
                for c in text[i : i + size]:
                    h = (h ^ ord(c)) * 0x01000193 & 0xFFFFFFFF
                    h ^= h >> 15
                yield h % langid.BUCKETS

    counts, docs = defaultdict(Counter), Counter()
    for text, lang in train:
        if text is not None and lang is not None:
            counts[lang].update(grams(text))
            docs[lang] += 1
    out = []
    for text in texts:
        if not text or not any(c.isalpha() for c in text):
            out.append(("und", 0.0))
            continue
        g = list(grams(text))
        prior = {x: math.log(docs[x] / sum(docs.values())) for x in docs}
        sums = {x: sum(math.log((counts[x][k] + 0.5) / (counts[x].total() + 0.5 * langid.BUCKETS)) for k in g) for x in docs}
        best = max(sorted(docs), key=lambda x: sums[x] + prior[x])
        temper = min(1.0, langid.TEMPER / max(1, len(g)))
        out.append((best, 1 / sum(math.exp(sums[x] * temper + prior[x] - sums[best] * temper - prior[best]) for x in docs)))
    return out


def test_language_id_against_brute_force(spark):
    rnd = random.Random(8)
    letters = {"aa": "abcdeilnorst", "bb": "abcdeilnorsz", "cc": "üöäßéè abc", "rare": "xyzabcde"}
    word = lambda x: "".join(rnd.choice(letters[x]) for _ in range(rnd.randrange(1, 8)))
    train = [(" ".join(word(x) for _ in range(30)), x) for x, n in (("aa", 70), ("bb", 60), ("cc", 20), ("rare", 3)) for _ in range(n)] + [(None, "aa"), ("", "bb"), ("Ab", None)]
    texts = [" ".join(word(rnd.choice(list(letters))) for _ in range(rnd.randrange(1, 40))) for _ in range(150)] + [None, "", "7", "z", "ÀÉ"]
    model = langid.fit(spark.createDataFrame(train, "text string, lang string"))
    langs, scores = langid.score_texts(model, texts)
    want = brute_bayes(train, texts)
    assert langs == [x for x, _ in want]
    assert np.allclose(scores, [s for _, s in want], atol=1e-4)


def test_rare_languages_are_learned_and_found(spark):
    # a bound takes rows of frequent languages only, priors come from all rows
    rows = [(f"the house of {i}", "en") for i in range(2000)] + [("ny hus og sne", "da")] * 2
    model = langid.fit(spark.createDataFrame(rows, "text string, lang string"), max_docs=200)
    assert model.languages == ["da", "en"] and np.allclose(np.exp(model.prior), [2 / 2002, 2000 / 2002])
    assert langid.bound_of([2, 2000], 200) == 198 and langid.bound_of([5, 5], 100) >= 5 and langid.bound_of([], 10) == 10
    # a long text of a rare language is not outvoted by the label shares, however small its lead a gram
    even = np.full((2, langid.BUCKETS), -5.0, np.float32)
    even[0] += 0.05
    close = langid.Model(["da", "en"], even, np.log([1 / 601, 600 / 601]), langid.SIZES)
    assert langid.score_texts(close, ["some words " * 100])[0] == ["da"]
    assert langid.score_texts(close, ["some"])[0] == ["en"]
    # equal posteriors go to the language first by code point
    flat = langid.Model(["da", "en"], np.full((2, langid.BUCKETS), -5.0, np.float32), np.log([0.5, 0.5]), langid.SIZES)
    assert langid.score_texts(flat, ["some"])[0] == ["da"]


def test_null_ids_are_not_held_out(spark, tmp_path):
    from tidemark.llm.queries import op3, op8

    rows = [(i if i < 40 else None, f"word number {i}", "en", "s") for i in range(42)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, i % 2) for i in range(40)] * 3, "doc_id bigint, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    for op, n, k in ((op3, 5, 0), (op8, 3, 1)):
        got = op(spark, str(tmp_path)).collect()
        assert len(got) == 42 and all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % n == k) for r in got)


def test_repeated_labels_count_once(spark):
    labels = spark.createDataFrame([(1, 1), (1, 1), (1, 0), (2, 0), (2, 1), (3, 0), (None, 1), (4, 7)], "doc_id bigint, quality int")
    assert sorted(quality.bounded_sample(labels, 3).collect()) == [(1, 1), (2, 1), (3, 0)]


def test_quality_ranking(spark):
    rnd = random.Random(1)
    good = [prose(rnd, 80).capitalize() + "." for _ in range(60)]
    bad = ["!! ".join(prose(rnd, 60).upper().split()) for _ in range(30)]
    rows = [(i, t, int(i < 60)) for i, t in enumerate(good + bad)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, quality int")
    model = quality.fit(df.where("doc_id % 3 <> 1"))
    held = quality.score(df.where("doc_id % 3 = 1"), model).collect()
    assert all((r.score >= 0.5) == (r.doc_id < 60) for r in held)
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "x" * 3_000_000)], "doc_id bigint, text string")
    assert all(0 <= r.score <= 1 for r in quality.score(odd, model).collect())
    flat = quality.fit(df.limit(0))
    assert {r.score for r in quality.score(df, flat).collect()} == {0.5}
    a, b = (quality.fit(df.repartition(n)).weights for n in (1, 5))
    assert np.allclose(a, b)


def brute_leaks(texts, items, n=10):
    token = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = lambda t: token.findall((t or "").translate(low))
    wins = defaultdict(set)
    for i, t in items:
        w = words(t)
        for s in range(max(1, len(w) - n + 1)) if w else ():
            wins[tuple(w[s : s + n])].add(i)
    out = []
    for t in texts:
        w, hit, found = words(t), set(), set()
        for size in {len(x) for x in wins}:
            for s in range(len(w) - size + 1):
                if tuple(w[s : s + size]) in wins:
                    hit.update(range(s, s + size))
                    found |= wins[tuple(w[s : s + size])]
        out.append((len(w), len(hit), sorted(map(str, found))))
    return out


def test_decontamination_matches_brute_force(spark, corpus):
    texts = [*corpus, "Punctuated, WORDS; here: one-two three/four five six seven eight nine ten!", "short item", "x short ITEM y"]
    items = [(1, " ".join(corpus[0].split()[5:40])), (2, "one two three four five six seven eight nine ten"), (3, "short item"), (4, None), (5, "..."), (6, "absent words only"), (2, "a a a"), (10, corpus[-1][200:400])]
    docs, bench = docs_of(spark, texts), spark.createDataFrame(items, "item_id bigint, text string")
    got = {r.doc_id: (r.n_words, r.n_hit, r.item_ids) for r in decontam.contamination(docs, bench).collect()}
    assert [got[i] for i in range(len(texts))] == brute_leaks(texts, items)
    clean = {r.doc_id for r in decontam.uncontaminated(docs, bench).collect()}
    assert clean == {i for i, x in got.items() if x[1] == 0}
    assert decontam.uncontaminated(docs, bench).columns == docs.columns
    assert not any(r.contaminated for r in decontam.contamination(docs, bench.limit(0)).collect())
    assert decontam.contamination(docs.limit(0), bench).count() == 0


def test_proximity_matches(spark):
    docs = spark.createDataFrame([(1, "alpha x x beta x gamma"), (2, "alpha " + "x " * 30 + "beta gamma"), (3, "gamma beta alpha")], "doc_id bigint, text string")
    items = spark.createDataFrame([(9, "Alpha beta gamma")], "item_id bigint, text string")
    assert {r.doc_id for r in decontam.near(docs, items, 6).collect()} == {1, 3}


def test_mixing(spark):
    rnd = random.Random(8)
    rows = []
    for i in range(600):
        source = rnd.choice(["a", "a", "a", "a", "b", "c", None])
        rows.append((i, prose(rnd, rnd.randrange(0, 60)), source))
    rows += [(600, None, "a"), (601, "", "empty"), (602, "one two", "b"), (602, "one two", "b")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    got = mixing.mix(df.repartition(5)).collect()
    again = mixing.mix(df.repartition(2)).collect()
    key = lambda r: (r.doc_id, r.source or "", r.size, r.taken)
    assert sorted(map(key, got)) == sorted(map(key, again)) and len(got) == len(rows)
    sizes, taken, targets = Counter(), Counter(), {}
    for r in got:
        assert r.taken in (0, r.size, 2 * r.size)
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        targets[r.source] = r.target
    total = sum(sizes.values())
    assert {r.source: r.source_size for r in got} == dict(sizes)
    assert math.isclose(sum(targets.values()), 1.5 * total) and all(targets[s] <= 2 * sizes[s] for s in sizes)
    assert all(abs(taken[s] - targets[s]) <= 120 for s in sizes)
    weights = {s: (3.0, 1.0, 2.0)[i % 3] for i, s in enumerate(sorted(sizes, key=lambda s: (s is None, s or "")))}
    free = [s for s in sizes if targets[s] < 2 * sizes[s] - 1e-6]
    assert len({round(targets[s] / weights[s], 6) for s in free}) <= 1
    out = mixing.mixed_documents(df)
    assert out.columns == df.columns
    assert Counter(r.doc_id for r in out.collect()) == Counter({k: v for k, v in Counter(i for r in got if r.size for i in [r.doc_id] * (r.taken // r.size)).items() if v})
    assert mixing.mix(df.limit(0)).count() == 0 and mixing.mixed_documents(df.limit(0)).count() == 0


@pytest.mark.parametrize("bits", [False, True])
def test_token_files_round_trip(spark, corpus, bits, tmp_path):
    from tokenizers import Tokenizer

    texts = [*corpus[:-1], "a  b\t c \n", " lead", "<|endoftext|> x", "don't  stop", "日本語 text", "tail "]
    docs = docs_of(spark, texts)
    tokens.write_tokens(docs, str(tmp_path / "t"), tokenizer_path(), bits=bits)
    got = sorted(tokens.read_tokens(spark, str(tmp_path / "t"), bits, with_ids=True).collect(), key=lambda r: r.doc_id)
    t, at = Tokenizer.from_file(tokenizer_path()), 0
    for r, text in zip(got, texts, strict=True):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 2]
        assert list(r.ids) == ids and r.start == at and r.n_tokens == len(ids) and r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        at += len(ids)


def test_encoder_remembers_parts_in_little_memory(monkeypatch):
    """A worker keeps what it has learned: hash, place and ids of each part, no objects."""
    import gc
    import tracemalloc

    from tokenizers import Tokenizer

    enc, n = tokens.Encoder(tokenizer_path()), 60_000
    tracemalloc.start()
    enc.encode([" ".join(f"w{i}x" for i in range(lo, lo + 1000)) for lo in range(0, n, 1000)])
    gc.collect()
    held = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert len(enc.known) >= n - 1000 and held < len(enc.known) * 32 + len(enc.flat) * 4 + 1_000_000
    # what is forgotten is learned again; long parts count by their ids
    monkeypatch.setattr(tokens, "CACHE_IDS", 50)
    t = Tokenizer.from_file(tokenizer_path())
    for text in ["one two three, four", "x" * 500 + " one", "", "two three " * 40, "one two"]:
        assert [list(x) for x in enc.encode([text, text])] == [t.encode(text, add_special_tokens=False).ids] * 2
    assert len(enc.flat) < 500


def test_planes():
    for ids in ([], [0], [1, 2, 70000, 2**31], list(range(1000))):
        x = np.array(ids, "<u4")
        for bits in (False, True):
            width, planes = tokens.planes_of(x, bits)
            assert len(planes) == width and (tokens.ids_of(planes, len(x), bits) == x).all()


def test_token_files_of_odd_tables(spark):
    rows = [(3, "b"), (3, "a"), (None, None), (3, "a")]
    got = tokens.token_output(spark.createDataFrame(rows, "doc_id bigint, text string"), tokenizer_path()).collect()
    assert sorted((r.doc_id or 0, r.start, r.n_tokens) for r in got) == [(0, 0, 1), (3, 1, 2), (3, 3, 2), (3, 5, 2)]
    assert tokens.token_output(spark.createDataFrame([], "doc_id bigint, text string"), tokenizer_path()).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head><body>
<header><a href=/>Home</a></header><nav><ul><li><a href="/x">Menu one</a></li></ul></nav><!-- note --><div class="ad">Buy now this thing today.</div>
%s<aside>Aside text that is long enough to count as a real paragraph of text.</aside><form><label>Name</label><input></form>
<section id="comments"><p>First! A reader comment that is rather long and says nothing at all of interest.</p></section><footer>&copy; me</footer></body></html>"""
BODY = "<h1>Head &amp; tail</h1><p>First   para\n with <b>bold</b> text&nbsp;here.</p><div class='share'>Share this</div><p>Second.<p>Third &lt;para&gt; &#233;."
TEXT = "Head & tail\nFirst para with bold text here.\nSecond.\nThird <para> é."


def test_html_extraction(spark):
    long = "<p>" + "word " * 40 + "</p>"
    pages = [PAGE % f"<article>{BODY}</article>", PAGE % f"<div id='content'><h1>Head of the page that is read</h1>{long}{long}<p>End.</p></div>", None, "", "plain text only", "<p>unclosed <b>tags", "<nav>only a menu</nav>", "<div>" + "x" * 400_000]
    want = [TEXT, "Head of the page that is read\n" + "\n".join(["word " * 39 + "word"] * 2) + "\nEnd.", "", "", "plain text only", "unclosed tags", "", "x" * 400_000]
    rows = [(i, f"u{i}", p, "clash") for i, p in enumerate(pages)]
    got = sorted(html.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string, text string")).collect())
    assert [r.text for r in got] == want and [r.n_chars for r in got] == [len(t) for t in want]
    assert html.extract(spark.createDataFrame([], "page_id bigint, url string, html string")).count() == 0


def test_line_blocks():
    w = lambda *x: np.array(x, float)
    assert html.stretch(w(5, 0, 0, 0, 90, 120, 4, 100, 0, 0, 0, 10)) == (4, 8)
    assert html.stretch(w(0, 0)) == (0, 0) and html.stretch(w()) == (0, 0)


def test_html_whole_articles():
    p = [f"{w} " * 40 for w in "abcdefgh"]
    body = [x.strip() for x in p]
    para = [f"<p>{x}</p>" for x in p]
    for between in ("<aside><p>x</p><p>y</p><p>z</p><p>q</p></aside>", "<form><div>Mail</div><div>Name</div><div>Send</div></form>", "<div class='advert'><p>Buy</p><p>this</p><p>now</p></div>"):
        page = PAGE % f"<div id='content'>{para[0]}{para[1]}{between}{para[2]}{between}{para[3]}</div>"
        assert html.main_text(page) == "\n".join(body[:4])
    # a heading, a byline and a date too short to surge
    short = f"<h1>A title</h1><div>By someone</div><div>1 May</div><div>1 min</div>{para[0]}{para[1]}"
    assert html.main_text(PAGE % f"<h1>Site</h1><div>a</div><div id='content'>{short}</div>") == "\n".join(["A title", "By someone", "1 May", "1 min", *body[:2]])
    # teaser cards are not the body
    card = "<article><h3>Card</h3><p>A teaser that is short.</p></article>"
    got = html.main_text(PAGE % f"<div id='content'><h1>Head</h1>{para[0]}{para[1]}{para[2]}</div>{card}{card}").split("\n")
    assert got[:4] == ["Head", *body[:3]]
    # but an article is, whatever short lines surround it
    assert html.main_text(PAGE % f"<div>before</div><article><h1>Head</h1>{para[0]}<p>End.</p></article><div>after</div>") == "\n".join(["Head", body[0], "End."])


def test_html_names_surge_and_dive():
    words = [" ".join([w] * 40) for w in ("alpha", "beta", "gamma")]
    para = [f"<p>{x}</p>" for x in words]
    # names that mention something unwanted without being it, and names of an element with most of the text
    for name in ("content with-sidebar", "layout has-sidebar", "top-story", "post no-comments", "main-content widget-area", "page sidebar-right", "story share-enabled", "tag-news"):
        assert html.main_text(PAGE % f"<div class='{name}'><h1>Head</h1>{''.join(para)}</div>") == "\n".join(["Head", *words]), name
    for name in ("ad", "sidebar-right", "siteFooter", "page__sidebar--wide", "comments", "post-comments", "comment-list", "cookie-notice"):
        assert html.main_text(PAGE % f"<div class='body'><h1>Head</h1>{para[0]}</div><div class='{name}'>{para[1] * 5}</div>") == f"Head\n{words[0]}", name
    # bylines, anchors and captions of an article stay
    article = f"<article><h1>H</h1><div class='meta'>By me</div>{para[0]}<section id='related-work'><h2 id='social-context'>R</h2>{para[1]}</section><figure><img><figcaption>Cap</figcaption></figure></article>"
    assert html.main_text(PAGE % article) == "\n".join(["H", "By me", words[0], "R", words[1], "Cap"])
    # the dive ends an article before short lines, the surge begins it after them
    assert html.main_text(f"<body><div>Home</div>{para[0]}{para[1]}{'<div>junk</div>' * 12}</body>") == "\n".join(words[:2])
    # a list in the middle and short paragraphs at the end belong to it, lists of links do not
    links = "<ul>" + "".join(f"<li><a href='{i}'>a story of some length that is linked {i}</a></li>" for i in range(9)) + "</ul>"
    page = f"<div class='post'><h1>H</h1>{para[0]}<ul>{'<li>an item</li>' * 9}</ul>{para[1]}<p>short</p><p>shorter</p><p>end</p></div><div>{links}</div>"
    assert html.main_text(PAGE % page) == "\n".join(["H", words[0], *["an item"] * 9, words[1], "short", "shorter", "end"])
    assert html.main_text(PAGE % f"<div class='ad x'>{para[0]}</div><article><h1>H</h1><p>short</p></article>") == "H\nshort"


def test_html_null_ids_and_repeated_pages(spark):
    rows = [(None, None, PAGE % f"<article>{BODY}</article>")] * 2 + [(1, "u", None)]
    got = html.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()
    assert sorted((r.page_id or 0, r.text) for r in got) == [(0, TEXT), (0, TEXT), (1, "")]


def test_empty_tables(spark):
    empty = docs_of(spark, ["x"]).limit(0)
    for f in (substring.removal_digest, suffixes.removal_digest, neardup.near_duplicates, neardup.deduplicated):
        assert f(empty).count() == 0
    none = ann.nearest(spark.createDataFrame([], "vec_id bigint, embedding array<float>"), F.lit(True))
    assert none.columns == ["query_id", "rank", "vec_id", "score"] and none.count() == 0


@pytest.mark.parametrize("long", [1 << 22, 100])
def test_words_split_as_documented(corpus, monkeypatch, long):
    monkeypatch.setattr(common, "LONG", long)
    raw = [(t or "").encode() for t in corpus]
    buf, offsets = np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])])
    starts, ends, hashes, first = common.words(buf, offsets)
    got = [[buf[s:e].tobytes() for s, e in zip(starts[a:b], ends[a:b])] for a, b in zip(first[:-1], first[1:])]
    assert got == [WORD.findall(r) for r in raw]
    by = {}
    for h, s, e in zip(hashes, starts, ends):
        assert by.setdefault(buf[s:e].tobytes(), h) == h
    assert len(set(by.values())) == len(by)
