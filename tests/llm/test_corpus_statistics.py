"""Divergence audit, conversation trie and context-tree scores beside brute-force versions."""

import hashlib
import math
import random
import re
import tracemalloc
import zlib
from collections import Counter, defaultdict

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.llm import contexts, divergence, prefixes
from tidemark.llm.common import fold

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, k bigint, digest bigint, n bigint"  # clashing names too
TURNS = "conv_id bigint, turn bigint, role string, text string, path string, base bigint, key int"


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, lang, s, 0, 0.5, 7, 1, 2) for i, t, lang, s in rows], DOCS).repartition(3)


# --- divergence -----------------------------------------------------------------------------------


def plain_audit(rows, least, top=50):
    docs, count, sources = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for _, text, lang, source in rows:
        lang, source = lang or "", source or ""
        sources[lang].add(source)
        terms = Counter(re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lower(text)))
        docs[lang].update(set(terms))
        count[lang, source].update(terms)
    out = []
    for lang, mine in sources.items():
        kept = [t for t, n in docs[lang].items() if n >= least]

        def rates(c):
            total = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 5) // (total + 5 * len(kept)) for t in kept}

        q = rates(sum((count[lang, s] for s in mine), Counter()))
        p = {s: rates(count[lang, s]) for s in mine}
        for s in mine:
            pairs = sorted((-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode(), o) for o in mine if o != s)
            terms = sorted((q[t] - p[s][t], t.encode(), t) for t in kept if count[lang, s][t] and p[s][t] > q[t])[:top]
            out += [(lang, s, part, item, -v, i + 1) for part, found in (("pair", pairs), ("term", terms)) for i, (v, _, item) in enumerate(found)]
    return sorted(out)


@pytest.fixture(scope="module")
def corpus():
    rnd = random.Random(3)
    vocabulary = [f"{a}{b}" for a in ("Ba", "do", "É", "z_", "ß") for b in ("", "n", "ra", "ö", "Q")]
    rows = []
    for i in range(300):
        lang = rnd.choice(["en", "de", None])
        source = "hot" if rnd.random() < 0.4 else rnd.choice(["a", "b", "é", None, ""])
        rows.append((i, " ".join(rnd.choice(vocabulary[rnd.randrange(5) :]) for _ in range(rnd.randrange(30))), lang, source))
    rows += [(900, None, "en", "a"), (901, "", "xx", "only"), (None, "12 34", "xx", "other"), (902, "ba " * 30_000, "en", "b"), (7, "same Text", "en", "a"), (7, "same Text", "en", "a")]
    return rows


@pytest.mark.parametrize("bits", [64, 3])
def test_audit(spark, corpus, bits):
    """Three bits make nearly all digests collide."""
    got = divergence.audit(docs_of(spark, corpus), least_docs=8, top=6, bits=bits)
    assert got.dtypes[-2:] == [("value", "bigint"), ("rank", "int")]
    assert sorted(tuple(r) for r in got.collect()) == plain_audit(corpus, 8, 6)


def test_audit_tiles(spark, corpus, monkeypatch):
    monkeypatch.setattr(divergence, "TILE", 2)
    monkeypatch.setattr(divergence, "KNOWN", 0)  # digests joined by shuffle
    got = divergence.audit(docs_of(spark, corpus), least_docs=8)
    want = plain_audit(corpus, 8)
    assert sorted(tuple(r) for r in got.where("part = 'term'").collect()) == [r for r in want if r[2] == "term"]


def test_audit_of_nothing(spark, corpus):
    assert divergence.audit(docs_of(spark, corpus).limit(0)).count() == 0
    got = divergence.audit(docs_of(spark, corpus), least_docs=10**6)
    assert got.select("value").distinct().collect() == [(0,)] and got.where("part = 'term'").count() == 0


def test_counting_needs_little_memory():
    """A slice of texts is counted in less than 14 times its bytes."""
    rnd = random.Random(8)
    vocabulary = ["".join(rnd.choices("abcdefghij", k=rnd.randrange(2, 9))) for _ in range(40_000)]
    texts = [" ".join(rnd.choices(vocabulary, k=400)) for _ in range(3_000)]
    batch = pa.table({"lang": ["en"] * 3_000, "source": [f"s{i % 20}" for i in range(3_000)], "text": texts}).to_batches()[0]
    count = divergence._count(divergence.Groups([("en", f"s{i}") for i in range(20)]), 64)
    tracemalloc.start()
    sizes = [found.num_rows for found in count(iter([batch]))]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(sizes) > 400_000
    assert peak < 14 * sum(map(len, texts))


def test_rate_is_exact(spark):
    row = spark.range(1).select(divergence.rate(F.lit(10**15 + 7), F.lit(3 * 10**15), F.lit(10**9), 5, 10**9).alias("p")).first()
    assert row.p == 1 + 10**9 * (10**15 + 12) // (3 * 10**15 + 5 * 10**9)


# --- conversation trie ----------------------------------------------------------------------------


def plain_trie(convs):
    nodes = defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            nodes[tuple(turns[:d])].append(c)
    children = Counter(n[:-1] for n in nodes if n)
    leaves, saved = Counter(), Counter()
    for n, members in nodes.items():
        for d in range(len(n) + 1):
            leaves[n[:d]] += not children[n]
            saved[n[:d]] += (len(members) - 1) * len(n[-1][1].encode()) if n else 0
    out = []
    for n, members in nodes.items():
        ends = ",".join(map(str, sorted(c for c in members if len(convs[c]) == len(n))))
        out.append((min(members), len(n), min(nodes[n[:-1]]) if n else None, len(members), children[n], leaves[n], saved[n], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def in_order(rows):
    convs = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            role, text = role or "", text or ""
            convs[c].append((turn is not None, turn or 0, hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest(), role, text))
    return {c: [t[3:] for t in sorted(turns)] for c, turns in convs.items()}


def spliced(convs):
    out = {}
    for c, turns in convs.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = convs.get(c - c % 5, [])[:h] + turns[h:]
    return out


@pytest.fixture(scope="module")
def talks():
    rnd = random.Random(5)
    rows = []
    for c in range(160):
        if c in (10, 20, 33):
            continue
        for t in range(rnd.choice([1, 2, 3, 4, 6])):
            rows.append((c, t, "user" if t % 2 == 0 else None, rnd.choice(["hi", "ok", "é", None, ""]) if t else "hi", "p", 1, 2))
    rows += [(c, t, "user", f"copy {t}", "p", 1, 2) for c in range(200, 260) for t in range(12)]  # a crowd of copies
    rows += [(300, t, "user", str(t), "p", 1, 2) for t in range(70)] + [(305, t, "user", str(t if t < 40 else -t), "p", 1, 2) for t in range(60)]
    rows += [(None, 0, "user", "hi", "p", 1, 2), (400, None, "user", "first", "p", 1, 2), (400, 0, None, None, "p", 1, 2), (400, 0, None, None, "p", 1, 2), (400, 0, "b", "x", "p", 1, 2)]
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize("shard", [10**6, 100, 9])
def test_trie(spark, talks, shard):
    table = spark.createDataFrame(talks, TURNS).repartition(4)
    got = prefixes.trie(prefixes.paths(table), shard)
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain_trie(in_order(talks))
    got = prefixes.trie(prefixes.spliced(prefixes.paths(table)), shard)
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain_trie(spliced(in_order(talks)))


def test_trie_lists_across_shards(spark, talks, monkeypatch):
    monkeypatch.setattr(prefixes, "PIECE", 3)
    monkeypatch.setattr(prefixes, "FEW_EDGES", 0)
    table = spark.createDataFrame(talks, TURNS)
    got = prefixes.trie(prefixes.paths(table), 40)
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain_trie(in_order(talks))


def test_trie_of_nothing(spark, talks):
    assert prefixes.trie(prefixes.paths(spark.createDataFrame(talks, TURNS).limit(0))).count() == 0


# --- context-tree weighting -----------------------------------------------------------------------


def canonical(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    return words, (" ".join(words) + "\n").encode()


def plain_scores(rows, depth):
    known = [canonical(t) for i, t, *_ in rows if i is not None and zlib.crc32(str(i).encode()) % 5 != 1]
    c = Counter(w for ws, _ in known for w in ws)
    total, distinct = sum(c.values()) + len(known), len(c) + (len(known) > 0)
    below = total + 0.5 * (distinct + 1)
    count, longer = defaultdict(lambda: [0, 0]), defaultdict(set)
    for _, s in known:
        p = b"\n" * depth + s
        for i in range(depth, len(p)):
            for k in range(8):
                for d in range(depth + 1):
                    count[p[i - d : i], k, p[i] >> (8 - k)][p[i] >> (7 - k) & 1] += 1
                    longer[p[i - d + 1 : i] if d else None, k, p[i] >> (8 - k)].add(p[i - d : i])
    weighted = {}
    share = {}

    def weight(ctx, k, bits):
        key = (ctx, k, bits)
        if key not in count:
            return 0.0
        if key not in weighted:
            a, b = count[key]
            own = math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)
            if len(ctx) == depth:
                weighted[key] = own
            else:
                rest = sum(weight(y, k, bits) for y in longer[key])
                top = max(own, rest)
                weighted[key] = top + math.log((math.exp(own - top) + math.exp(rest - top)) / 2)
                share[key] = 1 / (1 + math.exp(min(700, rest - own)))
        return weighted[key]

    def one(ctx, d, k, bits):
        key = (ctx[depth - d :], k, bits)
        if key not in count:
            return 0.5
        weight(*key)
        a, b = count[key]
        own = (b + 0.5) / (a + b + 1)
        return own if d == depth else share[key] * own + (1 - share[key]) * one(ctx, d + 1, k, bits)

    out = []
    for i, t, *_ in rows:
        words, s = canonical(t)
        p = b"\n" * depth + s
        score = 0.0
        for j in range(depth, len(p)):
            for k in range(8):
                q = one(p[j - depth : j], 0, k, p[j] >> (8 - k))
                score += math.log10(q if p[j] >> (7 - k) & 1 else 1 - q)
        base = sum(math.log10((c[w] + 0.5) / below) for w in words) + math.log10((len(known) + 0.5) / below)
        out.append((i, i is not None and zlib.crc32(str(i).encode()) % 5 == 1, len(words) + 1, sum(c[w] > 0 for w in words) + (len(known) > 0), total, base, score))
    return out


@pytest.fixture(scope="module")
def letters():
    rnd = random.Random(9)
    rows = [(i, " ".join(rnd.choice(["the", "Cat", "réa", "sat", "tion", "\tthe"]) + rnd.choice(["", "s", "ing"]) for _ in range(rnd.randrange(25))), "en", "s") for i in range(60)]
    return rows + [(70, None, "en", "s"), (71, "", "en", "s"), (None, " Hello  é\n", "en", "s"), (73, "the the " * 40, "en", "s"), (73, "the the " * 40, "en", "s"), (74, " \n ", "en", "s")]


@pytest.mark.parametrize("most", [contexts.HEAD, 40, 0])
def test_scores(spark, letters, most):
    docs = docs_of(spark, letters)
    remainder = fold(F.col("doc_id"), 5)
    got = sorted((tuple(r) for r in contexts.score(docs, contexts.fit(docs, remainder != 1, 3), remainder == 1, most).collect()), key=str)
    want = sorted(plain_scores(letters, 3), key=str)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    for g, w in zip(got, want):
        assert g[5:7] == pytest.approx(w[5:7], rel=1e-9)
        assert g[7] > 0


def test_probabilities_of_all_continuations_sum_to_one(spark, letters):
    """After one context the prices of all 256 bytes are a distribution; unseen bytes have a price too."""
    docs = docs_of(spark, letters + [(1000 + b, "the" + chr(b), "en", "s") for b in range(33, 127)])
    model = contexts.fit(docs, F.col("doc_id") < 60, 3)
    priced = {r.key & 0xFF: r.price for r in model.strings.collect() if r.key >> 8 == int.from_bytes(b"the", "big")}
    assert len(priced) > 60 and sum(10**p for p in priced.values()) < 1
    assert all(p < 0 for p in priced.values())


def test_longer_contexts_predict_better(spark):
    rnd = random.Random(2)
    words = ["".join(rnd.choice("abcdefg") for _ in range(6)) for _ in range(40)]
    docs = docs_of(spark, [(i, " ".join(rnd.choice(words) for _ in range(60)), "en", "s") for i in range(60)])
    remainder = fold(F.col("doc_id"), 5)
    bits = [contexts.score(docs, contexts.fit(docs, remainder != 1, d), remainder == 1).where("held_out").agg(F.avg("bits_per_byte")).first()[0] for d in (2, 5)]
    assert bits[1] < 0.7 * bits[0] < 3


def test_scores_without_training_texts(spark, letters):
    docs = docs_of(spark, letters)
    got = contexts.score(docs, contexts.fit(docs, F.lit(False), 3), F.lit(True)).where("doc_id = 71").first()
    assert (got.n_tokens, got.n_known, got.train_tokens, got.base_score) == (1, 0, 0, 0.0)
    assert got.score == pytest.approx(8 * math.log10(0.5))
    assert contexts.score(docs.limit(0), contexts.fit(docs.limit(0), F.lit(True)), F.lit(True)).count() == 0


def test_very_long_text(spark):
    docs = docs_of(spark, [(1, "word " * 1_200_000, "en", "s"), (2, "word", "en", "s")])
    got = {r.doc_id: r for r in contexts.score(docs, contexts.fit(docs, F.lit(True)), F.lit(False)).collect()}
    assert got[1].n_tokens == 1_200_001 and got[1].n_known == 1_200_001 and got[1].bits_per_byte < 0.01
