"""The pipeline against a brute-force version of its stages, and the registered queries against their SQL."""

import os
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline as cp
from tests.llm.test_operators import brute_components, brute_leaks
from tidemark.llm import langid, mixing
from tidemark.llm.queries import language_model, tokenizer_path
from tools.oracle import compare, connect

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no bench data here")
OPERATORS = [f"op{n}_" for n in range(1, 11)]


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_all_are_registered():
    names = list(entry.queries())
    assert [sum(x.startswith(p) for x in names) for p in OPERATORS] == [1] * 10 and "pipeline" in names
    assert [name for name, _ in cp.STAGES] == ["language_id", "near_dedup", "decontamination", "mixing", "token_ids"]


@pytest.mark.parametrize("name", [n for n in entry.oracle_sql() if n.startswith("op")])
def test_query(spark, con, name):
    ok, text = compare(spark, con, SF, name, entry.queries()[name], entry.oracle_sql()[name])
    assert ok, text


def test_pipeline(spark):
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    got = Counter((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in cp.run(spark, SF).collect())

    model = language_model(docs)
    langs, scores = langid.score_texts(model, [rows[d].text for d in rows])
    kept = [d for d, lang, s in zip(rows, langs, scores) if lang != "und" and s >= cp.LEAST_SCORE]
    pairs = sorted((d, rows[d].text) for d in kept)
    kept = [d for d, _, component in brute_components(pairs, 5, 0.8) if d == component]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    kept = [d for d, x in zip(kept, brute_leaks([rows[d].text for d in kept], items)) if x[1] == 0]
    taken = {r.doc_id: r.taken // r.size for r in mixing.mix(docs.where(F.col("doc_id").isin(kept))).collect() if r.taken}
    tokenizer, at, want = Tokenizer.from_file(tokenizer_path()), 0, Counter()
    for d in sorted(taken):
        ids = np.array([*tokenizer.encode(rows[d].text, add_special_tokens=False).ids, 2], "<u4")
        for _ in range(taken[d]):
            want[d, at, len(ids), zlib.crc32(ids.tobytes())] += 1
            at += len(ids)
    assert got == want


def test_odd_documents_pass_through(spark):
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, "...", "en", None, 3), (None, "the of and to in " * 9, "en", "a", 1), (4, "der die das und nicht " * 9, "de", "b", 1), (4, "der die das und nicht " * 9, "de", "b", 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    for _, stage in cp.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        docs = spark.createDataFrame(out.collect(), docs.schema)
    # the mixture may leave one of two so small sources out, or read it twice
    assert {r.doc_id for r in docs.collect()} <= {None, 4}
    empty = docs.limit(0)
    for _, stage in cp.STAGES:
        assert stage(spark, empty, SF).count() == 0


def test_llm_is_not_imported_elsewhere():
    root = os.path.dirname(os.path.abspath(entry.__file__))
    for folder in ("tidemark", "workload", "tools"):
        for at, _, files in os.walk(os.path.join(root, folder)):
            if "llm" in at.split(os.sep):
                continue
            for f in files:
                if f.endswith(".py"):
                    assert not re.search(r"tidemark\.llm|from tidemark import llm|corpus_pipeline", open(os.path.join(at, f)).read()), f
