"""Benchmark decontamination with a distributed positional inverted index, in DataFrame operations only.

1. How often each benchmark word occurs in the corpus is counted (partial sums; one row per
   benchmark word is left).
2. Every window (a run of consecutive words of an item) is known by a digest and looked up by its
   rarest word.  The postings of those rare words are stored once per distinct text: text, position,
   word, and the words around it.
3. The list of a window's rarest word is met with those of its other words at their offsets: a posting
   at position p asks for word k of the window at p - offset + k, which the stored neighbourhood
   answers without another shuffle.  Documents come back by the digest of their text.

Common words therefore have no long lists, a crowd of equal texts is indexed once, a document with
many hits spreads over its postings, and nothing pairs documents with items.  Benchmark tables are
sent to every task only below a row count; above it they are joined by shuffle.  ``near`` finds
unordered matches by the same index.

Defined cases: a null or wordless text has no words and no hits; an item with fewer words than a
window is one window; an item without words matches nothing; repeated items and repeated rows
each count for themselves (rows with equal id and text give equal results); a null id is kept; an
empty table on either side gives no hits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import cut_lineage

WINDOW = 10
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def tokens(text: Column) -> Column:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after folding A-Z; an empty array for null."""
    parts = F.split(F.translate(text, UPPER, LOWER), NOT_WORD)
    return F.coalesce(F.filter(parts, lambda w: w != ""), F.array().cast("array<string>"))


def windows(items: DataFrame, n: int = WINDOW) -> DataFrame:
    """``items(item_id, text)`` cut into windows: ``item_id, window`` (array of words)."""
    w = items.select("item_id", tokens(F.col("text")).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("w") - n))
    return w.select("item_id", F.explode(F.transform(starts, lambda i: F.slice("w", i + 1, n))).alias("window"))


FEW = 200_000  # benchmark words or windows that are sent to every task at most


def few(small: DataFrame) -> DataFrame:
    """Sent to every task if its rows are few, else left to a shuffle."""
    return F.broadcast(small) if small.count() <= FEW else small


def text_key() -> Column:
    """What stands for a text: null for a null text."""
    return F.md5(F.col("text").cast("binary"))


def word_counts(docs: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Occurrences in ``docs(text)`` of each word of ``vocabulary(term)``; words that never occur are left out."""
    seen = docs.select(F.explode(tokens(F.col("text"))).alias("term"))
    return seen.join(few(cut_lineage(vocabulary, "vocabulary")), "term", "left_semi").groupBy("term").count()


def postings(docs: DataFrame, terms: DataFrame, around: int) -> DataFrame:
    """The index of ``terms(term)``: one row per occurrence in a distinct text, with up to ``around`` words on each side.

    ``term, __k`` (digest of the text), ``pos`` (from 0), ``first`` (position of the first stored neighbour), ``near``.
    """
    words = docs.select(text_key().alias("__k"), tokens(F.col("text")).alias("__w")).where(F.size("__w") > 0)
    each = words.select("__k", "__w", F.posexplode("__w").alias("pos", "term")).join(few(terms), "term", "left_semi")
    first = F.greatest(F.lit(0), F.col("pos") - around)
    each = each.select("term", "__k", "pos", first.alias("first"), F.slice("__w", first + 1, F.col("pos") - first + around + 1).alias("near"))
    return each.dropDuplicates(["__k", "pos"])


def rarest_words(wins: DataFrame, counts: DataFrame) -> DataFrame:
    """Each distinct window with its rarest word and that word's offset; windows with a word that never occurs are gone."""
    distinct = wins.select("window").distinct()
    each = distinct.select("window", F.posexplode("window").alias("off", "term"))
    known = each.join(counts, "term", "left")
    best = known.groupBy("window").agg(F.min(F.struct(F.coalesce("count", F.lit(0)).alias("count"), "term", "off")).alias("b"))
    return best.where(F.col("b.count") > 0).select("window", F.col("b.term").alias("term"), F.col("b.off").alias("off"))


def phrase_hits(docs: DataFrame, items: DataFrame, n: int = WINDOW) -> DataFrame:
    """Occurrences of item windows in distinct texts: ``__k, item_id, start, length`` (in words)."""
    wins = cut_lineage(windows(items, n).withColumn("wid", F.md5(F.array_join("window", " ").cast("binary"))), "item-windows")
    counts = word_counts(docs, wins.select(F.explode("window").alias("term")).distinct())
    rare = cut_lineage(rarest_words(wins, counts).withColumn("wid", F.md5(F.array_join("window", " ").cast("binary"))), "rare-words")
    index = cut_lineage(postings(docs, rare.select("term").distinct(), n - 1), "postings")
    at = F.col("pos") - F.col("off")
    same = F.slice("near", at - F.col("first") + 1, F.size("window")) == F.col("window")
    found = index.join(few(rare), "term").where((at >= F.col("first")) & same).select("__k", at.alias("start"), "wid", F.size("window").alias("length"))
    return found.join(few(wins.select("wid", "item_id")), "wid").select("__k", "item_id", "start", "length")


def near(docs: DataFrame, items: DataFrame, span: int = 20) -> DataFrame:
    """Proximity matches: ``doc_id, item_id`` where all distinct words of a (short) item lie within ``span`` words of its rarest one."""
    whole = items.select("item_id", F.array_distinct(tokens(F.col("text"))).alias("window")).where(F.size("window") > 0)
    counts = word_counts(docs, whole.select(F.explode("window").alias("term")).distinct())
    rare = cut_lineage(rarest_words(whole, counts), "rare-words")
    index = postings(docs, rare.select("term").distinct(), span)
    found = index.join(few(rare), "term").where(F.size(F.array_except("window", "near")) == 0)
    found = found.join(whole, "window").select("__k", "item_id").distinct()
    return docs.select("doc_id", text_key().alias("__k")).join(found, "__k").select("doc_id", "item_id").distinct()


def contamination(docs: DataFrame, items: DataFrame, n: int = WINDOW, keep: tuple[str, ...] = ()) -> DataFrame:
    """Each row of ``docs(doc_id, text, …keep)`` with ``n_words, n_hit, n_items, item_ids, contaminated``."""
    hits = cut_lineage(phrase_hits(docs, items, n), "hits")
    # covered words: the gaps between consecutive distinct starts bound what each occurrence adds
    spans = hits.groupBy("__k", "start").agg(F.max("length").alias("length"))
    by_text = Window.partitionBy("__k").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    end = F.col("start") + F.col("length")
    new = F.greatest(F.lit(0), end - F.greatest(F.col("start"), F.coalesce(F.max(end).over(by_text), F.lit(0))))
    covered = spans.withColumn("__new", new).groupBy("__k").agg(F.sum("__new").alias("n_hit"))
    items_of = hits.select("__k", "item_id").distinct().groupBy("__k").agg(F.array_sort(F.collect_list(F.col("item_id").cast("string"))).alias("item_ids"))
    found = covered.join(items_of, "__k")
    rows = docs.select("doc_id", *keep, text_key().alias("__k"), F.size(tokens(F.col("text"))).cast("long").alias("n_words"))
    out = rows.join(found, "__k", "left")
    ids = F.coalesce("item_ids", F.array().cast("array<string>"))
    return out.select(
        "doc_id", *keep, "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.size(ids).cast("long").alias("n_items"),
        ids.alias("item_ids"), F.col("n_hit").isNotNull().alias("contaminated"),
    )


def uncontaminated(docs: DataFrame, items: DataFrame, n: int = WINDOW) -> DataFrame:
    """The rows of ``docs``, with all their columns, in which no item window occurs."""
    hit = cut_lineage(phrase_hits(docs, items, n).select("__k").distinct(), "contaminated")
    return docs.withColumn("__k", text_key()).join(hit, "__k", "left_anti").select(*(f"`{c}`" for c in docs.columns))
