"""Benchmark decontamination over a distributed positional inverted index.

The index stores postings (term, document, position) of training tokens. Test items
are cut into windows of ``WIDTH`` consecutive words (a shorter item is one window), and
equal windows are one, whichever items hold them. For each window the two rarest terms
in the whole corpus are looked up: their offsets in the window give the distance at which
both must stand. Every distinct pair of terms at a distance is searched once: postings of the
rarer propose places, and the other must have a posting at the matching one. Lists are
so intersected from the rarest, and only terms that are among the two rarest of some
window are indexed. A match of a pair proposes its windows at one start each; what survives is
compared with the document's words there, by a hash of 64 bits over the whole window.

So a document proposes at most a start for each of its words and each window that has the pair
there, also where words repeat: an item of one word over and over is a single window.

Passes: term counts (partial aggregation by term of the items only), postings, and
the comparison, which joins documents once by id. What comes from the items is broadcast only
up to a checked size, else joined by shuffle. A passage in a third of all documents adds
postings to many tasks: lists are joined by document, term and position, never
gathered by term. A document gathers starts and window names, never words of items.

Defined cases: null text has no words; items without words never match; an item whose
id is null marks words but is not named; repeated items count once; repeated rows of
a document are judged alike; with no items nothing is contaminated; columns of the input
whose names the results take are kept under the name with ``_in`` added.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from frameloom.llm.common import ascii_lower, bounded, doc_key, filtered, packed, stored, unpacked

WIDTH = 10
#: What separates words: ASCII but for digits and lower-case letters (after lower-casing).
BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def tokens(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), BREAKS), "")


def item_windows(items: DataFrame, item_id: str, text: str, width: int = WIDTH) -> DataFrame:
    """win (a hash of the words), toks, and the sorted ids of the items that hold it, of every distinct window."""
    out = items.select(items[item_id].alias("id"), tokens(items[text]).alias("toks")).where(F.size("toks") > 0)
    at = F.sequence(F.lit(1), F.greatest(F.size("toks") - width + 1, F.lit(1)))
    out = out.select("id", F.explode(F.array_distinct(F.transform(at, lambda i: F.slice("toks", i, width)))).alias("toks"))
    return out.groupBy("toks").agg(F.sort_array(F.collect_set("id")).alias("ids")).select(F.xxhash64("toks").alias("win"), "toks", "ids")


def postings(docs: DataFrame, doc_id: str, text: str, terms: DataFrame | None = None) -> DataFrame:
    """The positional index: term, _id, _h, pos. ``terms`` (stored, one column) limits it to those."""
    rows = docs.select(docs[doc_id].alias("_did"), docs[text].alias("_dt")).select(*doc_key("_did", "_dt"), tokens(F.col("_dt")).alias("_t"))
    rows = rows.select("_id", "_h", F.posexplode("_t").alias("pos", "term"))
    if terms is not None:
        rows = rows.join(bounded(terms), "term")
    return rows.select("term", "_id", "_h", "pos")


def term_counts(docs: DataFrame, text: str, terms: DataFrame) -> DataFrame:
    """Occurrences in all documents of each of ``terms`` that occurs."""
    rows = docs.select(F.explode(tokens(docs[text])).alias("term"))
    return rows.join(bounded(terms), "term").groupBy("term").agg(F.count("*").alias("n"))


def anchors(windows: DataFrame, counts: DataFrame) -> DataFrame:
    """win, n (its words), t1, o1, t2, gap: rarest and second rarest term of each window, the offset of one and its distance to the other.

    A window with a term that no document holds cannot occur and has no anchors.
    """
    cells = windows.select("win", F.size("toks").alias("n"), F.posexplode("toks").alias("i", "term"))
    known = cells.join(bounded(counts.withColumnRenamed("n", "count")), "term", "left")
    order = F.array_sort(F.collect_list(F.struct("count", "i", "term")))  # at most as many as a window has words
    whole = known.groupBy("win", "n").agg(order.alias("c"), F.min(F.col("count").isNotNull()).alias("all")).where("all")
    first, second = F.col("c")[0], F.coalesce(F.get("c", F.lit(1)), F.col("c")[0])
    return whole.select("win", "n", first["term"].alias("t1"), first["i"].alias("o1"), second["term"].alias("t2"), (second["i"] - first["i"]).alias("gap"))


def alignments(index: DataFrame, marks: DataFrame, slop: int = 0) -> DataFrame:
    """win, n, _id, _h, at: where a window may start, by intersecting the two rarest lists.

    With ``slop`` the second term may stand up to that many words off its place,
    which gives proximity instead of phrase candidates.
    """
    pairs = marks.select("t1", "t2", "gap").distinct()
    first = index.join(bounded(stored(pairs, "term-pairs")), index["term"] == F.col("t1"))
    place = F.col("pos") + F.col("gap")
    wanted = first.select("t1", "t2", "gap", "_id", "_h", F.col("pos").alias("p1"), F.explode(F.sequence(place - slop, place + slop)).alias("p2"))
    other = index.select(F.col("term").alias("_t"), F.col("_id").alias("_id2"), F.col("_h").alias("_h2"), F.col("pos").alias("_p"))
    met = wanted.join(other, (F.col("t2") == F.col("_t")) & (F.col("p2") == F.col("_p")) & F.col("_id").eqNullSafe(F.col("_id2")) & (F.col("_h") == F.col("_h2")), "left_semi")
    return met.join(bounded(marks), ["t1", "t2", "gap"]).select("win", "n", "_id", "_h", (F.col("p1") - F.col("o1")).alias("at")).where("at >= 0").distinct()


def search(docs: DataFrame, items: DataFrame, doc_id: str, text: str, item_id: str, item_text: str, width: int = WIDTH, slop: int = 0) -> tuple[DataFrame, DataFrame]:
    """(distinct windows of the items, candidate alignments); the windows are stored."""
    known = stored(item_windows(items, item_id, item_text, width), "windows")
    vocabulary = stored(known.select(F.explode("toks").alias("term")).distinct(), "item-terms")
    counts = stored(term_counts(docs, text, vocabulary), "term-counts")
    marks = stored(anchors(known, counts), "anchors")
    terms = stored(marks.select(F.explode(F.array("t1", "t2")).alias("term")).distinct(), "anchor-terms")
    index = stored(postings(docs, doc_id, text, terms), "postings")
    return known, alignments(index, marks, slop)


def proximity(docs: DataFrame, items: DataFrame, doc_id: str, text: str, item_id: str, item_text: str, slop: int = 3, width: int = WIDTH) -> DataFrame:
    """doc_id, item_id: documents where a window's two rarest terms stand within ``slop`` words of their distance."""
    known, near = search(docs, items, doc_id, text, item_id, item_text, width, slop)
    held = near.select("win", "_id").distinct().join(known.select("win", F.explode("ids").alias("item_id")), "win")
    return held.select(F.col("_id").alias("doc_id"), "item_id").distinct()


def matches(docs: DataFrame, items: DataFrame, doc_id: str, text: str, item_id: str, item_text: str, width: int = WIDTH) -> tuple[DataFrame, DataFrame]:
    """(the distinct windows of the items, _mid, _mh and ``_m``: where which windows stand in each distinct document that holds any), stored.

    Only starts and names of windows are gathered before a match is proved, whatever number of items shares a window.
    """
    known, at = search(docs, items, doc_id, text, item_id, item_text, width)
    starts = stored(at.groupBy("_id", "_h").agg(F.collect_list(F.struct("at", "n", "win")).alias("_c")), "candidates")
    starts = starts.withColumnsRenamed({"_id": "_cid", "_h": "_ch"})
    texts = docs.select(docs[doc_id].alias("_did"), docs[text].alias("_dt")).select(*doc_key("_did", "_dt"), "_dt")
    rows = texts.join(bounded(starts), F.col("_id").eqNullSafe(F.col("_cid")) & (F.col("_h") == F.col("_ch")))
    rows = rows.withColumn("_t", tokens(F.col("_dt")))
    there = lambda c: F.xxhash64(F.transform(F.sequence(c["at"], c["at"] + c["n"] - 1), lambda i: F.get("_t", i)))  # noqa: E731  a slice would copy all words
    held = F.filter("_c", lambda c: (c["at"] + c["n"] <= F.size("_t")) & (there(c) == c["win"]))
    rows = filtered(rows.select(F.col("_id").alias("_mid"), F.col("_h").alias("_mh"), held.alias("_m")), F.size("_m") > 0)
    return known, stored(rows.dropDuplicates(["_mid", "_mh"]), "matches")


def _keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return packed(docs, _id=doc_id, _text=text).withColumn("_h", F.md5(F.coalesce(F.col("_text"), F.lit("")).cast("binary")))


def marked(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", width: int = WIDTH) -> DataFrame:
    """``docs`` with n_words, hits (array of start, length) and hit_items (distinct item ids as strings, sorted)."""
    known, found = matches(docs, items, doc_id, text, item_id, item_text, width)
    named = found.select("_mid", "_mh", F.explode(F.array_distinct(F.transform("_m", lambda c: c["win"]))).alias("win"))
    ids = known.select("win", F.explode("ids").alias("_item"))
    named = named.join(bounded(stored(ids, "window-items")), "win").groupBy("_mid", "_mh").agg(F.sort_array(F.collect_set(F.col("_item").cast("string"))).alias("_names"))
    named = named.withColumnsRenamed({"_mid": "_nid", "_mh": "_nh"})
    spans = F.sort_array(F.transform("_m", lambda c: F.struct(c["at"].alias("start"), c["n"].alias("length"))))
    told = found.select("_mid", "_mh", spans.alias("_spans")).join(named, F.col("_mid").eqNullSafe(F.col("_nid")) & (F.col("_mh") == F.col("_nh")), "left")
    told = bounded(stored(told.select("_mid", "_mh", "_spans", "_names"), "marked"))
    rows = _keyed(docs, doc_id, text).join(told, F.col("_id").eqNullSafe(F.col("_mid")) & (F.col("_h") == F.col("_mh")), "left")
    hit = "array<struct<start:int,length:int>>"  # distinct, as candidates are
    new = {
        "n_words": F.size(tokens(F.col("_text"))).cast("long"),
        "hits": F.coalesce(F.col("_spans").cast(hit), F.array().cast(hit)),
        "hit_items": F.coalesce("_names", F.array().cast("array<string>")),
    }
    return unpacked(rows, docs.columns, new)


def clean(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", width: int = WIDTH, least: int = 1) -> DataFrame:
    """The documents without a window of at least ``least`` words, with their own columns only."""
    _, found = matches(docs, items, doc_id, text, item_id, item_text, width)
    found = bounded(stored(found.where(F.exists("_m", lambda c: c["n"] >= least)).select("_mid", "_mh"), "contaminated"))
    rows = _keyed(docs, doc_id, text).join(found, F.col("_id").eqNullSafe(F.col("_mid")) & (F.col("_h") == F.col("_mh")), "left_anti")
    return unpacked(rows, docs.columns)


def covered(hits: Column) -> Column:
    """Words inside at least one hit. ``hits`` is sorted by start."""
    start = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))

    def add(acc: Column, x: Column) -> Column:
        end = x["start"] + x["length"]
        return F.struct(F.greatest(acc["end"], end).alias("end"), (acc["n"] + F.greatest(F.lit(0), end - F.greatest(acc["end"], x["start"]))).cast("long").alias("n"))

    return F.aggregate(hits, start, add, lambda acc: acc["n"])
