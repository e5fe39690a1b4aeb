"""Line dedup over a log-template tree of fixed depth.

A line's path in the tree is its token count, then its first ``DEPTH`` tokens, with
tokens that hold a digit generalised to a wildcard; that is its leaf. Within a leaf a
template is the rest of the line with one of ``BLOCKS`` equal stretches generalised:
lines that agree in count, leading tokens and all but one stretch share it, so they
are alike in at least half their tokens. The line itself, digits generalised, is
the most special template of its leaf. Templates are named by hashes of 64 bits.

A template that ``MIN_DOCS`` or more documents hold recurs; a whole line of
``LONG_TOKENS`` tokens or more (parameter ``long_tokens``) recurs in two. Of a recurring template
the lines of its first document (smallest id) stay and those of all others are
dropped; a line stays only if it may stay under every recurring template it has.

Counting needs no distinct: a document's templates are made distinct in its own row,
so a plain count by template, with partial aggregation, counts documents. A line that
stands in a third of all documents is one number from each task. The lowest bit of a
template's hash tells whether two documents are enough.

Defined cases: blank lines are never dropped; null text stays null; documents of one
id count as one holder of their templates' first place; repeated rows each count as a
document; an empty table gives an empty result; columns of the input called n_lines or
n_dropped are kept with ``_in`` added to their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from frameloom.llm.common import SPACE_CHARS, SPACE_CLASS, bounded, doc_key, filtered, packed, stored, unpacked

DEPTH = 3
BLOCKS = 2
MIN_DOCS = 3
LONG_TOKENS = 50
#: Shorter lines have no template with a wildcard stretch.
MIN_TOKENS = 6
WILDCARD = "<*>"


def _even(h: Column) -> Column:
    return h.bitwiseAND(F.lit(-2).cast("long"))


def templates(line: Column, depth: int = DEPTH, blocks: int = BLOCKS, min_tokens: int = MIN_TOKENS, long_tokens: int = LONG_TOKENS) -> Column:
    """Hashes of a line's templates, the most special first; none for a blank line."""
    plain = F.trim(line, F.lit(SPACE_CHARS))
    masked = F.when(plain.rlike("[0-9]"), F.regexp_replace(plain, f"[^{SPACE_CLASS}0-9]*+[0-9][^{SPACE_CLASS}]*+", WILDCARD)).otherwise(plain)
    holder = F.array(F.split(masked, f"[{SPACE_CLASS}]+"))

    def of(t: Column) -> Column:
        n = F.size(t)
        size = F.ceil((n - depth) / blocks).cast("int")
        keys = [_even(F.xxhash64(F.lit(-1), t)) + F.when(n >= long_tokens, 1).otherwise(0)]
        for b in range(blocks):
            head, tail = F.slice(t, F.lit(1), depth + b * size), F.slice(t, depth + (b + 1) * size + 1, n)
            keys.append(_even(F.xxhash64(F.lit(b), n, head, tail)))
        return F.when(F.size(t) >= min_tokens, F.array(*keys)).otherwise(F.array(keys[0]))

    return F.when(F.length(plain) > 0, F.get(F.transform(holder, of), F.lit(0))).otherwise(F.array().cast("array<bigint>"))


def parsed(docs: DataFrame, doc_id: str, text: str, long_tokens: int = LONG_TOKENS) -> DataFrame:
    """_id, _h and ``lines``: for each line of a text, in order, its templates."""
    rows = docs.select(docs[doc_id].alias("_did"), docs[text].alias("_dt")).where(F.col("_dt").isNotNull())
    return rows.select(*doc_key("_did", "_dt"), F.transform(F.split("_dt", "\n"), lambda line: templates(line, long_tokens=long_tokens)).alias("lines"))


def recurring(tree: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """template, first: those of enough documents, and the smallest id among these."""
    least = F.when(F.col("template").bitwiseAND(F.lit(1).cast("long")) == 1, min(2, min_docs)).otherwise(min_docs)
    held = tree.select("_id", F.explode(F.array_distinct(F.flatten("lines"))).alias("template"))
    return held.groupBy("template").agg(F.count("*").alias("n"), F.min("_id").alias("first")).where(F.col("n") >= least).select("template", "first")


def _deduped(docs: DataFrame, doc_id: str, text: str, min_docs: int, long_tokens: int = LONG_TOKENS) -> tuple[DataFrame, dict[str, Column]]:
    """The packed documents with their recurring lines, and what ``deduped`` adds."""
    tree = stored(parsed(docs, doc_id, text, long_tokens), "line-tree")
    known = bounded(stored(recurring(tree, min_docs), "line-templates"))
    lines = tree.select("_id", "_h", F.posexplode("lines").alias("line", "keys")).select("_id", "_h", "line", F.explode("keys").alias("template"))
    gone = lines.join(known, "template").where(~F.col("_id").eqNullSafe(F.col("first"))).groupBy("_id", "_h").agg(F.collect_set("line").alias("_gone"))
    gone = gone.withColumnsRenamed({"_id": "_gid", "_h": "_gh"})
    keyed = packed(docs, _id=doc_id, _text=text).withColumn("_h", F.md5(F.coalesce(F.col("_text"), F.lit("")).cast("binary")))
    rows = keyed.join(gone, keyed["_id"].eqNullSafe(F.col("_gid")) & (keyed["_h"] == F.col("_gh")), "left")
    all_lines = F.split("_text", "\n")
    # in a row of one, so that the text is split once; places left by a set, so that time grows with the lines
    stays = lambda ls: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(ls) - 1), "_gone"), lambda i: F.get(ls, i)), "\n")
    left = F.get(F.transform(F.array(all_lines), stays), F.lit(0))
    return rows, {
        text: F.when(F.col("_gone").isNotNull(), left).otherwise(F.col("_text")),
        "n_lines": F.coalesce(F.when(F.col("_text").isNotNull(), F.size(all_lines)), F.lit(0)).cast("long"),
        "n_dropped": F.coalesce(F.when(F.col("_gone").isNotNull(), F.size("_gone")), F.lit(0)).cast("long"),
    }


def deduped(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_docs: int = MIN_DOCS, long_tokens: int = LONG_TOKENS) -> DataFrame:
    """``docs`` with the text's recurring lines gone, n_lines and n_dropped."""
    rows, new = _deduped(docs, doc_id, text, min_docs, long_tokens)
    return unpacked(rows, docs.columns, new, replaced=text)


def trimmed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n_chars: str = "n_chars", min_docs: int = MIN_DOCS) -> DataFrame:
    """``docs`` with the text's recurring lines gone and ``n_chars``, if there, counted anew; emptied documents go."""
    rows, new = _deduped(docs, doc_id, text, min_docs)
    rows = rows.select("_row", "_gone", new[text].alias("_left"))
    rows = filtered(rows, F.col("_gone").isNull() | (F.length(F.trim("_left", F.lit(SPACE_CHARS))) > 0))
    out = []
    for c in docs.columns:
        value = F.col("_row").getField(c)
        if c == text:
            value = F.col("_left")
        elif c == n_chars:
            value = F.when(F.col("_gone").isNotNull(), F.char_length("_left").cast(docs.schema[c].dataType)).otherwise(value)
        out.append(value.alias(c))
    return rows.select(*out)
