"""Quality rules with adaptive thresholds from mergeable quantile sketches.

Fixed rules come first (too few words, too much repetition). Beyond them no cutoff is
fixed: for every language and source a KLL sketch holds the distribution of each
feature, and a document is an outlier if it lies outside the Tukey fences of its own
group. Sketches merge, so those of thin groups are replaced by the merged sketch of
their language, and thin languages by that of all; nothing is read again for it.

Everything is DataFrame expressions. Sketches are built by partial aggregation, so a
source with a third of all rows adds one sketch a task to the shuffle; thresholds are
a row per group and are stored before use, because a sketch of more than ``SKETCH_K``
values is randomised and every later job must see the same fences.

Defined cases: null text has no words; null language or source is a group of its
own; an empty table gives an empty result; repeated rows are judged alike.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from frameloom.llm.common import SPACE_CLASS, bounded, filtered, packed, stored, unpacked, words

#: Values a sketch holds exactly; rank error beyond is about 2.3 / SKETCH_K ** 0.9.
SKETCH_K = 2048
WINDOW = 8


@dataclass(frozen=True)
class Rules:
    """Parameters. A fence lies ``reach`` quartile ranges beyond the quartile, plus ``slack``."""

    min_words: int = 20
    max_repeat_percent: int = 30
    group_rows: int = 100
    reach: float = 4.0
    #: feature: (slack below or None for no lower fence, slack above)
    features: tuple = (("word_length", 1.0, 1.0), ("symbol_ratio", None, 0.1), ("shout_ratio", None, 0.15), ("dup_line_ratio", None, 0.5))


def _count(text: Column, chars: str) -> Column:
    return F.char_length(text) - F.char_length(F.regexp_replace(text, f"[{chars}]", ""))


def _windows(h: Column, n: Column) -> Column:
    """Hashes of every run of eight elements, by doubling."""
    for step in (1, 2, 4):
        n = n - step
        h = F.zip_with(F.slice(h, F.lit(1), n), F.slice(h, F.lit(1 + step), n), lambda a, b: F.xxhash64(a, b))
    return h


def measured(docs: DataFrame, text: str, repeats: bool = True) -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines and the features; n_repeat_words if asked.

    No shuffle: each text is measured within its own row.
    """
    body = F.coalesce(docs[text], F.lit(""))
    out = docs.withColumn("_w", words(body)).withColumn("n_words", F.size("_w").cast("long"))
    lines = F.filter(F.split(body, "\n"), lambda x: x.rlike(f"[^{SPACE_CLASS}]"))
    out = (
        out.withColumn("word_chars", F.char_length(F.array_join("_w", "")).cast("long"))
        .withColumn("n_symbols", _count(body, "#*$%&|<>").cast("long"))
        .withColumn("_shout", _count(body, "A-Z!?").cast("long"))
        .withColumn("_l", lines)
        .withColumn("_nl", F.size("_l"))
        .withColumn("n_dup_lines", (F.col("_nl") - F.size(F.array_distinct("_l"))).cast("long"))
    )
    if repeats:
        out = out.withColumn("_h", F.when(F.col("n_words") >= WINDOW, F.transform("_w", lambda x: F.xxhash64(x))))
        out = out.withColumn("_h8", _windows(F.col("_h"), F.col("n_words").cast("int")))
        out = out.withColumn("_s", F.when(F.size(F.array_distinct("_h8")) < F.size("_h8"), F.sort_array(F.transform("_h8", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))))
        twice = F.filter("_s", lambda x, i: F.coalesce(F.when(i > 0, F.get(F.col("_s"), i - 1)["h"]) == x["h"], F.lit(False)) | F.coalesce(F.get(F.col("_s"), i + 1)["h"] == x["h"], F.lit(False)))
        out = out.withColumn("_at", F.sort_array(F.transform(twice, lambda x: x["i"])))
        k = F.size("_at") - 1
        gaps = F.zip_with(F.slice("_at", F.lit(1), k), F.slice("_at", F.lit(2), k), lambda a, b: F.least(b - a, F.lit(WINDOW)))
        covered = F.aggregate(gaps, F.lit(WINDOW), lambda acc, x: acc + x)
        out = out.withColumn("n_repeat_words", F.coalesce(F.when(F.col("_at").isNotNull(), covered), F.lit(0)).cast("long"))
    n = F.greatest("n_words", F.lit(1))
    return (
        out.withColumn("word_length", F.col("word_chars") / n)
        .withColumn("symbol_ratio", F.col("n_symbols") / n)
        .withColumn("shout_ratio", F.col("_shout") / F.greatest("word_chars", F.lit(1)))
        .withColumn("dup_line_ratio", F.col("n_dup_lines") / F.greatest("_nl", F.lit(1)))
        .drop("_w", "_l", "_nl", "_shout", "_h", "_h8", "_s", "_at")
    )


def sketches(docs: DataFrame, text: str, lang: str, source: str, rules: Rules) -> DataFrame:
    """A KLL sketch of each feature for every language and source, with the rows behind it."""
    rows = measured(docs.select(docs[text].alias("_text"), docs[lang].alias("_lang"), docs[source].alias("_source")), "_text", repeats=False)
    rows = rows.where(F.col("n_words") >= rules.min_words)
    aggs = [F.kll_sketch_agg_double(name, F.lit(SKETCH_K)).alias(name) for name, _, _ in rules.features]
    return rows.groupBy("_lang", "_source").agg(F.count("*").alias("_n"), *aggs)


def thresholds(sketched: DataFrame, rules: Rules) -> DataFrame:
    """Fences low_ and high_ of each feature for every language and source, by merging thin groups upwards."""
    names = [name for name, _, _ in rules.features]

    def merged(level: str, *keys: str) -> DataFrame:
        return sketched.groupBy(*keys).agg(F.sum("_n").alias(f"_n_{level}"), *(F.kll_merge_agg_double(name).alias(f"{level}_{name}") for name in names))

    by_lang = bounded(stored(merged("lang", "_lang").withColumnRenamed("_lang", "_llang"), "language-sketches"))
    whole = F.broadcast(merged("all"))  # one row
    out = sketched.join(by_lang, F.col("_lang").eqNullSafe(F.col("_llang"))).drop("_llang").join(whole, F.lit(True))
    cols = [F.col("_lang"), F.col("_source")]
    for name, below, above in rules.features:
        sketch = F.when(F.col("_n") >= rules.group_rows, F.col(name)).when(F.col("_n_lang") >= rules.group_rows, F.col(f"lang_{name}")).otherwise(F.col(f"all_{name}"))
        q1, q3 = (F.kll_sketch_get_quantile_double(sketch, F.lit(q)) for q in (0.25, 0.75))
        spread = (q3 - q1) * rules.reach
        cols.append((q1 - spread - (below or 0) if below is not None else F.lit(float("-inf"))).alias(f"low_{name}"))
        cols.append((q3 + spread + above).alias(f"high_{name}"))
    return out.select(*cols)


MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _judged(docs: DataFrame, text: str, lang: str, source: str, rules: Rules) -> DataFrame:
    fences = stored(thresholds(stored(sketches(docs, text, lang, source, rules), "sketches"), rules), "fences")
    fences = fences.withColumnsRenamed({"_lang": "_flang", "_source": "_fsource"})
    rows = measured(packed(docs, _text=text, _lang=lang, _source=source), "_text")
    failed = (F.col("n_words") < rules.min_words) | (100 * F.col("n_repeat_words") > rules.max_repeat_percent * F.col("n_words"))
    inside = F.lit(True)
    for name, _, _ in rules.features:
        inside = inside & F.coalesce(F.col(name).between(F.col(f"low_{name}"), F.col(f"high_{name}")), F.lit(True))
    rows = rows.join(bounded(fences), F.col("_lang").eqNullSafe(F.col("_flang")) & F.col("_source").eqNullSafe(F.col("_fsource")), "left")
    return rows.withColumn("base_failed", failed).withColumn("kept", ~failed & inside)


def judged(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", rules: Rules = Rules()) -> DataFrame:
    """``docs`` with the measures, ``base_failed`` and ``kept``.

    Groups without a fence (all their documents fail the fixed rules) keep nothing to compare with and pass it.
    """
    out = _judged(docs, text, lang, source, rules)
    return unpacked(out, docs.columns, {n: F.col(n) for n in (*MEASURES, "base_failed", "kept")})


def passing(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", rules: Rules = Rules()) -> DataFrame:
    """The documents that the rules keep, with their own columns only."""
    return unpacked(filtered(_judged(docs, text, lang, source, rules), F.col("kept")), docs.columns)
