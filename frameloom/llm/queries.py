"""Registered queries of the operators: whole tables, production parameters, digest columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from frameloom.llm import bpe, ctw, decontaminate, linededup, merkle, packing, pii, quality, simhash, toxicity, urls, veccodes, warc
from frameloom.llm.common import ascii_lower, table


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text without the lines of recurring templates."""
    return linededup.deduped(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_lines", "n_dropped", "text")


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page archived and read back, in global capture order."""
    merged = warc.captured(table(spark, sf_dir, "pages"), "page_id", "url", "html")
    return merged.select(F.col("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "captured_at", "intact")


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's personal data: base counts and digest, and all spans."""
    found = pii.found(table(spark, sf_dir, "documents").select("doc_id", "text"), "text")
    count = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.sha2(pii.listed(F.filter("spans", lambda x: x["base"])), 256)
    score = F.round(F.aggregate("spans", F.lit(0.0), lambda acc, x: acc + x["score"]), 2)
    return found.select("doc_id", *map(count, ("email", "ip", "card", "phone")), base.alias("base_sha256"), pii.listed(F.col("spans")).alias("spans"), score.alias("total_score"))


def op4_ctw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's code length under the training part's context tree, and the base model's."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    remainder = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7, F.lit(0))
    out = ctw.scored(docs, "doc_id", "text", remainder != 2, direct=True)
    return out.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "code_bits")


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's byte-level BPE ids, and what they decode to, as digests."""
    import public_tokenizers

    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return bpe.encoded(table(spark, sf_dir, "documents"), "text", ["doc_id"], ranks, public_tokenizers.PATTERN, ids=False)


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint over 3-word shingles and its class at two bits."""
    marked = simhash.fingerprints(table(spark, sf_dir, "documents"), "doc_id", "text", width=3)
    return simhash.classes(marked, bits=2).select("doc_id", simhash.hex_fingerprint(F.col("fp")).alias("fingerprint"), "component_id")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's base measures and verdict."""
    judged = quality.judged(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


#: The fixed host and path rules of the URL filter.
URL_RULES = [
    urls.Rule("allow", "org", "/"),
    urls.Rule("block", "example.org", "/es/"),
    urls.Rule("block", "example.org", "/en/1"),
    urls.Rule("allow", "com", "/fr/"),
    urls.Rule("block", "com", "/de/"),
]


def op8_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's URL judged by the rules, else by trees fitted to what the rules judge."""
    return urls.judged(table(spark, sf_dir, "pages").select("page_id", "url"), "url", ["page_id"], URL_RULES)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's toxicity under a model learned from four fifths of the labels."""
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5, F.lit(0)) == 0
    model = toxicity.fitted(docs, labels, "doc_id", "text", "toxic", ~held)
    out = toxicity.scored(docs, "text", ["doc_id"], model)
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's words inside benchmark windows, and the items found."""
    docs, items = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark")
    rows = decontaminate.marked(docs, items)
    n_hit = decontaminate.covered(F.col("hits"))
    return rows.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("hit_items").cast("long").alias("n_items"), F.sha2(F.array_join("hit_items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces, and where they stand in sequences of 2048 tokens."""
    import public_tokenizers

    return packing.packed(table(spark, sf_dir, "documents"), "text", ["doc_id"], public_tokenizers.path("word_bpe_49k.json"), ids=False)


def op12_veccodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole vector's code of 16 parts, its error, and that of its label."""
    out, codebooks = veccodes.compressed(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", "label")
    return out.select("vec_id", "code", "error", "label_error", F.lit(codebooks.digest()).alias("codebooks_sha256"))


#: The columns that a document's leaf is the hash of.
LEAF_COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's leaf and proof, and the root that a later copy of it leads to."""
    docs = table(spark, sf_dir, "documents")
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    out = merkle.audited(docs, "doc_id", "source", LEAF_COLUMNS, {"text": ascii_lower(docs["text"])}, tampered)
    return out.select("doc_id", "leaf", "subroot", "root", merkle.proof_digest(F.col("left"), F.col("right")).alias("proof_sha256"), "folded_root", "verified")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_line_dedup": op1_line_dedup,
    "op2_warc": op2_warc,
    "op3_pii": op3_pii,
    "op4_ctw": op4_ctw,
    "op5_bpe": op5_bpe,
    "op6_simhash": op6_simhash,
    "op7_quality": op7_quality,
    "op8_urls": op8_urls,
    "op9_toxicity": op9_toxicity,
    "op10_decontaminate": op10_decontaminate,
    "op11_packing": op11_packing,
    "op12_veccodes": op12_veccodes,
    "op13_merkle": op13_merkle,
}

_WORDS = r"list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '')"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _quality_sql(rules: quality.Rules) -> str:
    """The same fences from exact quantiles: sketches are exact up to ``SKETCH_K`` values."""
    names = [n for n, _, _ in rules.features]
    q = lambda level: ", ".join(f"quantile_disc({n}, {p}) AS {level}_{n}_{k}" for n in names for p, k in ((0.25, 1), (0.75, 3)))
    use = lambda n, k: f"CASE WHEN g.n >= {rules.group_rows} THEN g_{n}_{k} WHEN l.n >= {rules.group_rows} THEN l_{n}_{k} ELSE a_{n}_{k} END"
    fences, tests = [], []
    for n, below, above in rules.features:
        spread = f"({use(n, 3)} - {use(n, 1)}) * {rules.reach}"
        if below is not None:
            fences.append(f"{use(n, 1)} - {spread} - {below} AS low_{n}")
            tests.append(f"m.{n} >= low_{n}")
        fences.append(f"{use(n, 3)} + {spread} + {above} AS high_{n}")
        tests.append(f"m.{n} <= high_{n}")
    return (
        rf"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(lang, '~') AS lang, coalesce(source, '~') AS source FROM documents),
        w AS (SELECT *, {_WORDS} AS ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^ 	-
]')) AS ls FROM d),
        win AS (SELECT doc_id, i, array_to_string(ws[i:i + 7], ' ') AS s FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM w)),
        rep AS (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, s) AS c FROM win) WHERE c > 1),
        r AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM rep GROUP BY 1),
        m0 AS (SELECT w.doc_id, lang, source, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars, length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
          length(t) - length(regexp_replace(t, '[A-Z!?]', '', 'g')) AS shout, len(ls) AS nl, len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words FROM w LEFT JOIN r ON w.doc_id = r.doc_id),
        m AS (SELECT *, word_chars / greatest(n_words, 1) AS word_length, n_symbols / greatest(n_words, 1) AS symbol_ratio, shout / greatest(word_chars, 1) AS shout_ratio, n_dup_lines / greatest(nl, 1) AS dup_line_ratio FROM m0),
        k AS (SELECT * FROM m WHERE n_words >= {rules.min_words}), """
        + f"g AS (SELECT lang, source, count(*) AS n, {q('g')} FROM k GROUP BY 1, 2), l AS (SELECT lang, count(*) AS n, {q('l')} FROM k GROUP BY 1), a AS (SELECT {q('a')} FROM k), "
        + f"f AS (SELECT g.lang, g.source, {', '.join(fences)} FROM g JOIN l ON g.lang = l.lang, a), "
        + f"b AS (SELECT m.*, n_words < {rules.min_words} OR 100 * n_repeat_words > {rules.max_repeat_percent} * n_words AS base_failed FROM m) "
        + f"SELECT m.doc_id, m.n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND coalesce({' AND '.join(tests)}, true) AS kept FROM b m LEFT JOIN f ON m.lang = f.lang AND m.source = f.source"
    )


def _line_sql() -> str:
    d, b, least = linededup.DEPTH, linededup.BLOCKS, linededup.MIN_TOKENS
    size = f"CAST(ceil((len(k) - {d}) / {b}) AS BIGINT)"
    wild = " ".join(f"UNION ALL SELECT doc_id, no, '{i}|' || len(k) || '|' || array_to_string(k[1:{d} + {i} * {size}], ' ') || '|<*>|' || array_to_string(k[{d} + {i + 1} * {size} + 1:], ' ') FROM tk WHERE len(k) >= {least}" for i in range(b))
    return rf"""WITH l AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents), e AS (SELECT doc_id, ls[i] AS t, i AS no FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM l)),
        tk AS (SELECT * FROM (SELECT doc_id, no, list_transform({_WORDS}, lambda x: CASE WHEN regexp_matches(x, '[0-9]') THEN '<*>' ELSE x END) AS k FROM e) WHERE len(k) > 0),
        keys AS (SELECT doc_id, no, CASE WHEN len(k) >= {linededup.LONG_TOKENS} THEN '==' ELSE '=' END || array_to_string(k, ' ') AS key FROM tk {wild}),
        rec AS (SELECT key, min(doc_id) AS first FROM keys GROUP BY 1 HAVING count(DISTINCT doc_id) >= CASE WHEN key LIKE '==%' THEN 2 ELSE {linededup.MIN_DOCS} END),
        gone AS (SELECT doc_id, list(DISTINCT no) AS g FROM keys JOIN rec ON keys.key = rec.key WHERE doc_id <> first GROUP BY 1)
        SELECT l.doc_id, coalesce(len(ls), 0) AS n_lines, coalesce(len(g), 0) AS n_dropped, CASE WHEN g IS NULL THEN text ELSE array_to_string(list_transform(list_filter(range(1, len(ls) + 1), lambda i: NOT list_contains(g, i)), lambda i: ls[i]), chr(10)) END AS text FROM l LEFT JOIN gone ON l.doc_id = gone.doc_id"""


_DECONTAMINATE_SQL = rf"""WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
    b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
    bw AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + 9], ' ') AS s FROM (SELECT *, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
    dw AS (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS s FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw))),
    m AS (SELECT doc_id, i, dw.n, item_id FROM dw JOIN bw ON dw.s = bw.s AND dw.n = bw.n),
    h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM m) GROUP BY 1),
    it AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM m GROUP BY 1)
    SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN h ON d.doc_id = h.doc_id LEFT JOIN it ON d.doc_id = it.doc_id"""

_WARC_SQL = """WITH p AS (SELECT page_id, url, coalesce(html, '') AS h FROM pages), m AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS keep, strlen(h) AS bytes FROM p),
    r AS (SELECT *, bytes >= 1000 AND keep <> page_id AS again, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE coalesce(url, '') END AS rest FROM m), u AS (SELECT *, regexp_extract(rest, '^[^/?#]*') AS host FROM r)
    SELECT page_id, bytes AS payload_bytes, sha1(h) AS payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN again THEN keep END AS refers_to,
    CASE WHEN rest = '' THEN '' ELSE array_to_string(list_reverse(string_split(split_part(lower(regexp_replace(host, '^.*@', '')), ':', 1), '.')), ',') || ')' || coalesce(nullif(substr(rest, length(host) + 1), ''), '/') END AS url_key,
    strftime(make_timestamp((1704067200 + page_id % 31536000) * 1000000), '%Y-%m-%dT%H:%M:%SZ') AS captured_at, true AS intact FROM u"""


def _veccodes_sql() -> str:
    """Every part against every entry: two rounds of floored means, then the codes."""
    parts, entries = veccodes.PARTS, veccodes.ENTRIES
    near = lambda k: f"d{k} AS (SELECT vec_id, label, part, min({{'d': list_sum(list_transform(list_zip(p.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT, 'e': entry}}) AS m FROM p JOIN c{k} c USING (part) GROUP BY 1, 2, 3)"
    mean = (
        lambda k: f"s{k} AS (SELECT part, m.e AS entry, j, floor(sum(x) / count(*))::BIGINT AS x FROM (SELECT d.part, d.m, unnest(p.v) AS x, unnest(range(1, len(p.v) + 1)) AS j FROM d{k} d JOIN p USING (vec_id, part)) GROUP BY 1, 2, 3), "  # noqa: E731
        f"c{k + 1} AS (SELECT c.part, c.entry, coalesce(u.v, c.v) AS v FROM c{k} c LEFT JOIN (SELECT part, entry, list(x ORDER BY j) AS v FROM s{k} GROUP BY 1, 2) u ON u.part = c.part AND u.entry = c.entry)"
    )
    return (
        "WITH k AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0), "
        f"p AS (SELECT vec_id, label, g AS part, v[g * (len(v) // {parts}) + 1:(g + 1) * (len(v) // {parts})] AS v FROM k, (SELECT unnest(range({parts})) AS g)), "
        f"c0 AS (SELECT part, rank - 1 AS entry, v FROM p JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) AS rank FROM k QUALIFY rank <= {entries}) USING (vec_id)), "
        + ", ".join(f"{near(k)}, {mean(k)}" for k in range(veccodes.ROUNDS))
        + f", {near(veccodes.ROUNDS)}, o AS (SELECT vec_id, label, string_agg(printf('%02x', m.e), '' ORDER BY part) AS code, sum(m.d)::BIGINT AS error FROM d{veccodes.ROUNDS} GROUP BY 1, 2) "
        + f"SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY part, entry)) FROM c{veccodes.ROUNDS}) AS codebooks_sha256 FROM o"
    )


def _merkle_sql(depths: tuple[int, int] = (6, 3)) -> str:
    """Trees of at most 16 to the power of ``depths`` leaves: one step a level, from the leaves to the root and back."""
    f = merkle.FANOUT
    value = lambda c: f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')"
    leaf = lambda text: f"sha256({' || '.join(value(c) for c in LEAF_COLUMNS[:-1])} || {value(text)})"
    crc = "list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda d: ord(d)::BIGINT)), lambda c, d: list_reduce([xor(c, d), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x // 2, 3988292384 * (x % 2))))"
    out = [
        f"WITH l AS (SELECT doc_id, source, {leaf('text')} AS leaf, {leaf(f"translate(text, '{_UPPER}', '{_LOWER}')")} AS changed, xor({crc}, 4294967295) % 5 = 0 AS t, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS i FROM documents)",
        "a0 AS (SELECT coalesce('s' || source, '') AS s, i, leaf AS h FROM l)",
    ]

    def tree(name: str, depth: int) -> None:
        for k in range(depth):
            run = f"OVER (PARTITION BY s, i // {f} ORDER BY i ROWS BETWEEN"
            sides = ", ".join(f"CASE WHEN count(*) OVER (PARTITION BY s) > 1 THEN coalesce(string_agg(h, '') {run} {rows}), '') ELSE '' END AS {side}" for side, rows in (("le", "UNBOUNDED PRECEDING AND 1 PRECEDING"), ("ri", "1 FOLLOWING AND UNBOUNDED FOLLOWING")))
            out.append(f"{name}w{k} AS (SELECT s, i, h, {sides}, count(*) OVER (PARTITION BY s) AS n FROM {name}{k})")
            out.append(f"{name}{k + 1} AS (SELECT s, i // {f} AS i, CASE WHEN max(n) > 1 THEN sha256(string_agg(h, '' ORDER BY i)) ELSE max(h) END AS h FROM {name}w{k} GROUP BY 1, 2)")

    tree("a", depths[0])
    out.append(f"b0 AS (SELECT '' AS s, row_number() OVER (ORDER BY s) - 1 AS i, h, s AS src FROM a{depths[0]})")
    tree("b", depths[1])
    out.append(f"p0 AS (SELECT l.*, coalesce('s' || source, '') AS s, CASE WHEN t THEN coalesce(changed, leaf) ELSE leaf END AS fold, '' AS proof, b0.i AS bi, b0.h AS subroot FROM l JOIN b0 ON b0.src = coalesce('s' || source, ''))")
    at = 0
    for name, depth, s, i in (("a", depths[0], "p.s", "p.i"), ("b", depths[1], "''", "p.bi")):
        for k in range(depth):
            step = f"CASE WHEN w.n > 1 THEN sha256(w.le || p.fold || w.ri) ELSE p.fold END AS fold, p.proof || w.le || w.ri AS proof"
            out.append(f"p{at + 1} AS (SELECT p.* EXCLUDE (fold, proof), {step} FROM p{at} p JOIN {name}w{k} w ON w.s = {s} AND w.i = {i} // {f**k})")
            at += 1
    root = f"(SELECT max(h) FROM b{depths[1]})"
    return ", ".join(out) + f" SELECT doc_id, leaf, subroot, {root} AS root, sha256(proof) AS proof_sha256, fold AS folded_root, fold = {root} AS verified FROM p{at}"


ORACLE: dict[str, str] = {
    "op1_line_dedup": _line_sql(),
    "op2_warc": _WARC_SQL,
    "op7_quality": _quality_sql(quality.Rules()),
    "op10_decontaminate": _DECONTAMINATE_SQL,
    "op12_veccodes": _veccodes_sql(),
    "op13_merkle": _merkle_sql(),
}
