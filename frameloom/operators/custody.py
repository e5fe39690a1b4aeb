"""Hash-chained logs, Merkle roots, manifests and content ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from frameloom.operators.segments import scanned, segmented


def canonical(fields: dict[str, tuple[Column, bool]]) -> Column:
    """Canonical JSON of a flat record: keys sorted, no spaces, nulls written. ``fields``: (value, is_text)."""
    out: list[Column] = []
    for name in sorted(fields):
        value, text = fields[name]
        shown = F.concat(F.lit('"'), F.regexp_replace(value, r'(["\\])', r"\\$1"), F.lit('"')) if text else value.cast("string")
        out.append(F.concat(F.lit(f'"{name}":'), F.coalesce(shown, F.lit("null"))))
    return F.concat(F.lit("{"), F.concat_ws(",", *out), F.lit("}"))


def content_id(prefix: str, text: Column, digits: int = 16) -> Column:
    return F.concat(F.lit(f"{prefix}_"), F.substring(F.sha2(text, 256), 1, digits))


def first_broken(log: DataFrame, keys: list[str], seq: str, prev: str, own: str, expected: Column, genesis: str, holds: Column | None = None, segments: int | None = None) -> DataFrame:
    """Per chain: entries, the first sequence number whose number, link, hash or (with ``holds``) signature is wrong, null if none, and then the head's hash.

    A chain is verified in ranges of its numbers, and links are compared across their edges: one chain of any length is
    spread over tasks. Null links, hashes and signatures are wrong.
    """
    rows = log.select(*keys, F.col(seq).alias("_seq"), F.col(prev).alias("_prev"), F.col(own).alias("_own"), expected.alias("_expected"), (F.lit(True) if holds is None else holds).alias("_holds"))
    where = (keys, ["_seq"])
    linked = scanned(segmented(rows, *where, segments), *where, sums={"_place": F.lit(1)}, lag={"_before": F.col("_own")})
    right = (F.col("_prev") == F.coalesce("_before", F.lit(genesis))) & (F.col("_own") == F.col("_expected")) & (F.col("_seq") == F.col("_place")) & F.col("_holds")
    out = linked.groupBy(*keys).agg(F.count("*").alias("n_entries"), F.min(F.when(~F.coalesce(right, F.lit(False)), F.col("_seq"))).alias("first_bad"), F.max_by("_own", "_seq").alias("head_hash"))
    return out.withColumn("head_hash", F.when(F.col("first_bad").isNull(), F.col("head_hash")))


def merkle_root(leaves: DataFrame, keys: list[str], place: str, leaf: str) -> DataFrame:
    """Root of pairwise SHA-256 over each key's leaves in order of place; the last of an odd level pairs with itself.

    One aggregation a level, halving the rows each time; leaves are hex digests and hash as bytes.
    """
    w = Window.partitionBy(*keys).orderBy(place)
    level = leaves.select(*keys, (F.row_number().over(w) - 1).cast("long").alias("_i"), F.col(leaf).alias("_h"))
    most = leaves.groupBy(*keys).count().agg(F.max("count")).first()[0] or 1
    while most > 1:
        pair = F.sort_array(F.collect_list(F.struct("_i", "_h")))
        level = level.groupBy(*keys, F.floor(F.col("_i") / 2).cast("long").alias("_p")).agg(pair.alias("_l"), F.max("_i").alias("_m"))
        both = F.concat(F.unhex(F.get("_l", F.lit(0))["_h"]), F.unhex(F.coalesce(F.get("_l", F.lit(1))["_h"], F.get("_l", F.lit(0))["_h"])))
        n = F.count("*").over(Window.partitionBy(*keys))
        single = (n == 1) & (F.size("_l") == 1)
        level = level.select(*keys, F.col("_p").alias("_i"), F.when(single, F.get("_l", F.lit(0))["_h"]).otherwise(F.sha2(both, 256)).alias("_h"))
        most = (most + 1) // 2
    return level.select(*keys, F.col("_h").alias("root"))


def appended(log: DataFrame, entries: list[dict], genesis: str) -> list[dict]:
    """The next entries of one chain with seq, prev_hash and entry_hash; a single writer calls this."""
    import hashlib
    import json

    last = log.orderBy(F.col("seq").desc()).limit(1).collect()
    seq, prev = (last[0]["seq"], last[0]["entry_hash"]) if last else (0, genesis)
    out = []
    for e in entries:
        seq += 1
        body = json.dumps({**e, "seq": seq, "prev_hash": prev}, sort_keys=True, separators=(",", ":"), ensure_ascii=True, allow_nan=False)
        prev_was, prev = prev, hashlib.sha256(body.encode()).hexdigest()
        out.append({**e, "seq": seq, "prev_hash": prev_was, "entry_hash": prev})
    return out
