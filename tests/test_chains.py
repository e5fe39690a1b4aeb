"""Chains verified in ranges, signatures, and identification by regions."""

from __future__ import annotations

import base64
import json

import pytest
from pyspark.sql import functions as F

from frameloom.operators import genome, signatures
from frameloom.plans import case
from frameloom.plans.images import GENOME, as_range
from frameloom.sources import images, synthetic

GENESIS = "0" * 64
# Test vectors 2 and 3 of RFC 8032: seed, public key, message, signature.
VECTORS = [
    ("4ccd089b28ff96da9db6c346ec114e0f5b8a319f35aba624da8cf6ed4fb8a6fb", "3d4017c3e843895a92b70aa74d1b7ebc9c982ccf2ec4968cc0cd55f12af4660c", "72", "92a009a9f0d4cab8720e820b5f642540a2b27b5416503f8fb3762223ebdb69da085ac1e43e15996e458f3613d0f11d8c387b2eaeb4302aeeb00d291612bb0c00"),
    ("c5aa8df43f9f837bedb7442f31dcb7b166d38535076f094b85ce3a2e0b4458f7", "fc51cd8e6218a1a38da47ed00230f0580816ed13ba3303ac5deb911548908025", "af82", "6291d657deec24024827e69c3abe01a30ce548a284743a445e3680d7db5ac3ac18ff9b538d16f290ae67f760984dc6594a7c15e9716ed28dc027beceea1ec40a"),
]


@pytest.mark.parametrize("seed, key, message, signature", VECTORS)
def test_signatures_of_the_standard(seed, key, message, signature):
    seed, key, message, signature = map(bytes.fromhex, (seed, key, message, signature))
    assert signatures.public_key(seed) == key and signatures.sign(seed, message) == signature and signatures.holds(key, message, signature)
    assert not signatures.holds(key, message + b"x", signature) and not signatures.holds(key, message, signature[:-1] + b"\xff")
    assert not signatures.holds(key, message, signature[:32] + (int.from_bytes(signature[32:], "little") + signatures.ORDER).to_bytes(32, "little"))
    assert not signatures.holds(b"\xff" * 32, message, signature) and not signatures.holds(key[:5], message, b"")


SEEDS = {"ann": bytes(range(32)), "bob": bytes(range(1, 33))}
KEYS = {k: signatures.public_key(v).hex() for k, v in SEEDS.items()}


def signed(actor: str, digest: str) -> str:
    return base64.b64encode(signatures.sign(SEEDS[actor], digest.encode())).decode()


def verified(spark, tmp_path, lines, **k):
    path = tmp_path / f"log-{len(list(tmp_path.iterdir()))}.jsonl"
    path.write_text("\n".join(lines) + "\n")
    r = case.custody_verified(case.custody_log(spark, str(path)), GENESIS, **k).first()
    return r.n_entries, r.first_bad, r.head_hash


@pytest.mark.parametrize("pieces", [1, 4, 11])
def test_one_chain_in_many_ranges(spark, tmp_path, pieces):
    lines = case.custody_lines([{"actor": ("ann", "bob")[i % 2], "action": f"a{i}", "details": {"n": i}} for i in range(24)], GENESIS, sign=signed)
    head = json.loads(lines[-1])["entry_hash"]
    assert verified(spark, tmp_path, lines, pieces=pieces) == (24, None, head)
    assert verified(spark, tmp_path, lines[::-1], keys=KEYS, pieces=pieces) == (24, None, head)
    changed = [x.replace('"action":"a12"', '"action":"b12"') for x in lines]
    assert verified(spark, tmp_path, changed, pieces=pieces) == (24, 13, None)
    assert verified(spark, tmp_path, lines[:7] + lines[8:], pieces=pieces)[1] == 9
    assert verified(spark, tmp_path, lines[3:], pieces=pieces)[1] == 4
    other = [json.dumps({**json.loads(x), "signature": signed("ann", json.loads(x)["entry_hash"])}, sort_keys=True, separators=(",", ":")) if i == 17 else x for i, x in enumerate(lines)]
    assert verified(spark, tmp_path, other, pieces=pieces) == (24, None, head)
    assert verified(spark, tmp_path, other, keys=KEYS, pieces=pieces) == (24, 18, None)
    assert verified(spark, tmp_path, lines, keys={"ann": KEYS["ann"]}, pieces=pieces)[1] == 2
    assert verified(spark, tmp_path, lines, keys={}, pieces=pieces)[1] == 1


def test_unsigned_entries_fail_only_where_keys_are_asked_for(spark, tmp_path):
    lines = case.custody_lines([{"actor": "ann", "action": "x"}] * 3, GENESIS)
    assert verified(spark, tmp_path, lines)[1] is None and verified(spark, tmp_path, lines, keys=KEYS)[1] == 1


def test_signed_exports(spark):
    text = '{"export":"e"}'
    mark = base64.b64encode(signatures.sign(SEEDS["ann"], text.encode())).decode()
    rows = [("ok", "v", "m", text, "ann", mark), ("forged", "v", "m", text + " ", "ann", mark), ("bare", "v", "m", text, "ann", None), ("who", "w", "m", text, "eve", mark), ("junk", "v", "m", text, "ann", "%%%")]
    claims = spark.createDataFrame(rows, "export_id string, video_sha256 string, manifest_sha256 string, manifest string, examiner string, signature string")
    found = claims.select("export_id", F.lit("v").alias("video_sha256"), "manifest_sha256")
    got = {r.export_id: (r.valid, list(r.reasons)) for r in case.export_verified(claims, found, keys=KEYS).collect()}
    assert got == {
        "ok": (True, []),
        "forged": (False, ["signature does not hold"]),
        "bare": (False, ["not signed"]),
        "who": (False, ["video hash differs", "no key of examiner eve"]),
        "junk": (False, ["signature does not hold"]),
    }


@pytest.mark.parametrize("size", [100, 4096, 1 << 20])
def test_regions_order_and_fields(spark, tmp_path, size):
    data = bytearray(synthetic.dh_image())
    data[0x0FFC:0x100C] = b"XVR-GENERIC-2026"  # ends beyond its region
    data += b"HIKBTREE" + b"IMKH"
    path = tmp_path / "image.raw"
    path.write_bytes(data)
    rows = genome.matched(images.evidence(spark, str(path), overlap=64, window=size), GENOME, as_range(spark, bytes(data), name=str(path))).orderBy("place").collect()
    assert [(r.family, r.confidence, r.model, r.serial) for r in rows] == [("dhsim", 0.9, "XVR-5104", "SN0042"), ("hiksim", 0.3, None, None), ("hwsim", 0.0, None, None), ("xsim", 0.0, None, None), ("gensim", 0.0, None, None)]
    assert len(rows[0].evidence) == 2 and rows[0].evidence[0].endswith("at 0x0 (weight 0.7)") and rows[2].evidence == []


def test_ties_stand_in_the_order_of_the_genome_and_weights_are_capped(spark):
    families = [genome.Family("b", (genome.Signature(b"xy", 0.5), genome.Signature(b"yz", 0.4))), genome.Family("a", (genome.Signature(b"xyz", 0.9, 2),)), genome.Family("c", (genome.Signature(b"xyz", 0.8), genome.Signature(b"z", 0.8, 0, 3)))]
    rows = genome.matched(as_range(spark, b"xyz.xyz"), families).orderBy("place").collect()
    assert [(r.family, r.confidence) for r in rows] == [("c", 1.0), ("b", 0.9), ("a", 0.9)]
    assert rows[2].evidence == ["signature 'xyz' at 0x4 (weight 0.9)"]


def test_genome_files(tmp_path):
    path = tmp_path / "genome.json"
    path.write_text(json.dumps([{"family": "f", "tier": "A", "signatures": [{"bytes": "DH\\u0000", "where": {"start": 4, "end": 9}, "weight": 0.7}, {"bytes": "x", "where": "any", "weight": 1}], "model_at": {"offset": 3, "len": 2}}]))
    (family,) = genome.read_genome(str(path))
    assert family.signatures == (genome.Signature(b"DH\0", 0.7, 4, 9), genome.Signature(b"x", 1.0, 0, genome.ANYWHERE)) and family.model_at == (3, 2) and family.serial_at is None
