"""The operators made of DataFrame expressions, against plain Python on small tables."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from frameloom.llm import decontaminate, linededup, pii, quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


# personal data ---------------------------------------------------------------------------------


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    digits = lambda m: re.sub("[^0-9]", "", m)
    kinds = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 14 <= len(digits(m)) <= 19 and luhn(digits(m))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 10 <= len(digits(m)) <= 15),
    ]
    return sorted((m.start(), k, m.end(), name) for k, (name, p, good) in enumerate(kinds) for m in re.finditer(p, text) if good(m.group()))


PII_TEXTS = [
    None, "", "a@b.c_d@e.f", "x@y", "mail: é😀 jo.do+x@mail-1.example.com, +1 (555) 010-9999!", "1.2.3.4.5.6.7.8 256.1.1.1 00001.2.3.4 999.1.2.3.4",
    "4111 1111 1111 1111 and 4111-1111-1111-1112", "12345678901234567890123", "+1+22 33 44 55 66 77", "9" * 30000, "a" * 30000 + "@", "1 " * 20000, "4 1 1 1 1 1 1 1 1 1 1 1 1 1 1 1",
    "@@..@a.b@c.d", "+49 30 1234567-", "٤٤٤٤.1.2.3.4", "account DE89 3704 0044 0532 0130 00 ok", "DE88370400440532013000", "ssn 123-45-6789 or 123-45-6780",
]


def test_base_spans(docs):
    rnd = random.Random(3)
    texts = PII_TEXTS + ["".join(rnd.choice("a@.+1 2-(é😀_)9.") for _ in range(rnd.randint(0, 60))) for _ in range(400)]
    out = {r.doc_id: r.spans for r in pii.found(docs(texts), "text").collect()}
    for i, t in enumerate(texts):
        got = [(s.start, s.rank, s.end, s.kind) for s in out[i] if s.base]
        assert got == base_spans(t or ""), t[:80]
        assert all((t or "")[s.start : s.end] == s.text for s in out[i])


def test_added_kinds_and_scores(docs):
    out = {r.doc_id: {s.kind: s for s in r.spans} for r in pii.found(docs(PII_TEXTS), "text").collect()}
    by_text = dict(zip(PII_TEXTS, out.values(), strict=True))
    assert by_text["account DE89 3704 0044 0532 0130 00 ok"]["iban"].score == pytest.approx(0.9)
    assert "iban" not in by_text["DE88370400440532013000"]
    assert by_text["ssn 123-45-6789 or 123-45-6780"]["ssn"].start in (4, 19)


def test_pii_keeps_clashing_columns_and_empty_tables(docs):
    assert set(pii.found(docs([]), "text").columns) >= {"doc_id", "n_words", "spans"}
    assert pii.found(docs([]), "text").count() == 0


# quality ---------------------------------------------------------------------------------------


def measures(text: str | None) -> tuple:
    text = text or ""
    w = WORD.findall(text)
    windows = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    hit = [False] * len(w)
    for i in range(len(w) - 7):
        if windows[tuple(w[i : i + 8])] > 1:
            hit[i : i + 8] = [True] * 8
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), sum(hit)


def test_measures(docs):
    rnd = random.Random(6)
    texts = [None, "", " \n\t", "one", "a b c d e f g h a b c d e f g h", "x " * 300, "l\nl\n\n \nl\n", "#*$%&|<> é😀\x0bq\x1cr"]
    texts += [" ".join(rnd.choice("abc") for _ in range(rnd.randint(0, 60))) + rnd.choice(["", "\n", "\na b\na b"]) for _ in range(200)]
    out = {r.doc_id: r for r in quality.judged(docs(texts)).collect()}
    for i, t in enumerate(texts):
        r = out[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == measures(t), repr(t)
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
        assert not (r.base_failed and r.kept)


def test_fences_reject_outliers_and_keep_the_rest(docs):
    rnd = random.Random(7)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(3, 7)))
    clean = [" ".join(word() for _ in range(60)) for _ in range(150)]
    odd = [" ".join(word() + "$$$" for _ in range(60)), " ".join(word().upper() + "!!" for _ in range(60)), " ".join(word() * 4 for _ in range(60))]
    kept = quality.passing(docs(clean + odd))
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars", "n_words"]
    assert sorted(r.doc_id for r in kept.collect()) == list(range(150))
    assert quality.passing(docs([])).count() == 0


# line dedup ------------------------------------------------------------------------------------


def brute_lines(rows: list[tuple[int, str | None]], min_docs: int) -> dict[int, tuple[str | None, int]]:
    def names(line: str) -> list:
        t = WORD.findall(line)
        t = [linededup.WILDCARD if re.search("[0-9]", x) else x for x in t]
        if not t:
            return []
        out = [("whole", tuple(t))]
        if len(t) >= linededup.MIN_TOKENS:
            size = -(-(len(t) - linededup.DEPTH) // linededup.BLOCKS)
            for b in range(linededup.BLOCKS):
                at = linededup.DEPTH + b * size
                out.append((b, len(t), tuple(t[:at]), tuple(t[at + size :])))
        return out

    held, first = Counter(), {}
    for i, text in rows:
        for name in {n for line in (text or "").split("\n") for n in names(line)}:
            held[name] += 1
            first[name] = min(i, first.get(name, i))
    out = {}
    for i, text in rows:
        lines = (text or "").split("\n")
        keep = [x for x in lines if not any(held[n] >= min_docs and first[n] != i for n in names(x))]
        out[i] = (None if text is None else "\n".join(keep), len(lines) - len(keep))
    return out


def test_line_dedup(docs):
    rnd = random.Random(12)
    shared = ["Subscribe to our newsletter today", "Posted on 2024-01-%02d by admin", "Home", "the cat sat on the %s mat again today"]
    texts = [None, "", "\n\n", "Home\nHome"]
    for i in range(60):
        lines = [" ".join(rnd.choice("abcdefghij") * rnd.randint(1, 3) for _ in range(rnd.randint(1, 12))) for _ in range(rnd.randint(0, 5))]
        for s in rnd.sample(shared, rnd.randint(0, 3)):
            lines.insert(rnd.randint(0, len(lines)), s % (i % 28) if "%02d" in s else s.replace("%s", f"w{i}x"))
        texts.append("\n".join(lines))
    want = brute_lines(list(enumerate(texts)), linededup.MIN_DOCS)
    out = linededup.deduped(docs(texts))
    assert {r.doc_id: (r.text, r.n_dropped) for r in out.collect()} == want
    assert sum(n for _, n in want.values()) > 30
    assert "n_words" in out.columns
    assert linededup.deduped(docs([])).count() == 0


# decontamination -------------------------------------------------------------------------------


def brute_hits(docs: list[str | None], items: list[tuple[int | None, str | None]]) -> list[tuple[int, int, list[str]]]:
    table = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(table))
    windows = defaultdict(set)
    for i, t in items:
        w = words(t)
        for s in range(max(1, len(w) - 9) if w else 0):
            windows[tuple(w[s : s + 10])].add(i)
    out = []
    for t in docs:
        w, found = words(t), set()
        hit = [False] * len(w)
        for n in {len(k) for k in windows}:
            for s in range(len(w) - n + 1):
                if (key := tuple(w[s : s + n])) in windows:
                    found |= windows[key]
                    hit[s : s + n] = [True] * n
        out.append((len(w), sum(hit), sorted(str(i) for i in found if i is not None)))
    return out


def test_decontamination(spark, docs):
    rnd = random.Random(13)
    word = lambda: rnd.choice("abcd") + rnd.choice(["", "", "x", "É", "q7"])
    items = [(i, " ".join(word() for _ in range(rnd.choice([1, 3, 10, 12, 25])))) for i in range(25)] + [(None, "null id item one two"), (26, None), (27, " !! "), (3, "another text of item three"), (3, "another text of item three")]
    texts = [None, "", "!!", "X " * 2000]
    for _ in range(120):
        parts = [" ".join(word() for _ in range(rnd.randint(0, 30)))]
        for _, t in rnd.sample(items[:27], rnd.randint(0, 2)):
            w = (t or "").split()
            a = rnd.randint(0, max(0, len(w) - 5))
            parts.append(" , ".join(w[a:]).upper() if rnd.random() < 0.5 else " ".join(w))
        rnd.shuffle(parts)
        texts.append(" ".join(parts))
    bench = spark.createDataFrame(items, "item_id long, text string")
    out = decontaminate.marked(docs(texts), bench).withColumn("n_hit", decontaminate.covered(F.col("hits")))
    got = {r.doc_id: (r.n_words, r.n_hit, list(r.hit_items)) for r in out.collect()}
    assert [got[i] for i in range(len(texts))] == brute_hits(texts, items)


def test_decontamination_of_nothing(spark, docs):
    none = spark.createDataFrame([], "item_id long, text string")
    assert [r.n_words for r in decontaminate.marked(docs(["a b"]), none).collect()] == [2]
    some = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert decontaminate.marked(docs([]), some).count() == 0


def test_proximity_allows_slack(spark, docs):
    bench = spark.createDataFrame([(1, "alpha beta gamma delta")], "item_id long, text string")
    texts = ["alpha beta gamma delta", "alpha new beta gamma old delta", "alpha " + "x " * 30 + "beta gamma delta"]
    got = {(r.doc_id, r.item_id) for r in decontaminate.proximity(docs(texts), bench, "doc_id", "text", "item_id", "text", slop=2).collect()}
    assert (0, 1) in got and (1, 1) in got and (2, 1) not in got


def test_hash_of_no_items():
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0c442")
