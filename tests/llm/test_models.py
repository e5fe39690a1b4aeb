"""Context-tree weighting, URL filter and toxicity."""

from __future__ import annotations

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from frameloom.llm import ctw, toxicity, urls


def held(i) -> bool:
    return zlib.crc32(str(i).encode()) % 7 == 2


def brute_ctw(train: list[bytes], texts: list[bytes]) -> list[float]:
    depth = ctw.DEPTH
    counts = [defaultdict(lambda: [0, 0]) for _ in range(depth + 1)]

    def walk(t):
        a = b"\0" * depth + t + b"\0"
        for i in range(depth, len(a)):
            u = 1
            for k in range(7, -1, -1):
                yield a, i, u, a[i] >> k & 1
                u = u * 2 + (a[i] >> k & 1)

    for t in train:
        for a, i, u, bit in walk(t):
            for d in range(depth + 1):
                counts[d][a[i - d : i], u][bit] += 1
    kt = lambda x, y: math.lgamma(x + 0.5) + math.lgamma(y + 0.5) - math.log(math.pi) - math.lgamma(x + y + 1)
    rho, below = [{} for _ in range(depth + 1)], {}
    for d in range(depth, -1, -1):
        above = defaultdict(float)
        for (c, u), (x, y) in counts[d].items():
            pe = kt(x, y)
            pw = pe if d == depth else np.logaddexp(pe, below[c, u]) - math.log(2)
            rho[d][c, u] = 1.0 if d == depth else math.exp(pe - math.log(2) - pw)
            above[c[1:], u] += pw
        below = above
    out = []
    for t in texts:
        total = 0.0
        for a, i, u, bit in walk(t):
            p = None
            for d in range(depth, -1, -1):
                c = a[i - d : i]
                x, y = counts[d].get((c, u), (0, 0))
                q = ((y if bit else x) + 0.5) / (x + y + 1)
                r = rho[d].get((c, u), 0.5)
                p = q if p is None else r * q + (1 - r) * p
            total += math.log10(p)
        out.append(total)
    return out


def test_scores(docs):
    rnd = random.Random(5)
    texts = [None, "", "The THE the é", "a" * 300] + [" ".join(rnd.choice(["the", "cat", "sät", "on", f"w{rnd.randrange(40)}"]) for _ in range(rnd.randint(0, 30))) for _ in range(40)]
    data = docs(texts)
    train = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7, F.lit(0)) != 2
    out = {r.doc_id: r for r in ctw.scored(data, "doc_id", "text", train).collect()}
    low = [(t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).encode() for t in texts]
    c = Counter()
    for i, t in enumerate(low):
        if not held(i):
            c.update([*t.split(), None])
    n, v = sum(c.values()), len(c)
    scores = brute_ctw([t for i, t in enumerate(low) if not held(i)], low)
    for i, t in enumerate(low):
        w = [*t.split(), None]
        assert (out[i].n_tokens, out[i].n_known, out[i].train_tokens) == (len(w), sum(c[x] > 0 for x in w), n)
        assert out[i].base_score == pytest.approx(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w))
        assert out[i].score == pytest.approx(scores[i])


def test_scores_of_nothing(docs):
    assert ctw.scored(docs([]), "doc_id", "text", F.lit(True)).count() == 0
    one = ctw.scored(docs(["ab"]), "doc_id", "text", F.lit(False)).first()
    assert one.n_known == 0 and one.code_bits == pytest.approx(8.0)


def test_log_gamma():
    x = np.array([0.5, 1.0, 1.5, 3.25, 40.0, 1e6])
    assert ctw.lgamma(x) == pytest.approx([math.lgamma(v) for v in x], rel=1e-10, abs=1e-10)


RULES = [urls.Rule("allow", "org", "/"), urls.Rule("block", "example.org", "/es/"), urls.Rule("block", "example.org", "/en/1"), urls.Rule("allow", "com", "/fr/"), urls.Rule("block", "com", "/de/")]


def test_rules(spark):
    cases = {
        "http://A.Example.ORG/es/x?y": ("a.example.org", "/es/x", "example.org/es/", "block"),
        "http://example.org/en/12": ("example.org", "/en/12", "example.org/en/1", "block"),
        "http://xexample.org/en/12": ("xexample.org", "/en/12", "org/", "allow"),
        "http://a.org": ("a.org", "", None, None),
        "ftp://b.com/fr/#q": ("b.com", "/fr/", "com/fr/", "allow"),
        "http://b.com?x=/de/": ("b.com", "", None, None),
        "http://É.com/de/": ("É.com", "/de/", "com/de/", "block"),
        "nothing": ("", "", None, None),
        "://org/": ("org", "/", "org/", "allow"),
        "x://y.net/a://b/": ("y.net", "/a://b/", None, None),
    }
    rows = spark.createDataFrame([(i, u) for i, u in enumerate(cases)] + [(99, None)], "page_id long, url string")
    got = {r.url: (r.host, r.path, r.rule, r.action) for r in urls.ruled(rows, "url", RULES).collect()}
    assert got == {**cases, None: ("", "", None, None)}


def test_trees_learn(spark):
    rnd = random.Random(1)
    rows = []
    for i in range(600):
        bad = i % 2
        path = "/".join(str(rnd.randrange(10**6)) for _ in range(4)) if bad else "news"
        rows.append((i, f"http://h{i % 7}.{'com/de' if bad else 'com/fr'}/{path}"))
    rows += [(1000, "http://q.net/xx/123456/99999/4444/777"), (1001, "http://q.net/xx/news"), (1002, None), (1001, "http://q.net/xx/news")]
    data = spark.createDataFrame(rows, "page_id long, url string")
    out = {r.page_id: r for r in urls.judged(data, "url", ["page_id"], RULES).collect()}
    assert (out[1000].verdict, out[1001].verdict) == ("block", "allow") and len(out) == 603
    assert urls.judged(data.where("false"), "url", ["page_id"], RULES).count() == 0


@pytest.mark.parametrize("sf, right, found", [("0.01", 0.75, 0.0), ("0.1", 0.92, 0.75)])
def test_trees_judge_hosts_they_have_not_seen(spark, sf, right, found):
    """Two of four folds of hosts, each judged by trees learned from the other hosts."""
    from frameloom.llm import queries
    from frameloom.llm.common import stored

    ruled = urls.ruled(spark.read.parquet(f"/root/testdata/sf{sf}/pages.parquet").select("page_id", "url"), "url", queries.URL_RULES)
    fold = F.pmod(F.xxhash64("host", F.lit(7)), F.lit(4))
    truth, said = [], []
    for k in range(2):
        told = ruled.withColumn("truth", F.col("action")).withColumn("action", F.when(fold != k, F.col("action")))
        rows = stored(urls.featured(told, "url"), "held-out")
        model = urls.fitted(rows, "url")
        held = rows.where("action IS NULL AND truth IS NOT NULL").select("truth", *urls.FEATURES).collect()
        truth += [r.truth == "block" for r in held]
        said += (model.score(np.array([tuple(r)[1:] for r in held])) > 0.5).tolist()
    truth, said = np.array(truth), np.array(said)
    assert (truth == said).mean() > right and said[truth].mean() > found


def test_cuts_see_a_minority():
    x = np.concatenate([np.full(5, 3.0), np.arange(40.0, 400.0)])
    cuts = urls.cuts_of(x, np.concatenate([np.zeros(5), np.ones(360)]), 16)
    assert cuts[0] < 40 and cuts[0] > 3 and len(cuts) <= 16
    assert urls.cuts_of(np.array([1.0, 1.0, 2.0]), np.array([0, 1, 0]), 16).tolist() == [1.5]


def test_scores_are_those_of_walking_each_tree():
    rng = np.random.default_rng(0)
    x = rng.normal(0, 1, (300, 5))
    model = urls.boost(x, (x[:, 0] + x[:, 1] > 0).astype(float))

    def walk(tree, row):
        at = 0
        while tree[at][0] >= 0:
            at = tree[at][2] if row[tree[at][0]] <= tree[at][1] else tree[at][3]
        return tree[at][4]

    want = [1 / (1 + np.exp(-(model.prior + sum(walk(t, row) for t in model.trees)))) for row in x]
    assert np.allclose(model.score(x), want)
    assert ((model.score(x) > 0.5) == (x[:, 0] + x[:, 1] > 0)).mean() > 0.95


def test_boosting_without_labels_or_with_one_kind():
    assert urls.boost(np.zeros((0, 2)), []).score(np.zeros((2, 2))).tolist() == [0.5, 0.5]
    assert urls.boost(np.ones((5, 2)), np.ones(5)).score(np.ones((1, 2)))[0] > 0.99


def test_toxicity_learns_and_generalises():
    rnd = random.Random(3)
    syllables = ["an", "er", "ing", "th", "on", "re", "ed", "ou", "st", "ly"]
    word = lambda: "".join(rnd.choice(syllables) for _ in range(rnd.randint(1, 3)))
    texts, labels = [], []
    for i in range(400):
        w = [word() for _ in range(rnd.randint(20, 120))]
        if i % 4 == 0:
            for _ in range(3):
                w[rnd.randrange(len(w))] = rnd.choice(["zidiot", "mokron", "scumbag"])
        texts.append(" ".join(w))
        labels.append(int(i % 4 == 0))
    model = toxicity.train(texts, labels, epochs=80)
    plain = " ".join(word() for _ in range(60))
    score = lambda t: max(model.bias + toxicity.SCALE * np.mean([model.word(x) for x in t.split()[s : s + toxicity.WINDOW]]) for s in toxicity.window_starts(len(t.split())))
    assert score(plain) < 0 < score(plain + " zidiot mokron and more")
    assert score(plain + " scumbags zidiots") > score(plain)


def test_toxicity_table(docs, spark):
    texts = [None, "", "you idiot fool", "fine words here"] * 5
    labels = spark.createDataFrame([(i, i % 4 == 2 and 1 or 0) for i in range(12)] + [(3, None)], "doc_id long, toxic int")
    model = toxicity.fitted(docs(texts), labels, "doc_id", "text", "toxic", F.lit(True))
    out = {r.doc_id: r.score for r in toxicity.scored(docs(texts), "text", ["doc_id"], model).collect()}
    assert len(out) == 20 and all(0 <= v <= 1 for v in out.values()) and out[0] == out[1] and out[2] > out[3]
    empty = toxicity.fitted(docs([]), labels, "doc_id", "text", "toxic", F.lit(True))
    assert toxicity.scored(docs([]), "text", ["doc_id"], empty).count() == 0
