from __future__ import annotations

import random
from collections import defaultdict

from xxhash import xxh64_intdigest

from frameloom.llm import graph, simhash


def brute_classes(fps: dict[int, int], bits: int) -> dict[int, int]:
    parent = {i: i for i in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    keys = sorted(fps)
    for a in keys:
        for b in keys:
            if a < b and ((fps[a] ^ fps[b]) & (1 << 64) - 1).bit_count() <= bits:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in keys}


def test_fingerprint_of_the_contract():
    words = "The quick Brown fox jumps over THE lazy dog".lower().split()
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)]
    want = sum(1 << b for b in range(64) if sum(xxh64_intdigest(s.encode(), 42) >> b & 1 for s in shingles) * 2 > len(shingles))
    got = simhash.votes_to_fingerprint(simhash.shingle_hashes("The quick\tBrown fox\n jumps over THE lazy dog", 3))
    assert got % (1 << 64) == want
    assert simhash.votes_to_fingerprint(simhash.shingle_hashes(" \n", 3)) == 0
    assert len(simhash.shingle_hashes("one two", 3)) == 1


def test_classes_match_brute_force_also_in_crowded_lists(spark):
    rnd = random.Random(2)
    base = rnd.getrandbits(64)
    fps = {}
    for i in range(140):  # one crowded family: many fingerprints alike in most bytes
        fps[i] = base ^ rnd.getrandbits(12) << 2
    for i in range(140, 220):
        fps[i] = rnd.getrandbits(64)
    for i in range(220, 260):
        fps[i] = fps[rnd.randrange(220)] ^ (1 << rnd.randrange(64)) ^ (1 << rnd.randrange(64))
    fps[260] = fps[3]
    signed = [(i, f - (1 << 64) if f >> 63 else f) for i, f in fps.items()]
    got = simhash.classes(spark.createDataFrame(signed, "doc_id long, fp long"), 2).collect()
    assert {r.doc_id: r.component_id for r in got} == brute_classes(fps, 2)


def test_components_of_chains_stars_and_nothing(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(7, 7)]
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 160)}}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_defined_cases(docs):
    texts = [None, "", " \n", "same words here now", "Same  words here now", "same words here now"]
    marked = simhash.fingerprints(docs(texts), "doc_id", "text", 3)
    got = {r.doc_id: r.component_id for r in simhash.classes(marked, 2).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 3, 4: 3, 5: 3}
    assert simhash.classes(simhash.fingerprints(docs([]), "doc_id", "text", 3)).count() == 0


def jaccard(a: str, b: str) -> float:
    x, y = (set(simhash.shingle_hashes(t, 5).tolist()) for t in (a, b))
    return len(x & y) / len(x | y)


def test_near_groups_find_near_copies_and_leave_the_rest(docs):
    rnd = random.Random(9)
    vocabulary = ["w%d" % i for i in range(4000)]
    texts, family = [], []
    for g in range(40):
        words = [rnd.choice(vocabulary) for _ in range(rnd.randint(60, 300))]
        texts.append(" ".join(words))
        family.append(g)
        for _ in range(rnd.randint(0, 4)):
            other = list(words)
            for _ in range(rnd.randint(0, 2)):
                other[rnd.randrange(len(other))] = rnd.choice(vocabulary)
            texts.append(" ".join(other))
            family.append(g)
    links = defaultdict(set)
    for i in range(len(texts)):
        for j in range(i):
            if family[i] == family[j] and jaccard(texts[i], texts[j]) >= 0.8:
                links[i].add(j)
                links[j].add(i)
    seen, groups = set(), []
    for i in range(len(texts)):
        if i not in seen:
            stack, group = [i], set()
            while stack:
                x = stack.pop()
                if x not in group:
                    group.add(x)
                    stack += links[x]
            seen |= group
            groups.append(min(group))
    kept = simhash.near_deduped(docs(texts))
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars", "n_words"]
    assert sorted(r.doc_id for r in kept.collect()) == sorted(groups)


def test_a_large_family_of_near_copies_leaves_one(docs):
    rnd = random.Random(4)
    words = ["v%d" % rnd.randrange(3000) for _ in range(400)]
    texts = []
    for _ in range(150):
        other = list(words)
        other[rnd.randrange(400)] = "z%d" % rnd.randrange(999)
        texts.append(" ".join(other))
    assert [r.doc_id for r in simhash.near_deduped(docs([*texts, "quite another text of its own"])).collect()] == [0, 150]


def test_repeated_rows_blanks_and_null_ids_keep_one(docs):
    out = simhash.near_deduped(docs(["a b c", "a b c", None, "", "a b c"], [5, 5, 7, 8, None])).collect()
    assert sorted(((r.doc_id, r.text) for r in out), key=str) == [(5, "a b c"), (7, None)]


def test_cut_and_extended_copies_are_found(docs):
    rnd = random.Random(21)
    texts, want = [], set()
    for g in range(90):
        least = (0.8, 0.85, 0.9)[g % 3]
        words = ["c%d_%d" % (g, i) for i in range(rnd.randint(60, 600))]
        more = [*words, *("x%d_%d" % (g, i) for i in range(600))]
        n = len(words) - 4
        longer = " ".join(more[: int(n / least) + 4])
        shorter = " ".join(words[: -int(-n * least // 1) + 5])
        assert least <= jaccard(" ".join(words), longer) < least + 0.03 and least <= jaccard(" ".join(words), shorter) < least + 0.04
        want.add(len(texts))
        texts += [" ".join(words), longer] if g % 2 else [shorter, " ".join(words)]
    assert {r.doc_id for r in simhash.near_deduped(docs(texts)).collect()} == want


def test_long_lists_are_compared_whole(docs):
    rnd = random.Random(22)
    words = ["s%d" % i for i in range(200)]
    star = []  # each 0.8 like the original, few like each other
    for m in range(120):
        other = list(words)
        for at in rnd.sample(range(5, 195, 5), 4):
            other[at] = "m%d_%d" % (m, at)
        star.append(" ".join(other))
    assert all(jaccard(" ".join(words), t) >= 0.8 for t in star) and sum(jaccard(star[0], t) >= 0.8 for t in star) == 1
    lines = [" ".join(rnd.choice("abcdefgh") for _ in range(12)) for _ in range(30)]
    mixed = ["\n".join(rnd.sample(lines, 30)) for _ in range(60)]  # one set of words
    last = mixed[0].split()
    last[100:105] = last[104:99:-1]
    texts = [*star, *mixed, " ".join(words), " ".join(last)]
    parent = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if (i < 120 or i == 180) == (j < 120 or j == 180) and jaccard(texts[i], texts[j]) >= 0.8:
                a, b = parent[i], parent[j]
                parent = [min(a, b) if p in (a, b) else p for p in parent]
    assert {parent[i] for i in range(120)} == {0} and parent[180] == 0
    assert {r.doc_id for r in simhash.near_deduped(docs(texts)).collect()} == set(parent)


def test_no_link_of_a_crowded_list_is_lost(docs):
    rnd = random.Random(23)
    words = ["t%d" % i for i in range(184)]
    texts = []  # each at 0.8 to the last text alone, and below it to one another
    for m in range(320):
        other = list(words)
        for at in rnd.sample(range(5, 179, 5), 4):
            other[at] = "r%d_%d" % (m, at)
        texts.append(" ".join(other))
    texts.append(" ".join(words))
    assert {jaccard(texts[-1], t) for t in texts[:-1]} == {0.8} and jaccard(texts[0], texts[1]) < 0.8
    assert [r.doc_id for r in simhash.near_deduped(docs(texts)).collect()] == [0]


def test_prefixes_share_a_list_within_reach(spark):
    rnd = random.Random(6)
    sets = []
    for i in range(160):
        size = rnd.choice((1, 2, 4, 5, 9, 10, 40, 41))
        sets.append(sorted(rnd.sample(sets[-1], min(len(sets[-1]), size)) if i % 2 else {rnd.getrandbits(64) - (1 << 63) for _ in range(size)}))
    data = spark.createDataFrame(list(enumerate(sets)), "node long, shingles array<long>")
    lists = simhash._prefixes(data, 0.8).selectExpr("*", "node as root")
    got = {(r.a, r.b) for r in simhash._prefix_crossing(lists, 0.8).collect()}
    want = {(i, j) for j in range(len(sets)) for i in range(j) if 5 * len({*sets[i]} & {*sets[j]}) >= 4 * len({*sets[i]} | {*sets[j]})}
    assert want and want <= got


def test_every_kind_of_edit_is_found_in_families_of_any_size(docs):
    rnd = random.Random(31)
    texts, pairs = [], []
    for g in range(160):
        words = ["k%d_%d" % (g, i) for i in range(rnd.randint(80, 400))]
        least, n = rnd.choice((0.8, 0.85, 0.9, 0.95)), len(words) - 4
        more = ["y%d_%d" % (g, i) for i in range(300)]
        extra = int(n / least) - n
        swaps = max(1, int(n * (1 - least) / (1 + least) / 5))
        other = {
            0: lambda: words + more[:extra],
            1: lambda: more[:extra] + words,
            2: lambda: words[extra:] if (n - extra) / n >= least else words[max(1, int(n * (1 - least))) :],
            3: lambda: [more[i // 9] if i % 9 == 4 and i // 9 < swaps else w for i, w in enumerate(words)],
        }[g % 4]()
        a, b = " ".join(words), " ".join(other)
        if jaccard(a, b) >= 0.8:
            pairs.append((len(texts), len(texts) + 1))
        texts += [a, b]
    assert len(pairs) > 120
    kept = {r.doc_id for r in simhash.near_deduped(docs(texts)).collect()}
    assert all(a in kept for a, _ in pairs)
    assert sum(b not in kept for _, b in pairs) >= 0.99 * len(pairs)


def test_near_deduped_keeps_clashing_columns(docs):
    rows = docs(["one two three four five six", "ONE two three four five six", "other"]).toDF("doc_id", "text", "n", "_key", "root", "node")
    out = {r.doc_id: r.asDict() for r in simhash.near_deduped(rows).collect()}
    assert set(out) == {0, 2} and out[2]["node"] == "x2" and out[2]["_key"] == "s" and out[0]["_key"] is None
