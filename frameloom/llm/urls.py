"""URL filters: host and path rules, and boosted trees on lexical features beyond them.

Rules are few, fixed and given by the caller: each allows or blocks a host with all
its subdomains under a path; the longest that fits wins. URLs that a rule judges are
the labelled ones; gradient-boosted trees learn from them and judge the rest.

Features are DataFrame expressions: lengths, depth, digit ratio, character entropy, parameter and
hyphen counts, and statistics of the host's last label and of the path's first segment (how many URLs have it, how many
labelled ones are blocked), counted over all rows by partial aggregation. Hosts are dealt to two
halves, and every URL, labelled or not, sees the blocked share of the other half only: never its own
label or one of its host. At most ``SAMPLE_ROWS`` distinct labelled URLs, those with the smallest
hash, reach the driver to fit the trees, in numpy, over histograms. Scoring is a narrow pass with a
few kilobytes of trees.

Defined cases: null URLs and those without ``://`` have empty host and path and fit no rule;
repeated rows are judged alike and count once in the fit; columns to keep whose names the
results take go on under the name with ``_in`` added; with labels of one kind only, every other URL gets that kind's share as its score;
without any label the score is 0.5 and the verdict allow.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from frameloom.llm.common import arrow_bounds, ascii_lower, bounded, kept_names, stored

SAMPLE_ROWS = 20_000
FEATURES = ("length", "host_length", "path_length", "depth", "digit_ratio", "entropy", "params", "hyphens", "labels", "longest_digits", "suffix_count", "suffix_blocked", "segment_count", "segment_blocked")
#: URLs whose worth the share of all labelled URLs has beside a suffix's or segment's own.
PRIOR_WEIGHT = 5


@dataclass(frozen=True)
class Rule:
    """``action`` (allow or block) for a host, its subdomains, and paths that begin with ``path``."""

    action: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


def parts(url: Column) -> tuple[Column, Column]:
    """(host, path) of a URL."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    return ascii_lower(F.regexp_extract(rest, "^[^/?#]*", 0)), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def ruled(urls: DataFrame, url: str, rules: list[Rule]) -> DataFrame:
    """``urls`` with host, path, rule and action (null where none fits)."""
    host, path = parts(urls[url])
    out = urls.withColumn("host", host).withColumn("path", path)
    rule = action = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.name), r.name)):
        fits = ((F.col("host") == r.host) | F.endswith("host", F.lit("." + r.host))) & F.startswith("path", F.lit(r.path))
        rule, action = F.when(fits, F.lit(r.name)).otherwise(rule), F.when(fits, F.lit(r.action)).otherwise(action)
    return out.withColumn("rule", rule).withColumn("action", action)


def _longest_digits(url: Column) -> Column:
    return F.coalesce(F.array_max(F.transform(F.regexp_extract_all(url, F.lit("[0-9]+"), F.lit(0)), lambda x: F.length(x))), F.lit(0))


def _entropy(url: Column) -> Column:
    n = F.length(url)

    def add(acc: Column, c: Column) -> Column:
        p = (n - F.length(F.replace(url, c, F.lit("")))) / n
        return acc - p * F.log2(p)

    return F.when(n > 0, F.aggregate(F.array_remove(F.array_distinct(F.split(url, "")), ""), F.lit(0.0), add)).otherwise(0.0)


def _counted(rows: DataFrame, key: str, prior: float) -> DataFrame:
    """``rows`` with ``<key>_count`` (log of URLs) and ``<key>_blocked``: the blocked share among the labelled URLs of the other half of hosts.

    A labelled URL so never sees its own label or one of its host, and others see what those saw. Few labels count with the share of all, ``prior``.
    """
    half = F.pmod(F.xxhash64("host"), F.lit(2))
    told = F.col("action").isNotNull()
    share = lambda h: (F.count_if((F.col("action") == "block") & (half == h)) + PRIOR_WEIGHT * prior) / (F.count_if(told & (half == h)) + PRIOR_WEIGHT)
    table = rows.groupBy(F.col(f"_{key}").alias("_k")).agg(F.log1p(F.count("*")).alias(f"{key}_count"), share(0).alias("_of0"), share(1).alias("_of1"))
    out = rows.join(bounded(stored(table, f"url-{key}")), F.col(f"_{key}") == F.col("_k"))
    return out.withColumn(f"{key}_blocked", F.when(half == 0, F.col("_of1")).otherwise(F.col("_of0"))).drop("_k", "_of0", "_of1", f"_{key}")


def featured(ruled_urls: DataFrame, url: str) -> DataFrame:
    """``ruled_urls`` with the features as doubles. Statistics are a row per last host label and per first path segment."""
    u = F.coalesce(F.col(url), F.lit(""))
    rows = ruled_urls.withColumn("_suffix", F.substring_index("host", ".", -1)).withColumn("_segment", F.coalesce(F.get(F.split("path", "/", 3), F.lit(1)), F.lit("")))
    blocked, told = ruled_urls.agg(F.count_if(F.col("action") == "block"), F.count("action")).first()
    prior = blocked / told if told else 0.5
    for key in ("suffix", "segment"):
        rows = _counted(rows, key, prior)
    values = {
        "length": F.length(u),
        "host_length": F.length("host"),
        "path_length": F.length("path"),
        "depth": F.length("path") - F.length(F.replace("path", F.lit("/"), F.lit(""))),
        "digit_ratio": (F.length(u) - F.length(F.regexp_replace(u, "[0-9]", ""))) / F.greatest(F.length(u), F.lit(1)),
        "entropy": _entropy(u),
        "params": F.when(F.contains(u, F.lit("?")), 1 + F.length(u) - F.length(F.replace(u, F.lit("&"), F.lit("")))).otherwise(0),
        "hyphens": F.length(u) - F.length(F.replace(u, F.lit("-"), F.lit(""))),
        "labels": F.size(F.split("host", r"\.")),
        "longest_digits": _longest_digits(u),
    }
    return rows.withColumns({k: v.cast("double") for k, v in values.items()})


@dataclass
class Trees:
    """Boosted trees: each a list of (feature, threshold, left, right, value); leaves have feature -1."""

    prior: float
    trees: list = field(default_factory=list)

    def score(self, x):
        """Probability of block for rows of features."""
        import numpy as np

        z = np.full(len(x), self.prior)
        for tree in self.trees:
            feature, cut, left, right, value = (np.array(c) for c in zip(*tree, strict=True))
            at = np.zeros(len(x), dtype=np.int64)
            for _ in range(len(tree)):
                inner = feature[at] >= 0
                if not inner.any():
                    break
                go = x[np.arange(len(x)), np.maximum(feature[at], 0)] <= cut[at]
                at = np.where(inner, np.where(go, left[at], right[at]), at)
            z = z + value[at]
        return 1 / (1 + np.exp(-z))


def cuts_of(column, y, bins: int):
    """Middles between distinct values, and beyond ``bins`` of these between those at quantiles of either kind.

    Each kind has its own quantiles, so a few rows of one kind are told from many of the other.
    """
    import numpy as np

    values = np.unique(column)
    if len(values) > bins:
        levels = np.linspace(0, 1, bins // 2 + 1)
        values = np.unique(np.concatenate([np.quantile(column[y == kind], levels, method="nearest") for kind in (0, 1)]))
    return (values[1:] + values[:-1]) / 2


def boost(x, y, rounds: int = 90, depth: int = 3, rate: float = 0.2, bins: int = 64, least: int = 5, columns: float = 0.35) -> Trees:
    """Second-order boosting of the logistic loss over histograms.

    Each tree sees a share of the ``columns``, drawn from a fixed seed, so that no single feature hides the others.
    """
    import numpy as np

    x, y = np.asarray(x, dtype=np.float64), np.asarray(y, dtype=np.float64)
    if not len(y):
        return Trees(0.0)
    if y.min() == y.max():
        return Trees(float(np.copysign(np.log(1e6), y[0] - 0.5)))
    model = Trees(float(np.log(y.mean() / (1 - y.mean()))))
    rng = np.random.default_rng(42)
    cuts = [cuts_of(x[:, f], y, bins) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)], axis=1)
    z = np.full(len(y), model.prior)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-z))
        g, h = p - y, p * (1 - p)
        seen = rng.permutation(x.shape[1])[: max(1, round(columns * x.shape[1]))]
        nodes: list = []
        step = np.zeros(len(y))

        def grow(rows, left_depth: int) -> int:
            at, gs, hs = len(nodes), g[rows].sum(), h[rows].sum()
            nodes.append(None)
            best = (1e-6, -1, 0, 0.0)
            for f in seen if left_depth else ():
                gb = np.cumsum(np.bincount(binned[rows, f], g[rows], len(cuts[f]) + 1))[:-1]
                hb = np.cumsum(np.bincount(binned[rows, f], h[rows], len(cuts[f]) + 1))[:-1]
                nb = np.cumsum(np.bincount(binned[rows, f], minlength=len(cuts[f]) + 1))[:-1]
                gain = gb**2 / (hb + 1) + (gs - gb) ** 2 / (hs - hb + 1) - gs**2 / (hs + 1)
                gain[(nb < least) | (len(rows) - nb < least)] = -1
                if len(gain) and gain.max() > best[0]:
                    # of cuts with no rows between them the middle counts
                    alike = np.nonzero(nb == nb[gain.argmax()])[0]
                    best = (gain.max(), int(f), int(alike[0]), float(cuts[f][alike].mean()))
            _, f, b, cut = best
            if f < 0:
                value = -rate * gs / (hs + 1)
                step[rows] = value
                nodes[at] = (-1, 0.0, 0, 0, float(value))
            else:
                go = binned[rows, f] <= b
                left = grow(rows[go], left_depth - 1)
                right = grow(rows[~go], left_depth - 1)
                nodes[at] = (f, cut, left, right, 0.0)
            return at

        grow(np.arange(len(y)), depth)
        z = z + step
        model.trees.append(nodes)
    return model


def fitted(rows: DataFrame, url: str, most: int = SAMPLE_ROWS) -> Trees:
    """Trees over a bounded sample of labelled URLs, each once."""
    import numpy as np

    labelled = rows.where("action IS NOT NULL").select(F.xxhash64(url).alias("_o"), (F.col("action") == "block").cast("double").alias("_y"), *FEATURES)
    last = labelled.select("_o").distinct().orderBy("_o").limit(most).agg(F.max("_o")).first()[0]  # only hashes are shuffled
    chosen = labelled.where(F.col("_o") <= (0 if last is None else last)).distinct()
    sample = np.array([tuple(r)[1:] for r in chosen.orderBy("_o", "_y", *FEATURES).limit(most).collect()], dtype=np.float64).reshape(-1, len(FEATURES) + 1)
    return boost(sample[:, 1:], sample[:, 0])


def judged(urls: DataFrame, url: str, keep: list[str], rules: list[Rule], most: int = SAMPLE_ROWS) -> DataFrame:
    """``keep`` with host, path, rule, verdict and block_score (the trees')."""
    import pyarrow as pa

    own = [f"_k{i}" for i in range(len(keep))]  # no kept name can meet one of ours
    plain = urls.select(*(urls[c].alias(k) for c, k in zip(keep, own, strict=True)), urls[url].alias("_url"))
    rows = stored(featured(ruled(plain, "_url", rules), "_url"), "url-features")
    model = fitted(rows, "_url", most)
    out = [*own, "host", "path", "rule", "action"]
    source = rows.select(*out, *FEATURES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            x = np.stack([batch.column(len(out) + i).to_numpy(zero_copy_only=False) for i in range(len(FEATURES))], axis=1) if len(batch) else np.zeros((0, len(FEATURES)))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(out))), pa.array(model.score(x))], names=[*out, "block_score"])

    arrow_bounds(urls.sparkSession)
    scored = source.mapInArrow(run, source.schema[: len(out)].add("block_score", "double"))
    by_model = F.when(F.col("block_score") > 0.5, "block").otherwise("allow")
    results = {"host": F.col("host"), "path": F.col("path"), "rule": F.col("rule"), "block_score": F.col("block_score"), "verdict": F.coalesce("action", by_model)}
    names = kept_names(keep, list(results))
    return scored.select(*(F.col(k).alias(n) for k, n in zip(own, names, strict=True)), *(v.alias(n) for n, v in results.items()))
