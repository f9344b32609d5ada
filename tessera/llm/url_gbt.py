"""URL filter: rules on host and path first, gradient-boosted trees on lexical features for the rest.

The trees see the url alone. Their labels come from elsewhere: a table of labelled urls, or else what the pages hold (too
few words, symbols, repeated paragraphs, mostly links) and a list of words for hosts known to be unwanted. Labels can be
learnt as far as urls tell them; the threshold is calibrated on urls held out, so where they tell nothing no url is blocked.
Counts of suffixes, edges of bins, trees and threshold are made of all urls: what the driver holds are sums, and the suffixes
that are frequent.
"""

from __future__ import annotations

import html as markup
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import gbt
from .common import cut, slices

#: (verdict, host, path): the rule holds for the host and its subdomains where the url's path starts with the path.
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
#: Words of hosts that are known to be unwanted, between dots and hyphens. They are labels, not features.
UNWANTED = ("spam", "pills", "bets", "casino", "cheap", "free", "viagra", "loans", "poker", "porn", "xxx", "warez", "win", "adult", "farm")
#: Rows that a suffix's label rate borrows from the mean of all.
PRIOR = 5.0
TREES = 40
#: A suffix with more than one in HOT of all urls is looked up in a table of 2 * HOT rows at most; the others are joined.
HOT = 2000
#: Up to so many urls the driver holds their bins, 20 bytes a url; more stay in a table, whose tasks send sums.
HELD = 1 << 18
#: Urls of one task that sends sums, and such tasks at most.
SHARE = 1 << 15
TASKS = 256
BINS = 32
#: Scores are compared with the threshold in steps of 1 / STEPS.
STEPS = 1 << 16
FEATURES = ("length", "host_length", "path_length", "depth", "labels", "digit_ratio", "entropy", "params", "hyphens", "path_hyphens", "longest_label", "vowel_ratio", "has_fragment", "is_https", "host_digit_ratio", "suffix_count", "suffix_rate", "domain_count", "domain_rate")


def parts(url: Column) -> tuple[Column, Column]:
    """(host, path). Null and urls without :// have both empty. Only A-Z is lower-cased."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"(?s)\A([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)\A[^/?#]*([^?#]*)", 1)
    up = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(host, up, up.lower()), path


def rule_columns(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, null where none does; of equally long ones the first listed."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def suffixes(url: str | None) -> tuple[str, str]:
    """The last label of the host, and its last two."""
    m = re.match(r"(?s).*?://([^/?#]*)", url or "")
    labels = [x for x in (m.group(1).lower() if m else "").split(".") if x]
    return ".".join(labels[-1:]), ".".join(labels[-2:])


def lexical(url: str | None) -> list[float]:
    """The features that need the url alone, in the order of FEATURES; a null or empty url gives zeros."""
    url = url or ""
    m = re.match(r"(?s)(.*?)://([^/?#]*)([^?#]*)(\?[^#]*)?(#.*)?\Z", url)
    scheme, host, path, query, fragment = (m.groups() if m else ("", "", url, None, None))
    host = host.lower()
    n = len(url)
    entropy = -sum(c / n * math.log2(c / n) for c in Counter(url).values()) if n else 0.0
    labels = [x for x in host.split(".") if x]
    letters = sum(c.isalpha() for c in host)
    return [
        n, len(host), len(path), sum(bool(x) for x in path.split("/")), len(labels),
        sum(c.isdigit() for c in url) / n if n else 0.0, entropy, len([x for x in (query or "?")[1:].split("&") if x]),
        host.count("-"), path.count("-"), max(map(len, labels), default=0),
        sum(c in "aeiou" for c in host) / letters if letters else 0.0, float(fragment is not None), float(scheme == "https"),
        sum(c.isdigit() for c in host) / len(host) if host else 0.0,
    ]


@dataclass
class UrlModel:
    """Trees, the threshold from which a url is blocked, and of each suffix (rows, unwanted rows) in the training part."""

    trees: gbt.Boosted
    threshold: float
    known: dict[str, tuple[int, int]]
    mean: float

    def features(self, urls: list[str | None], rare: list | None = None) -> np.ndarray:
        """(n, FEATURES); rare holds for each url the counts of its two suffixes where known has none."""
        x = np.zeros((len(urls), len(FEATURES)))
        for k, url in enumerate(urls):
            stats = []
            for j, s in enumerate(suffixes(url)):
                n, bad = self.known.get(s, rare[k][j] if rare else (0, 0)) if s else (0, 0)
                stats += [math.log1p(n), (bad + PRIOR * self.mean) / (n + PRIOR)]
            x[k] = [*lexical(url), *stats]
        return x.astype(np.float32).astype(np.float64)  # cells() are of this precision

    def score(self, urls: list[str | None], rare: list | None = None) -> np.ndarray:
        return self.trees.proba(self.features(urls, rare))


def listed(url: str | None) -> int:
    """1 for a host with a word of UNWANTED, else 0."""
    host = re.match(r"(?s)(?:.*?://)?([^/?#]*)", url or "").group(1).lower()
    return int(any(x in UNWANTED for x in re.split(r"[.-]", host)))


def page_label(html: str | None) -> int | None:
    """1 if what the page holds is unwanted, 0 if not, None without html: fewer than 10 words, over one symbol of
    #*$%&|<> in ten words, over 30 % of its paragraphs repeated, or over half of its words in links."""
    if html is None:
        return None
    body = re.sub(r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " ", html)
    linked = sum(len(re.sub(r"<[^>]*>", " ", m).split()) for m in re.findall(r"(?is)<a\b[^>]*>(.*?)</a\s*>", body))
    parts = [markup.unescape(re.sub(r"<[^>]*>", " ", p)).split() for p in re.split(r"(?i)\n|</?(?:p|br|div|li|h[1-6]|tr|td)\b[^>]*>", body)]
    parts = [" ".join(p) for p in parts if p]
    words = sum(len(p.split()) for p in parts)
    symbols = sum(c in "#*$%&|<>" for p in parts for c in p)
    return int(words < 10 or 10 * symbols > words or 10 * (len(parts) - len(set(parts))) > 3 * len(parts) or 2 * linked > words)


def labelled_urls(pages: DataFrame, url_col: str = "url", html_col: str | None = "html", max_train: int | None = None) -> DataFrame:
    """(url, label) of every distinct url. A url is unwanted if its host is listed or any of its pages is unwanted by what it
    holds. A caller may ask for max_train urls only, those with the smallest hashes."""
    html = F.col(html_col).cast("string") if html_col in pages.columns else F.lit(None).cast("string")
    rows = pages.select(F.col(url_col).cast("string").alias("url"), html.alias("html")).where("url is not null")
    if max_train is not None:
        chosen = rows.groupBy("url").agg(F.md5("url").alias("k")).orderBy("k", "url").limit(max_train).select("url")
        rows = rows.join(chosen, "url", "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            said = [max(listed(u), page_label(h) or 0) for u, h in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(said, pa.int32())], ["url", "label"])

    return rows.mapInArrow(run, "url string, label int").groupBy("url").agg(F.max("label").alias("label"))


def train(urls: list[str], labels: list[int], precision: float = 0.9) -> UrlModel:
    """The trees, and the threshold calibrated on a held-out third, whose labels no suffix has counted. The trees learn each
    half of the rest with the suffixes' label rates in the other half, so that no row's rate holds its own label."""
    y = np.array(labels, dtype=float)
    part = np.arange(len(urls)) % 3  # 1 is held out
    mean = float(y[part != 1].mean()) if len(urls) else 0.0

    def counted(rows: np.ndarray) -> UrlModel:
        known: dict[str, tuple[int, int]] = {}
        for k in np.nonzero(rows)[0].tolist():
            for s in filter(None, suffixes(urls[k])):
                n, bad = known.get(s, (0, 0))
                known[s] = (n + 1, bad + int(y[k]))
        return UrlModel(gbt.Boosted(0.0, 0.0), 1.01, known, mean)

    of = lambda k: [u for u, p in zip(urls, part) if p == k]
    model = counted(part != 1)
    x = [counted(part == other).features(of(own)) for own, other in ((0, 2), (2, 0))]
    model.trees = gbt.fit(np.concatenate(x), np.r_[y[part == 0], y[part == 2]])
    if len(of(1)):
        model.threshold = gbt.calibrated_threshold(model.score(of(1)), y[part == 1], precision)
    return model


def _suffix_counts(labelled: DataFrame) -> DataFrame:
    """(s, c): of each suffix the urls of part 0, the unwanted of them, those of part 2 and the unwanted of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            rows = [(s, p, y) for u, y, p in zip(*(c.to_pylist() for c in b.columns)) for s in suffixes(u) if s]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (pa.string(), pa.int32(), pa.int32()))], ["s", "part", "label"])

    rows = labelled.where("part <> 1").select("url", "label", "part").mapInArrow(run, "s string, part int, label int")
    of = lambda p: [F.count_if(F.col("part") == p), F.sum(F.when(F.col("part") == p, F.col("label")).otherwise(0))]
    return rows.groupBy("s").agg(F.array(*of(0), *of(2)).alias("c"))


def _with_rare(d: DataFrame, url: str, hot: dict, rare: DataFrame | None) -> DataFrame:
    """d with c1 and c2, the counts of its url's two suffixes where these are rare."""
    if rare is None:
        return d.withColumns({c: F.lit(None).cast("array<long>") for c in ("c1", "c2")})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [suffixes(u) for u in b.column(url).to_pylist()]
            for j in (0, 1):  # those that need no join get keys of no suffix, many, so that they do not meet in one task
                keys = [f"\0{k % 997}" if not x[j] or x[j] in hot else x[j] for k, x in enumerate(found)]
                b = b.append_column(f"__s{j + 1}", pa.array(keys, pa.string()))
            yield b

    kinds = ", ".join(f"`{c}` {k}" for c, k in d.dtypes)
    d = d.mapInArrow(run, f"{kinds}, __s1 string, __s2 string")
    for j in "12":
        d = d.join(rare.select(F.col("s").alias(f"__s{j}"), F.col("c").alias(f"c{j}")), f"__s{j}", "left")
    return d.drop("__s1", "__s2")


def _taken(c: list | None, parts: tuple[int, ...]) -> tuple[int, int]:
    """(urls, unwanted urls) of these of the parts 0 and 2."""
    return (0, 0) if c is None else (sum(c[p] for p in parts), sum(c[p + 1] for p in parts))


def cells(x: np.ndarray) -> np.ndarray:
    """Numbers of the cells of numbers from 0 up, in their order: 512 of them between powers of two."""
    return np.ascontiguousarray(x, dtype=np.float32).view(np.int32) >> 14


def _edges(found: list, n: int) -> list[np.ndarray]:
    """found: (feature, cell, rows) -> for each feature the upper ends of the cells that hold its 1st, 2nd, ... of BINS quantiles."""
    out = []
    for f in range(len(FEATURES)):
        rows = sorted((c, k) for g, c, k in found if g == f)
        cell, below = np.array([c for c, _ in rows], dtype=np.int32), np.cumsum([k for _, k in rows])
        at = np.unique(np.searchsorted(below, np.arange(1, BINS) * n / BINS)) if rows else np.zeros(0, int)
        at = at[at < len(cell) - 1]  # above the last cell there is nothing
        out.append(((cell[at] << 14) | ((1 << 14) - 1)).astype(np.int32).view(np.float32).astype(np.float64))
    return out


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), len(FEATURES)).astype(np.float64)


def train_all(labelled: DataFrame, precision: float = 0.9) -> tuple[UrlModel, DataFrame | None]:
    """train() over a table (url, label) of distinct urls, all of them; with the counts of rare suffixes, where there are any."""
    labelled = cut(labelled.withColumn("part", (F.crc32(F.col("url").cast("binary")) % 3).cast("int")), "urls")
    per_part = {r["part"]: (r["n"], r["bad"]) for r in labelled.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("bad")).collect()}
    n, bad = (sum(per_part.get(p, (0, 0))[k] for p in (0, 2)) for k in (0, 1))
    counts = cut(_suffix_counts(labelled), "suffixes")
    often = F.expr(f"(c[0] + c[2]) * {HOT}") > n
    hot = {r["s"]: r["c"] for r in counts.where(often).collect()}  # fewer than 2 * HOT: a url has two suffixes
    rare = counts.where(~often)
    rare = None if rare.isEmpty() else rare
    mean = bad / n if n else 0.0
    empty = gbt.Boosted(0.0, 0.0)
    parts = {0: (2,), 1: (0, 2), 2: (0,)}  # of which a part's url sees the counts
    views = {p: UrlModel(empty, 1.01, {s: _taken(c, seen) for s, c in hot.items()}, mean) for p, seen in parts.items()}

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            part = b.column("part").to_numpy(zero_copy_only=False)
            urls, c1, c2 = (b.column(k).to_pylist() for k in ("url", "c1", "c2"))
            x = np.zeros((len(b), len(FEATURES)), dtype=np.float32)
            for p, seen in parts.items():
                rows = np.nonzero(part == p)[0].tolist()
                if rows:
                    x[rows] = views[p].features([urls[k] for k in rows], [(_taken(c1[k], seen), _taken(c2[k], seen)) for k in rows])
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, len(FEATURES)), pa.int32()), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([b.column("part"), b.column("label"), lists], ["part", "label", "x"])

    table = cut(_with_rare(labelled, "url", hot, rare).mapInArrow(features, "part int, label int, x array<float>"), "features")
    learnt = table.where("part <> 1")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if len(b):
                c = cells(_matrix(b.column("x")))
                found = [np.unique(c[:, f], return_counts=True) for f in range(c.shape[1])]
                of = np.repeat(np.arange(len(found)), [len(v) for v, _ in found])
                yield pa.RecordBatch.from_arrays([pa.array(of, pa.int32()), pa.array(np.concatenate([v for v, _ in found]), pa.int32()), pa.array(np.concatenate([k for _, k in found]), pa.int64())], ["f", "cell", "n"])

    sums = learnt.mapInArrow(counted, "f int, cell int, n long").groupBy("f", "cell").agg(F.sum("n").alias("n"))
    edges = _edges([tuple(r) for r in sums.collect()], n)

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if len(b):
                x = _matrix(b.column("x"))
                bins = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T)], axis=1).astype(np.uint8)
                yield pa.RecordBatch.from_arrays([pa.array([bins.tobytes()], pa.binary()), pa.array([b.column("label").to_numpy(zero_copy_only=False).astype(np.uint8).tobytes()], pa.binary())], ["bins", "y"])

    taken = lambda bins, y: (np.frombuffer(bins, dtype=np.uint8).reshape(-1, len(FEATURES)), np.frombuffer(y, dtype=np.uint8).astype(float))
    rows = cut(learnt.mapInArrow(binned, "bins binary, y binary").coalesce(max(1, min(TASKS, n // SHARE))), "bins")
    if n <= HELD:
        held = [taken(*r) for r in rows.collect()]
        bins, y = (np.concatenate(c) for c in zip(*held)) if held else taken(b"", b"")
        score = []

        def summed(model, tree, level):
            if not score:
                score.append(model.raw(bins))
                score.append(0)
            for t in model.trees[score[1] :]:
                score[0] = score[0] + model.rate * t[4][gbt.leaves(t, bins)]
                score[1] += 1
            return gbt.histogram(bins, y, score[0], tree, level, BINS)
    else:

        def summed(model, tree, level):
            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                out = 0
                for b in batches:
                    for k in range(len(b)):
                        bins, y = taken(b.column(0)[k].as_py(), b.column(1)[k].as_py())
                        out = out + gbt.histogram(bins, y, model.raw(bins), tree, level, BINS)
                if not np.isscalar(out):
                    yield pa.RecordBatch.from_arrays([pa.array([out.tobytes()], pa.binary())], ["h"])

            found = rows.mapInArrow(run, "h binary").collect()  # 120 kB from each of TASKS tasks, or from each file's part
            return sum(np.frombuffer(r["h"], dtype=np.int64) for r in found).reshape(len(level), len(FEATURES), BINS, 3)

    trees = gbt.fit_sums(summed, edges, n, bad, n_trees=TREES)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if len(b):
                step = np.floor(trees.proba(_matrix(b.column("x"))) * STEPS).astype(np.int64)
                good = b.column("label").to_numpy(zero_copy_only=False)
                at = np.unique(step)
                k = np.searchsorted(at, step)
                yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(np.bincount(k)), pa.array(np.bincount(k, weights=good).astype(np.int64))], ["step", "n", "good"])

    steps = table.where("part = 1").mapInArrow(scored, "step long, n long, good long").groupBy("step").agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
    threshold, over, unwanted = 1.01, 0, 0
    for r in sorted(steps.collect(), key=lambda r: -r["step"]):  # STEPS + 1 rows at most
        over, unwanted = over + r["n"], unwanted + r["good"]
        if unwanted >= precision * over:
            threshold = r["step"] / STEPS
    return UrlModel(trees, threshold, {s: _taken(c, (0, 2)) for s, c in hot.items()}, mean), rare


def judge_urls(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES, model: UrlModel | None = None, max_train: int | None = None,
    html_col: str | None = "html", labelled: DataFrame | None = None,
) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, score.

    score is the trees' probability that the url is unwanted, given for every row; verdict is the rule's, or block where
    the score reaches the calibrated threshold. labelled (url, label of 0 or 1) is what the trees learn from; without it
    labelled_urls() makes the labels. All urls are learnt from, unless a caller sets max_train. Null urls have empty host and path, no rule, and
    are judged on all-zero features. Repeated rows give repeated rows. An empty table gives an empty result. Html, where
    pages has it, is read for labels only; other columns are not read.
    """
    hot, rare = {}, None
    if model is None:
        if labelled is None:
            found = labelled_urls(pages, url_col, html_col, max_train)
        else:
            found = labelled.where("url is not null and label is not null").groupBy("url").agg(F.max("label").cast("int").alias("label"))
            found = found if max_train is None else found.orderBy(F.md5("url"), "url").limit(max_train)
        model, rare = train_all(found)
        hot = model.known
    d = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("__url"))
    host, path = parts(F.col("__url"))
    d = d.withColumn("host", F.coalesce(host, F.lit(""))).withColumn("path", F.coalesce(path, F.lit("")))
    rule, verdict = rule_columns(F.col("host"), F.col("path"), rules)
    d = _with_rare(d.withColumn("rule", rule).withColumn("verdict", verdict), "__url", hot, rare)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seen = [[_taken(c, (0, 2)) for c in pair] for pair in zip(b.column("c1").to_pylist(), b.column("c2").to_pylist())]
            p = model.score(b.column("__url").to_pylist(), seen)
            said = pa.array([v or ("block" if s >= model.threshold else "allow") for v, s in zip(b.column("verdict").to_pylist(), p)], pa.string())
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("host"), b.column("path"), b.column("rule"), said, pa.array(p)], ["page_id", "host", "path", "rule", "verdict", "score"])

    kind = dict(d.dtypes)["page_id"]
    return d.mapInArrow(score, f"page_id {kind}, host string, path string, rule string, verdict string, score double")
