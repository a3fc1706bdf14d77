"""URL verdicts from host and path rules and, where no rule fits, from gradient-boosted trees on lexical features.

Features: length of the url, host and path; depth; digit ratio; entropy; parameters; hyphens; digits at the path's end;
how often urls with the same host suffix, and with the same path suffix, are blocked among the labelled ones. Trees are
grown by histograms on a bounded sample (SAMPLE labelled urls of each label, chosen by a hash). Suffix statistics come
from all labelled urls, in a fixed number of slots. Labels come as a table (url, label) or, without one, from the rules: the
urls that a rule decides are the labelled ones, and the trees carry their verdicts over to the others.

Defined results: a null url, or one without ://, has an empty host and path, fits no rule and is judged by the trees as
an empty text. Labels other than 0 and 1 don't count. Without labelled urls of both labels every url that fits no rule is allowed, or blocked if all labels
are blocked. Rows that repeat get equal results; a null page_id stays; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow, prepare, trimmed
from .linear import among_first

#: Sampled urls of each label; trees, their depth, step and histogram bins; slots of suffix statistics.
SAMPLE, TREES, DEPTH, STEP, BINS, SLOTS = 4000, 40, 4, 0.2, 64, 1024
LEAST_LEAF = 5.0


def host_of(url: Column) -> Column:
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://([^/?#]*)", 1)
    return F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://[^/?#]*([^?#]*)", 1)


def parts_of(url: str | None) -> tuple[str, str]:
    """Host and path as the columns have them; the host isn't lower-cased outside A-Z."""
    _, mark, rest = (url or "").partition("://")
    if not mark:
        return "", ""
    for i, c in enumerate(rest):
        if c in "/?#":
            break
    else:
        i = len(rest)
    path = rest[i:]
    for k, c in enumerate(path):
        if c in "?#":
            path = path[:k]
            break
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:i]), path


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """(the longest rule that fits, its verdict), from (verdict, host and path); null where none fits."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, r in sorted(rules, key=lambda x: len(x[1])):
        rule_host, slash, rule_path = r.partition("/")
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(slash + rule_path)
        name, verdict = F.when(fits, F.lit(r)).otherwise(name), F.when(fits, F.lit(v)).otherwise(verdict)
    return name, verdict


def _slot(text: str) -> int:
    h = 2166136261
    for b in text.encode("utf-8", "surrogatepass"):
        h = (h ^ b) * 16777619 & 0xFFFFFFFF
    return h % SLOTS


def suffixes(host: str, path: str) -> tuple[int, int]:
    """Slots of the host's last two labels and of the path's last extension or, without one, its first segment."""
    last = path.rsplit("/", 1)[-1]
    kind = "." + last.rsplit(".", 1)[-1] if "." in last else "/" + path.split("/", 2)[1] if path.count("/") > 0 else ""
    return _slot(".".join(host.split(".")[-2:])), _slot("path:" + kind)


FEATURES = ("url_length", "host_length", "path_length", "depth", "labels", "digit_ratio", "entropy", "parameters", "hyphens", "final_digits", "host_suffix", "path_suffix")


def lexical(urls: list[str | None], blocked: np.ndarray) -> np.ndarray:
    """A row of features for each url; blocked: the share of blocked urls for each slot."""
    out = np.zeros((len(urls), len(FEATURES)), np.float32)
    for i, u in enumerate(urls):
        host, path = parts_of(u)
        u = u or ""
        raw = np.frombuffer(u.encode("utf-8", "surrogatepass"), np.uint8)
        share = np.bincount(raw)[np.unique(raw)] / len(raw) if len(raw) else np.ones(1)
        a, b = suffixes(host, path)
        query = u.partition("?")[2].partition("#")[0]
        digits = sum(c.isdigit() for c in u)
        out[i] = (len(u), len(host), len(path), path.rstrip("/").count("/"), host.count("."), digits / max(1, len(u)), -(share * np.log2(share)).sum(), query.count("=") + query.count("&"), host.count("-"), len(path) - len(path.rstrip("0123456789")), blocked[a], blocked[b])
    return out


@dataclass
class Trees:
    """Full binary trees: node k has the children 2k+1 and 2k+2."""

    base: float
    feature: np.ndarray
    limit: np.ndarray
    value: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        for f, t, v in zip(self.feature, self.limit, self.value, strict=True):
            at = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                at = 2 * at + 1 + (x[np.arange(len(x)), f[at]] > t[at])
            total += v[at - (2**DEPTH - 1)]
        return 1 / (1 + np.exp(-total))


def boost(x: np.ndarray, y: np.ndarray) -> Trees:
    """Second-order boosting of the logistic loss; splits are at quantiles of each feature."""
    n, d = x.shape
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y == 0).sum())) * n
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(d)]
    bins = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1)
    inner, leaves = 2**DEPTH - 1, 2**DEPTH
    feature, limit, value = (np.zeros((TREES, k), t) for k, t in ((inner, np.int64), (inner, np.float32), (leaves, np.float64)))
    limit += np.float32(np.inf)
    total = np.zeros(n)
    for r in range(TREES):
        p = 1 / (1 + np.exp(-total))
        g, h = weight * (p - y), weight * p * (1 - p)
        at = np.zeros(n, np.int64)
        for level in range(DEPTH):
            for node in range(2**level - 1, 2 ** (level + 1) - 1):
                rows = np.flatnonzero(at == node)
                best = (1e-6, 0, np.inf)
                if len(rows) >= 2 * LEAST_LEAF:
                    gs, hs = g[rows].sum(), h[rows].sum()
                    for j in range(d):
                        k = len(edges[j]) + 1
                        gl, hl, nl = (np.cumsum(np.bincount(bins[rows, j], w, minlength=k))[:-1] for w in (g[rows], h[rows], np.ones(len(rows))))
                        gain = gl**2 / (hl + 1) + (gs - gl) ** 2 / (hs - hl + 1) - gs**2 / (hs + 1)
                        gain[(nl < LEAST_LEAF) | (len(rows) - nl < LEAST_LEAF)] = 0
                        if len(gain) and gain.max() > best[0]:
                            best = (float(gain.max()), j, float(edges[j][int(gain.argmax())]))
                feature[r, node], limit[r, node] = best[1], best[2]
            at = 2 * at + 1 + (x[np.arange(n), feature[r, at]] > limit[r, at])
        leaf = at - inner
        value[r] = -STEP * np.bincount(leaf, g, minlength=leaves) / (np.bincount(leaf, h, minlength=leaves) + 1)
        total += value[r, leaf]
    return Trees(0.0, feature, limit, value)


def suffix_rates(labelled: DataFrame) -> np.ndarray:
    """The smoothed share of blocked urls for each slot, over all rows (url, label)."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, blocked = np.zeros(SLOTS, np.int64), np.zeros(SLOTS, np.int64)
        for b in parts:
            for u, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for s in suffixes(*parts_of(u)):
                    n[s] += 1
                    blocked[s] += y
        some = np.flatnonzero(n)
        yield pa.record_batch([pa.array(some.astype(np.int32)), pa.array(n[some]), pa.array(blocked[some])], names=["slot", "n", "blocked"])

    rows = labelled.select("url", "label").mapInArrow(trimmed(run), "slot int, n long, blocked long").groupBy("slot").agg(F.sum("n").alias("n"), F.sum("blocked").alias("blocked")).collect()  # SLOTS rows at most
    n, blocked = np.zeros(SLOTS), np.zeros(SLOTS)
    for r in rows:
        n[r["slot"]], blocked[r["slot"]] = r["n"], r["blocked"]
    mean = blocked.sum() / max(1, n.sum())
    return ((blocked + 5 * mean) / (n + 5)).astype(np.float32)


def train(labelled: DataFrame) -> tuple[Trees, np.ndarray]:
    """(trees, suffix statistics) from rows (url, label), label 1 for blocked."""
    prepare(labelled.sparkSession)
    labelled = labelled.where("label in (0, 1)")
    rates = suffix_rates(labelled)
    urls, labels = [], []
    counts = {r["label"]: r["count"] for r in labelled.groupBy("label").count().collect()}  # two rows
    for y in sorted(counts):
        few = labelled.where((F.col("label") == y) & among_first(F.col("url"), SAMPLE, counts[y]))
        some = few.select("url").distinct().orderBy(F.xxhash64("url"), "url").limit(SAMPLE).collect()  # SAMPLE rows
        urls += [r["url"] for r in some]
        labels += [y] * len(some)
    y = np.array(labels, np.float64)
    if len(set(labels)) < 2:
        none = np.zeros((0, 1))
        return Trees(10.0 if labels and labels[0] else -10.0, none.astype(int), none, none), rates
    return boost(lexical(urls, rates), y), rates


def judge(pages: DataFrame, rules: list[tuple[str, str]], labelled: DataFrame | None = None, limit: float = 0.5) -> DataFrame:
    """(page_id, host, path, rule, verdict, score). Unless labelled urls are given, those that a rule decides are the labelled ones."""
    spark = prepare(pages.sparkSession)
    url = F.col("url").cast("string")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), url.alias("url"), host_of(url).alias("host"), path_of(url).alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": rule, "ruled": verdict})
    if labelled is None:
        labelled = rows.where("ruled is not null").select("url", (F.col("ruled") == "block").cast("int").alias("label"))
    model = spark.sparkContext.broadcast(train(labelled))
    kind = "page_id long, host string, path string, rule string, verdict string, score double"
    out = arrow(kind)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees, rates = model.value
        for b in parts:
            score = trees.score(lexical(b.column(1).to_pylist(), rates))
            told = [r or ("block" if s >= limit else "allow") for r, s in zip(b.column(5).to_pylist(), score.tolist(), strict=True)]
            yield pa.record_batch([b.column(0), b.column(2), b.column(3), b.column(4), pa.array(told), pa.array(score)], schema=out)

    return rows.mapInArrow(trimmed(run), kind)
