"""Quality classifier: a sparse ensemble of rules, compiled into Spark columns.

Statistics of a text are Spark expressions. On a bounded sample of labelled rows shallow regression trees are boosted on
the statistics; every path from a root is a rule, a conjunction of comparisons. Rules are the 0/1 inputs of a logistic
regression under a lasso penalty, which sets most weights to zero. What is left is one Spark expression: the
logistic function of a sum of weighted conditions. The penalty is the largest whose loss on a fifth of the sample is within
one standard error of the least.

Bound: ``most`` labelled rows are used for training, those with the smallest hash of the id; only their statistics come to
the driver. Every text is scored, on the executors, from whole texts.

Defined cases: null and empty texts have statistics of 0 and are scored like any other; labels that are null, of
a null id or contradictory are left out; with fewer than two classes the score is the share of label 1 (0.5 without labels).
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from tendersift.llm.common import WORD, prepare, table

Condition = tuple[int, bool, float]  # statistic, greater than, threshold


def statistics(text: Column) -> dict[str, Column]:
    """Named statistics of a whole text. Words and lines are split once each."""
    t = F.coalesce(text, F.lit(""))
    words = F.regexp_extract_all(t, F.lit(WORD), F.lit(0))
    lines = F.filter(F.split(t, "\n"), lambda x: F.length(F.trim(x)) > 0)
    n, chars = F.size(words), F.length(t)
    per_word = lambda c: F.coalesce(c / F.nullif(n, F.lit(0)), F.lit(0.0))
    per_char = lambda c: F.coalesce(c / F.nullif(chars, F.lit(0)), F.lit(0.0))
    kept = lambda pattern: chars - F.length(F.regexp_replace(t, pattern, ""))
    bigrams = F.zip_with(F.slice(words, 1, F.greatest(n - 1, F.lit(0))), F.slice(words, 2, F.greatest(n - 1, F.lit(0))),
                         lambda a, b: F.xxhash64(a, b))
    return {
        "log_words": F.log1p(n.cast("double")),
        "word_length": per_word(chars),
        "symbols": per_word(kept(r"[#*$%&|<>{}=_~^\\]+")),
        "digits": per_char(kept(r"[0-9]+")),
        "marks": per_char(kept(r"[.,;:!?\"'()-]+")),
        "shouts": per_word(kept(r"[!]+")),
        "capitals": per_char(kept(r"\p{Lu}+")),
        "distinct_words": per_word(F.size(F.array_distinct(words))),
        "distinct_pairs": F.coalesce(F.size(F.array_distinct(bigrams)) / F.nullif(F.greatest(n - 1, F.lit(0)), F.lit(0)), F.lit(0.0)),
        "same_neighbours": per_word(F.size(F.filter(
            F.zip_with(F.slice(words, 1, F.greatest(n - 1, F.lit(0))), F.slice(words, 2, F.greatest(n - 1, F.lit(0))), lambda a, b: a == b),
            lambda x: x))),
        "distinct_lines": F.coalesce(F.size(F.array_distinct(lines)) / F.nullif(F.size(lines), F.lit(0)), F.lit(0.0)),
        "words_per_line": F.coalesce(n / F.nullif(F.size(lines), F.lit(0)), F.lit(0.0)),
    }


def grow(x: np.ndarray, target: np.ndarray, depth: int, smallest: int, cuts: int = 16) -> tuple[np.ndarray, list[tuple[Condition, ...]]]:
    """A least-squares tree: its fitted values and all its paths."""
    fitted, paths = np.zeros(len(target)), []

    def split(rows: np.ndarray, path: tuple[Condition, ...]) -> None:
        fitted[rows] = target[rows].mean()
        if path:
            paths.append(path)
        if len(path) == depth or len(rows) < 2 * smallest:
            return
        best: tuple[float, int, float] | None = None
        total = target[rows].sum()
        base = total**2 / len(rows)
        for j in range(x.shape[1]):
            values = x[rows, j]
            for cut in np.unique(np.quantile(values, np.linspace(0, 1, cuts + 2)[1:-1])):
                right = values > cut
                m = int(right.sum())
                if smallest <= m <= len(rows) - smallest:
                    s = target[rows][right].sum()
                    gain = s**2 / m + (total - s) ** 2 / (len(rows) - m) - base
                    if gain > 1e-9 and (best is None or gain > best[0] + 1e-12):
                        best = (gain, j, float(cut))
        if best:
            _, j, cut = best
            up = x[rows, j] > cut
            split(rows[~up], (*path, (j, False, cut)))
            split(rows[up], (*path, (j, True, cut)))

    split(np.arange(len(target)), ())
    return fitted, paths


def holds(x: np.ndarray, rule: Iterable[Condition]) -> np.ndarray:
    out = np.ones(len(x), bool)
    for j, greater, cut in rule:
        out &= (x[:, j] > cut) == greater
    return out


def extract_rules(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 3, rate: float = 0.1, seed: int = 7) -> list[tuple[Condition, ...]]:
    """Rules of boosted trees, each grown on a half of the rows; rules that hold for the same rows count once."""
    rng = np.random.default_rng(seed)
    score, rules, seen = np.zeros(len(y)), [], set()
    for _ in range(trees):
        rows = np.sort(rng.permutation(len(y))[: max(1, len(y) // 2)])
        residual = y - 1 / (1 + np.exp(-score))
        _, paths = grow(x[rows], residual[rows], depth, max(5, len(rows) // 500))
        leaves = np.zeros(len(y))
        for path in sorted(paths, key=len):  # the deepest path that holds decides
            mask = holds(x, path)
            leaves[mask] = residual[mask].mean() if mask.any() else 0.0
            mark = np.packbits(mask).tobytes()
            if 0 < mask.sum() < len(y) and mark not in seen:
                seen.add(mark)
                rules.append(path)
        score += 10 * rate * leaves
    return rules


def lasso_logistic(z: np.ndarray, y: np.ndarray, penalty: float, start: np.ndarray | None = None, rounds: int = 400) -> np.ndarray:
    """Weights (the last one is the free intercept) by accelerated proximal gradient steps."""
    a = np.hstack([z, np.ones((len(z), 1))])
    w = np.zeros(a.shape[1]) if start is None else start.copy()
    v, t = w.copy(), 1.0
    g = a.T @ a / len(a) / 4
    u = np.ones(len(g))
    for _ in range(30):  # largest curvature, by power iteration
        u = g @ u
        u /= np.linalg.norm(u)
    step = 1 / max(float(u @ g @ u) * 1.05, 1e-6)
    for _ in range(rounds):
        new = v - step * (a.T @ (1 / (1 + np.exp(-np.clip(a @ v, -500, 500))) - y)) / len(a)
        new[:-1] = np.sign(new[:-1]) * np.maximum(np.abs(new[:-1]) - step * penalty, 0)
        s = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, moved = new + (t - 1) / s * (new - w), np.abs(new - w).max()
        w, t = new, s
        if moved < 1e-7:
            break
    return w


class RuleFit:
    """Rules, their weights and the intercept."""

    def __init__(self, x: np.ndarray, y: np.ndarray, names: list[str]):
        self.names, self.rules, self.weights = names, [], np.zeros(0)
        share = float(np.clip(y.mean(), 1e-6, 1 - 1e-6)) if len(y) else 0.5
        self.intercept = float(np.log(share / (1 - share)))
        if len(y) < 20 or y.min() == y.max():
            return
        test = np.arange(len(y)) % 5 == 0
        rules = extract_rules(x[~test], y[~test])
        z = np.stack([holds(x, r) for r in rules], axis=1).astype(np.float64)
        tried, start = [], None
        for penalty in (0.03, 0.01, 0.003, 0.001, 0.0003):
            start = lasso_logistic(z[~test], y[~test], penalty, start)
            p = np.clip(1 / (1 + np.exp(-np.clip(z[test] @ start[:-1] + start[-1], -500, 500))), 1e-9, 1 - 1e-9)
            loss = -(y[test] * np.log(p) + (1 - y[test]) * np.log(1 - p))
            tried.append((float(loss.mean()), float(loss.std() / np.sqrt(len(loss))), penalty))
        least, error, _ = min(tried)
        w = lasso_logistic(z, y, max(penalty for loss, _, penalty in tried if loss <= least + error))
        self.rules = [r for r, c in zip(rules, w) if c != 0]
        self.weights, self.intercept = w[:-1][w[:-1] != 0], float(w[-1])

    def column(self) -> Column:
        """Score of a row that has the statistics as columns."""
        terms = [F.lit(self.intercept)]
        for rule, w in zip(self.rules, self.weights):
            met = F.lit(True)
            for j, greater, cut in rule:
                c = F.col(self.names[j])
                met = met & ((c > cut) if greater else (c <= cut))
            terms.append(F.when(met, float(w)).otherwise(0.0))
        while len(terms) > 1:  # added in pairs, which keeps the expression flat
            terms = [a + b for a, b in zip(terms[::2], terms[1::2])] + terms[len(terms) & ~1 :]
        return 1 / (1 + F.exp(-terms[0]))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", most: int = 10000) -> RuleFit:
    """Fit on labelled rows whose crc32(id) mod 5 is not 0."""
    chosen = (labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & (F.crc32(F.col("doc_id").cast("string")) % 5 != 0))
              .groupBy("doc_id").agg(F.min(label).alias("label"), F.max(label).alias("other")).where("label = other")
              .select("doc_id", "label").orderBy(F.xxhash64("doc_id"), "doc_id").limit(most))
    stats = statistics(F.col("text"))
    # Row order decides the halves the trees see, so it is fixed.
    rows = (docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
            .select("doc_id", "label", *[c.alias(n) for n, c in stats.items()]).toPandas().drop_duplicates("doc_id").sort_values("doc_id"))
    return RuleFit(rows[list(stats)].to_numpy(float), rows["label"].to_numpy(float), list(stats))


def score_quality(docs: DataFrame, model: RuleFit) -> DataFrame:
    """doc_id and score. The statistics are computed in a projection of their own, once per row."""
    stats = statistics(F.col("text"))
    return docs.select("doc_id", *[c.alias(n) for n, c in stats.items()]).select("doc_id", model.column().alias("score"))


def op4_quality(spark, sf_dir: str) -> DataFrame:
    prepare(spark)
    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels"))
    return score_quality(docs, model).select(
        "doc_id", (F.crc32(F.col("doc_id").cast("string")) % 5 == 0).alias("held_out"), "score",
        (F.col("score") >= 0.3).cast("int").alias("predicted"))
