"""Quality rules as weak supervision.

Every rule votes good (1), bad (-1) or abstains (0) from counts of the whole text. Votes of all documents are counted
by pattern (at most 3^11 patterns, whatever the number of documents); expectation-maximisation over the patterns
estimates how often each rule is right when it votes on good and on bad documents, and the share of good ones. The
posterior probability of good replaces an all-must-pass filter. Abstaining says nothing.

A bad document fails some rules and passes the others, so the accuracy on bad ones may be low; it is only held above
the rate of false alarms on good ones, and the accuracy on good ones above 0.7, which keeps good and bad from changing
places. A document is kept when the base test passes and the posterior is at least 0.5.

Defined cases: null and empty texts have no words and fail the base test; an empty table gives no rows; repeated rows
are judged alike. Very long texts are judged whole.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from tendersift.llm.common import append, prepare, staged, table

WINDOW, SYMBOLS, BARS, SPACES = 8, b"#*$%&|<>", b"|", b" \t\n\x0b\x0c\r"
MARKS = bytes(b for b in range(33, 127) if not chr(b).isalpha())
_OTHERS = bytes(b for b in range(256) if b not in SYMBOLS and b not in SPACES)
_ENDS = (b".", b"!", b"?", b"\xe2\x80\xa6")


def repeated(words: list[bytes], window: int = WINDOW) -> int:
    """Words inside a window that is found twice or more. Exact: windows are named by ranking pairs of halves.

    ``window`` is a power of two.
    """
    n = len(words)
    if n <= window:
        return 0
    number = {w: i for i, w in enumerate(dict.fromkeys(words))}
    rank, size = np.array([number[w] for w in words], np.int64), 1
    while size < window:
        pair = rank[:-size] * (int(rank.max()) + 1) + rank[size:]
        values, rank = np.unique(pair, return_inverse=True)
        if len(values) == len(pair):
            return 0
        size *= 2
    twice = np.bincount(rank)[rank] > 1
    edges = np.zeros(n + 1, np.int64)
    edges[: len(twice)] += twice
    edges[window : window + len(twice)] -= twice
    return int(np.count_nonzero(np.cumsum(edges)[:n]))


def text_counts(text: str | None) -> dict[str, int]:
    data = (text or "").encode("utf-8", "surrogatepass")
    words = data.split()
    seen: set[bytes] = set()
    duplicates = n_lines = ended = 0
    for line in data.split(b"\n"):
        bare = line.strip()
        if bare:
            n_lines += 1
            ended += bare.endswith(_ENDS)
            if line in seen:
                duplicates += 1
            seen.add(line)
    return {
        "n_words": len(words),
        "word_chars": len(text or "") - (len(data) - len(data.translate(None, SPACES))),
        "n_symbols": len(data) - len(data.translate(None, SYMBOLS)),
        "n_dup_lines": duplicates,
        "n_repeat_words": repeated(words),
        "n_lines": n_lines,
        "n_ended_lines": ended,
        "n_symbol_words": len(data.translate(None, _OTHERS).split()),
        "n_marks": len(data) - len(data.translate(None, MARKS)),
        "n_bars": len(data) - len(data.translate(None, BARS)),
        "n_upper_words": sum(1 for w in words if len(w) > 1 and w.isupper()),
        "n_distinct": len(set(words)),
    }


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_ended_lines",
          "n_symbol_words", "n_marks", "n_bars",
          "n_upper_words", "n_distinct")


def _vote(bad: Column, good: Column) -> Column:
    return F.when(bad, -1).when(good, 1).otherwise(0)


def votes(prefix: str = "") -> dict[str, Column]:
    """The rules. Ratios are compared as products, so that no division by zero occurs."""
    c = {name: F.col(prefix + name) for name in COUNTS}
    n, lines = c["n_words"], c["n_lines"]
    return {
        "length": _vote(n < 20, (n >= 50) & (n <= 100_000)),
        "symbols": _vote(c["n_symbols"] > 0.2 * n, c["n_symbols"] <= 0.02 * n),
        "symbol_words": _vote(c["n_symbol_words"] > 0.2 * n, c["n_symbol_words"] <= 0.02 * n),
        "letters": _vote(100 * c["n_marks"] > 20 * c["word_chars"], 100 * c["n_marks"] <= 8 * c["word_chars"]),
        "word_size": _vote((c["word_chars"] < 2 * n) | (c["word_chars"] > 15 * n), (c["word_chars"] >= 3 * n) & (c["word_chars"] <= 12 * n)),
        "duplicate_lines": _vote((lines >= 3) & (10 * c["n_dup_lines"] > 3 * lines), (lines >= 3) & (c["n_dup_lines"] == 0)),
        "repetition": _vote(100 * c["n_repeat_words"] > 25 * n, 100 * c["n_repeat_words"] <= 2 * n),
        "capitals": _vote(c["n_upper_words"] > 0.3 * n, c["n_upper_words"] <= 0.05 * n),
        "variety": _vote((n >= 20) & (n <= 500) & (c["n_distinct"] < 0.35 * n), (n <= 500) & (c["n_distinct"] >= 0.5 * n)),
        "ended_lines": _vote((lines > 0) & (10 * c["n_ended_lines"] < lines), 2 * c["n_ended_lines"] >= lines),
        "bars": _vote(c["n_bars"] > 0.1 * n, F.when(c["n_bars"] == 0, F.lit(True)).otherwise(F.lit(False))),
    }


def estimate(patterns: np.ndarray, counts: np.ndarray, tolerance: float = 1e-10, most: int = 2000) -> tuple[float, np.ndarray, np.ndarray]:
    """Share of good documents, and each rule's accuracy on good and on bad ones, by expectation-maximisation.

    One row of ``patterns`` is one combination of votes. Starts from accuracies of 0.95 and 0.3 and a share of 0.8.
    """
    up, down = patterns > 0, patterns < 0
    share, on_good, on_bad = 0.8, np.full(patterns.shape[1], 0.95), np.full(patterns.shape[1], 0.3)
    for _ in range(most):
        good = np.log(share) + up @ np.log(on_good) + down @ np.log1p(-on_good)
        bad = np.log1p(-share) + down @ np.log(on_bad) + up @ np.log1p(-on_bad)
        posterior = 1 / (1 + np.exp(np.clip(bad - good, -700, 700)))
        w_good, w_bad = counts * posterior, counts * (1 - posterior)
        # One vote of each kind is added, so that a rule that never votes keeps its start.
        right = np.clip((w_good @ up + 0.95) / (w_good @ (up | down) + 1), 0.7, 0.999)
        caught = (w_bad @ down + 0.3) / (w_bad @ (up | down) + 1)
        new = (np.clip((w_good.sum() + 0.8) / (counts.sum() + 1), 0.05, 0.999), right, np.clip(caught, 1.01 - right, 0.999))
        moved = max(abs(new[0] - share), np.abs(new[1] - on_good).max(), np.abs(new[2] - on_bad).max())
        share, on_good, on_bad = new
        if moved < tolerance:
            break
    return float(share), on_good, on_bad


def counts_of(texts: list[str | None], names: tuple[str, ...] = COUNTS) -> dict[str, list]:
    rows = [text_counts(t) for t in texts]
    return {n: [x[c] for x in rows] for n, c in zip(names, COUNTS)}


def verdicts(counted: DataFrame, prefix: str = "") -> dict[str, Column]:
    """base_failed, quality and kept as columns over a table of counts, with rules weighed by its votes."""
    rules = votes(prefix)
    tally = counted.select(*[v.alias(n) for n, v in votes().items()]).groupBy(*rules).count().toPandas()
    n, again = F.col(prefix + "n_words"), F.col(prefix + "n_repeat_words")
    failed = (n < 20) | (100 * again > 30 * n)
    quality = F.lit(0.0)
    if len(tally):
        share, on_good, on_bad = estimate(tally[list(rules)].to_numpy(), tally["count"].to_numpy(float))
        score = F.lit(float(np.log(share / (1 - share))))
        for vote, a, b in zip(rules.values(), on_good, on_bad):
            score = score + F.when(vote > 0, float(np.log(a / (1 - b)))).when(vote < 0, float(np.log((1 - a) / b))).otherwise(0.0)
        quality = 1 / (1 + F.exp(-score))
    return {"base_failed": failed, "quality": quality, "kept": ~failed & (quality >= 0.5)}


def count_table(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key`` and the counts of every text, written to the shared folder."""
    prepare(docs.sparkSession)
    return staged(append(docs.select(F.col(key).alias("key"), F.col(text).alias("text")), counts_of,
                         ", ".join(f"{c} bigint" for c in COUNTS)).drop("text"))


def judge(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, the counts, ``base_failed``, the posterior ``quality`` and ``kept``."""
    counted = count_table(docs, key, text)
    return counted.withColumns(verdicts(counted)).withColumnRenamed("key", key)


def keep_good(docs: DataFrame) -> DataFrame:
    """The documents that are kept, with their own columns. Texts are counted twice rather than shuffled once."""
    found = verdicts(count_table(docs), "_q_")
    own = tuple("_q_" + c for c in COUNTS)
    counted = append(docs, lambda t: counts_of(t, own), ", ".join(f"{c} bigint" for c in own))
    return counted.where(found["kept"]).select(*docs.columns)


def op6_quality_rules(spark, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality")
