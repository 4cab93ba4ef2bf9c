"""Toxicity from the nearest labelled examples.

Texts are vectors of TF-IDF weights over all their terms, scaled to length 1; document frequencies are counted over all
documents. Labelled examples of each label stand in a block-max inverted index: alike examples are neighbours in blocks of
``BLOCK``, and every common term keeps its largest weight in each block. A search sums the postings of the other terms,
bounds each block by these sums and the maxima, scores the blocks with the best bounds, and then only those whose bound
reaches the k-th best cosine so far. The neighbours are the exact nearest by plain cosine.

Neighbours vote with their cosine, beside a prior of the base rate; near copies (cosine of ``COPY``) among them share one
vote. Label knowledge stays out of the cosine. It is in the calibration: a logistic curve over the votes and over the
share of the match with the ``POSITIVE`` nearest examples of label 1 that comes from terms which tell the labels apart
(chi-squared test). The curve is fitted on the training rows, each without itself. A training row's own score and
evidence do hold itself.

The length of a vector needs the frequency of every term. Those of the examples' terms and of terms in a thousandth of
the documents are broadcast; the few other terms of a text leave the task and are joined with the frequencies.

Bound: ``most`` labelled rows are used for training, those with the smallest hash of the id. The index, at most
``most`` examples, is broadcast. Every text is scored. ``terms`` bounds the telling terms.

Defined cases: null and empty texts, and texts that share no term with an example, have no neighbours and get the score
of the base rate among such training texts; equal cosines go to the smaller example id; rows of the labels table that
repeat count once, those with a null id or label or with both labels are left out of training; an id that repeats in the
documents trains with its smallest text; without training rows of both labels the score is the base rate, 0.5 without
any. Very long texts are one vector like all others. Other columns of the tables are not read.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tendersift.llm.common import arrow_schema, in_batches, prepare, staged, table

TERM = re.compile(r"[^\W\d_]+")
#: Spaces for all ASCII characters that stand in no lower-case term.
PARTS = bytes(i if i >= 128 or chr(i).isalpha() else 32 for i in range(256))
#: Terms of more than one in so many examples have block maxima.
COMMON = 16
#: Examples in a block, blocks scored before the first threshold, centres by which examples are arranged.
BLOCK, AHEAD, CENTRES = 32, 4, 16
#: Examples whose copies are searched at once on the driver.
ASKED = 64
#: Cosine from which two examples of one label share a vote.
COPY = 0.9
#: Nearest examples of label 1 whose match is looked at for telling terms.
POSITIVE = 5
#: Weight of the base rate beside the cosines, and the share that a match without telling terms counts as.
PRIOR, NO_SHARE = 0.1, 0.003
#: Sums in another order differ by less.
NOISE = 1e-9
#: Distinct terms a task counts before it hands them on.
COUNTED = 200_000

Vector = tuple[np.ndarray, np.ndarray]


def term_counts(text: str | None) -> Counter:
    """How often each term occurs. Pieces between ASCII characters that are no letters are terms, unless they hold other such characters."""
    pieces = Counter((text or "").lower().encode("utf-8", "surrogatepass").translate(PARTS).decode("utf-8", "surrogatepass").split())
    for piece in [p for p in pieces if not p.isalpha()]:
        n = pieces.pop(piece)
        for term in TERM.findall(piece):
            pieces[term] += n
    return pieces


def term_weights(text: str | None) -> dict[str, float]:
    """1 + ln(count) of every term."""
    return {t: 1.0 + math.log(c) if c > 1 else 1.0 for t, c in term_counts(text).items()}


def training_rows(docs: DataFrame, labels: DataFrame, label: str, most: int) -> DataFrame:
    """doc_id, label and text of at most ``most`` labelled rows whose crc32(id) mod 5 is not 0."""
    chosen = (labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & (F.crc32(F.col("doc_id").cast("string")) % 5 != 0))
              .groupBy("doc_id").agg(F.min(label).alias("label"), F.max(label).alias("other")).where("label = other")
              .select("doc_id", "label").orderBy(F.xxhash64("doc_id"), "doc_id").limit(most))
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))


def ranges(start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The numbers of all ranges [start, end), one after the other."""
    size = end - start
    return np.arange(size.sum()) + np.repeat(start - (np.cumsum(size) - size), size)


def scaled(terms: np.ndarray, tf: np.ndarray, weight: np.ndarray) -> Vector:
    """Term frequency weights times term weights, as a vector of length 1."""
    w = tf * weight[terms]
    return terms, w / np.sqrt((w * w).sum()) if len(w) else w


def arrangement(rows: np.ndarray) -> np.ndarray:
    """An order in which alike rows are near each other: by the best of a few centres, then by length."""
    length = np.sqrt((rows * rows).sum(1))
    units = rows / np.where(length > 0, length, 1.0)[:, None]
    # Each first centre is the row that is least like those before it.
    chosen, like = [0], units @ units[0]
    while len(chosen) < min(CENTRES, len(rows)):
        chosen.append(int(like.argmin()))
        like = np.maximum(like, units @ units[chosen[-1]])
    centres = rows[chosen]
    for _ in range(6):
        size = np.sqrt((centres * centres).sum(1))
        of = (rows @ (centres / np.where(size > 0, size, 1.0)[:, None]).T).argmax(1)
        centres = np.stack([rows[of == c].sum(0) for c in range(len(centres))])
    return np.lexsort((length, of))


class Index:
    """Examples of one label as unit vectors, in postings by term; common terms in blocks with their maxima.

    ``names`` has the ids of the examples that each vector stands for; equal vectors are one.
    """

    def __init__(self, vectors: list[Vector], names: list[list[int]], terms: int, telling: np.ndarray | None = None):
        per_term = np.bincount(np.concatenate([np.zeros(0, np.int64), *[v[0] for v in vectors]]).astype(np.int64), minlength=terms)
        common = np.flatnonzero(per_term * COMMON > len(vectors))
        self.row = np.full(terms, -1, np.int32)
        self.row[common] = np.arange(len(common))
        rows = np.zeros((len(vectors), len(common)), np.float32)
        for i, (t, w) in enumerate(vectors):
            seen = self.row[t] >= 0
            rows[i, self.row[t[seen]]] = w[seen]
        order = arrangement(rows) if len(vectors) else np.zeros(0, int)
        del rows
        vectors = [vectors[i] for i in order]
        self.names = [sorted(names[i]) for i in order]
        self.least = np.array([n[0] for n in self.names], np.int64)
        self.blocks = -(-len(vectors) // BLOCK)
        term = np.concatenate([np.zeros(0, np.int32), *[v[0] for v in vectors]]).astype(np.int32)
        slot = np.repeat(np.arange(len(vectors), dtype=np.int32), [len(v[0]) for v in vectors])
        w = np.concatenate([np.zeros(0), *[v[1] for v in vectors]])
        by_term = np.argsort(term, kind="stable")
        self.slot, self.w = slot[by_term], w[by_term]
        self.first = np.searchsorted(term[by_term], np.arange(terms + 1))
        self.common, self.telling = common, np.zeros(0, int) if telling is None else telling
        #: Blocks scored and blocks there were, for tests.
        self.scored = self.asked = 0

    def _dense(self, terms: np.ndarray, slots: int) -> np.ndarray:
        out = np.zeros((len(terms), slots))
        for i, t in enumerate(terms.tolist()):
            at = slice(self.first[t], self.first[t + 1])
            out[i, self.slot[at]] = self.w[at]
        return out

    @functools.cached_property
    def block(self) -> np.ndarray:
        """(block, common term, example) weights; made where they are used, only the postings travel."""
        out = np.zeros((self.blocks, len(self.common), BLOCK))
        for i, t in enumerate(self.common.tolist()):
            at = slice(self.first[t], self.first[t + 1])
            out[self.slot[at] // BLOCK, i, self.slot[at] % BLOCK] = self.w[at]
        return out

    @functools.cached_property
    def maxima(self) -> np.ndarray:
        """(common term, block) largest weights."""
        return np.ascontiguousarray(self.block.max(2).T)

    @functools.cached_property
    def tells(self) -> np.ndarray:
        """(example, telling term) weights."""
        return np.ascontiguousarray(self._dense(self.telling, len(self.names)).T)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("block", "maxima", "tells")}

    def _fill(self, dense: np.ndarray, sums: np.ndarray, chosen: np.ndarray) -> None:
        """Add the common terms' part in the chosen (query, block) places."""
        self.scored += int(chosen.sum())
        for b in np.flatnonzero(chosen.any(0)).tolist():
            q = np.flatnonzero(chosen[:, b])
            sums[q, b] += dense[q] @ self.block[b]

    def search(self, queries: list[Vector], k: int | None, floors: np.ndarray | float = 0.0) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each query the products and slots of its k nearest (None: all) with a product above 0 and not under its
        floor, best first, equal ones by the smaller id."""
        n, nothing = len(queries), (np.zeros(0), np.zeros(0, int))
        if not self.blocks or not n:
            return [nothing] * n
        dense, sums = np.zeros((n, len(self.common))), np.zeros((n, self.blocks, BLOCK))
        flat = sums.reshape(n, -1)
        for i, (t, x) in enumerate(queries):
            row = self.row[t]
            known = row >= 0
            dense[i, row[known]] = x[known]
            rest = t[~known]
            start, end = self.first[rest], self.first[rest + 1]
            entry = ranges(start, end)
            if len(entry):
                flat[i] = np.bincount(self.slot[entry], self.w[entry] * np.repeat(x[~known], end - start), flat.shape[1])
        bound = dense @ self.maxima + sums.max(2)
        floor = np.maximum(np.broadcast_to(floors, n).astype(float), 10 * NOISE)
        done = np.zeros((n, self.blocks), bool)
        if k is not None:
            ahead = min(self.blocks, max(AHEAD, -(-k // BLOCK)))
            best = np.argpartition(-bound, ahead - 1, axis=1)[:, :ahead]
            np.put_along_axis(done, best, True, 1)
            done &= bound >= floor[:, None] - NOISE
            self._fill(dense, sums, done)
            if ahead * BLOCK >= k:
                first = np.where(np.take_along_axis(done, best, 1)[:, :, None], np.take_along_axis(sums, best[:, :, None], 1), 0.0).reshape(n, -1)
                floor = np.maximum(floor, np.partition(first, first.shape[1] - k, axis=1)[:, first.shape[1] - k])
        more = (bound >= floor[:, None] - NOISE) & ~done
        self._fill(dense, sums, more)
        done |= more
        self.asked += done.size
        near = sums >= (floor - NOISE)[:, None, None]
        near &= done[:, :, None]
        hit, at = np.nonzero(near.reshape(n, -1))
        # Rounded, so that equal examples tie whatever the order of their sums.
        value, cut, out = np.round(flat[hit, at], 12), np.searchsorted(hit, np.arange(n + 1)), []
        for i in range(n):
            slots, found = at[cut[i] : cut[i + 1]], value[cut[i] : cut[i + 1]]
            order = np.lexsort((self.least[slots], -found))[:k]
            out.append((found[order], slots[order]))
        return out

    def leaders(self) -> np.ndarray:
        """For each slot the smallest slot among its near copies."""
        out = np.arange(len(self.names))
        by_slot = np.argsort(self.slot, kind="stable")
        cut = np.searchsorted(self.slot, np.arange(len(out) + 1), sorter=by_slot)
        for at in range(0, len(out), ASKED):
            own = [by_slot[cut[i] : cut[i + 1]] for i in range(at, min(at + ASKED, len(out)))]
            part = [(np.searchsorted(self.first, x, "right") - 1, self.w[x]) for x in own]
            for i, (_, slots) in enumerate(self.search(part, None, COPY), at):
                out[i] = slots.min(initial=i)
        # The driver needs them no more, tasks make their own.
        for made in ("block", "maxima"):
            self.__dict__.pop(made, None)
        return out


def idf(n, total: int):
    return np.log((total + 1) / (np.asarray(n) + 1)) + 1


class Model:
    """Indexes of both labels. ``df`` has the number of documents, of ``total``, of each example term and maybe others;
    ``examples`` are (terms, term frequency weights) by the places of the terms in ``df``."""

    def __init__(self, examples: list[Vector], labels: list[int], names: list[int], df: dict[str, int], total: int,
                 terms: int = 512, k: int = 25):
        self.number = {t: i for i, t in enumerate(df)}
        self.weight, self.k = idf(list(df.values()), total), k
        self.rate = float(np.mean(labels)) if len(labels) else 0.5
        self.label = dict(zip(names, labels))
        of = lambda y: np.bincount(np.concatenate([np.zeros(0, np.int64), *[x[0] for x, z in zip(examples, labels) if z == y]]).astype(np.int64), minlength=len(df))
        self.telling = telling_terms(of(0), of(1), int(sum(labels)), len(labels), terms)
        self.index, self.leader = [], []
        for y in (0, 1):
            same: dict[bytes, list] = {}
            for (t, tf), z, name in zip(examples, labels, names):
                if z == y and len(t):
                    key = hashlib.sha256(np.asarray(t, np.int64).tobytes() + tf.tobytes()).digest()
                    same.setdefault(key, [(t, tf), []])[1].append(name)
            self.index.append(Index([scaled(*v, self.weight) for v, _ in same.values()], [n for _, n in same.values()], len(df), self.telling))
            self.leader.append(self.index[y].leaders())

    def look_up(self, names: list[int | None], texts: list[str | None]) -> dict[str, list]:
        """Per text: summed products of its weights with voting neighbours of label 1 (near) and of both (all), share of
        telling terms, the three nearest, squared length of the weights known here, and term frequency weights of the
        other terms. ``without`` has near, all and share of a training row without itself. Products divided by the whole
        length are cosines."""
        queries, known, others = [], [], []
        for text in texts:
            tf = term_weights(text)
            t, x = np.fromiter(map(self.number.get, tf, itertools.repeat(-1)), np.int64, len(tf)), np.fromiter(tf.values(), float, len(tf))
            # By number, so that sums do not depend on the order of words; unknown terms come first.
            order = np.argsort(t, kind="stable")
            t, x = t[order], x[order]
            new = int(np.searchsorted(t, 0))
            t, x = t[new:], x[new:] * self.weight[t[new:]]
            queries.append((t, x))
            known.append(float((x * x).sum()))
            words = list(tf) if new else []
            others.append([{"term": words[i], "tf": tf[words[i]]} for i in order[:new].tolist()])
        # One more than asked for, as a training row does not vote on itself.
        ones = self.index[1].search(queries, self.k + 1)
        floors = np.array([v[-1] if len(v) > self.k else 0.0 for v, _ in ones])
        zeros = self.index[0].search(queries, self.k + 1, floors)
        out: dict[str, list] = {"near": [], "all": [], "share": [], "three": [], "without": [], "known": known, "others": []}
        for name, query, one, zero, rest in zip(names, queries, ones, zeros, others):
            near, every, share, three = self._votes(query, one, zero, None)
            for c, v in (("near", near), ("all", every), ("share", share), ("three", three), ("others", rest if three else [])):
                out[c].append(v)
            out["without"].append(dict(zip(("near", "all", "share"), self._votes(query, one, zero, name))) if name in self.label else None)
        return out

    def _votes(self, query: Vector, one: tuple, zero: tuple, name: int | None) -> tuple[float, float, float, list]:
        """near, all, share and the three nearest from what was found of both labels, without the example ``name``."""
        value, slot = np.concatenate([one[0], zero[0]]), np.concatenate([one[1], zero[1]])
        y = np.arange(len(slot)) < len(one[1])
        ids = np.concatenate([self.index[1].least[one[1]], self.index[0].least[zero[1]]])
        leader = np.concatenate([self.leader[1][one[1]], -1 - self.leader[0][zero[1]]])
        if name is not None:
            # A vector may stand for other examples too.
            other = [[x for x in self.index[int(z)].names[s] if x != name][:1] for z, s in zip(y, slot)]
            stays = np.array([bool(x) for x in other], bool)
            ids = np.array([x[0] if x else 0 for x in other], np.int64)
            value, slot, y, ids, leader = (v[stays] for v in (value, slot, y, ids, leader))
        match = int(min(y.sum(), POSITIVE))
        share = self._share(query, slot[:match], value[:match])
        order = np.lexsort((ids, -value))[: self.k]
        # The best of each group of copies votes.
        best: dict[int, int] = {}
        for i, group in zip(order.tolist(), leader[order].tolist()):
            best.setdefault(group, i)
        voters = np.array(list(best.values()), np.int64)
        three = [{"doc_id": i, "cosine": v} for i, v in zip(ids[order[:3]].tolist(), value[order[:3]].tolist())]
        return float(value[voters][y[voters]].sum()), float(value[voters].sum()), share, three

    def _share(self, query: Vector, slots: np.ndarray, values: np.ndarray) -> float:
        """The part of the products with these examples of label 1 that telling terms bring."""
        if not len(slots) or not len(self.telling):
            return 0.0
        at = np.minimum(np.searchsorted(query[0], self.telling), len(query[0]) - 1)
        has = np.flatnonzero(query[0][at] == self.telling)
        own = self.index[1].tells[slots][:, has].sum(0) @ query[1][at[has]]
        return float(np.round(own / values.sum(), 12))


def telling_terms(zero: np.ndarray, one: np.ndarray, ones: int, n: int, terms: int, least: float = 30.0) -> np.ndarray:
    """Ascending numbers of terms that speak for label 1 with a chi-squared value over ``least``; at most ``terms``, the best."""
    a, b, zeros = one.astype(float), zero.astype(float), n - ones
    fit = np.flatnonzero((a >= 3) & (a + b >= 5) & (a + b < n) & (a * zeros > b * ones))
    a, b = a[fit], b[fit]
    chi = n * (a * (zeros - b) - b * (ones - a)) ** 2 / ((a + b) * (n - a - b) * ones * zeros) if len(fit) else a
    return np.sort(fit[np.lexsort((fit, -chi))][: min(terms, int((chi > least).sum()))])


def fit_curve(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights and shift of a logistic curve over the columns of ``x``, by Newton steps with a little damping."""
    start = np.array([1.0] + [0.0] * x.shape[1])
    if not len(y) or y.min() == y.max():
        return start
    x, w = np.column_stack([x, np.ones(len(x))]), start.copy()
    for _ in range(200):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -500, 500)))
        grad = x.T @ (p - y) + 1e-2 * (w - start)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(len(w)), grad)
        # Shorter steps far out, where the curve is flat.
        w = w - step * min(1.0, 5.0 / np.abs(step).max())
        if np.abs(step).max() < 1e-9:
            return w
    raise ArithmeticError("the calibration curve does not settle")


def document_frequencies(docs: DataFrame) -> DataFrame:
    """term, n: the number of documents of every term."""
    schema = "term string, n bigint"
    arrow = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        out = lambda: pa.RecordBatch.from_arrays([pa.array(list(seen), "string"), pa.array(list(seen.values()), "int64")], schema=arrow)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                seen.update(term_counts(text).keys())
            if len(seen) > COUNTED:
                yield out()
                seen.clear()
        yield out()

    return docs.select("text").mapInArrow(run, schema).groupBy("term").agg(F.sum("n").alias("n"))


def counted_examples(rows: DataFrame) -> DataFrame:
    """doc_id, label, terms, counts of the training rows."""
    def run(r: dict[str, list]) -> dict[str, list]:
        counts = [term_counts(text) for text in r["text"]]
        return {"doc_id": r["doc_id"], "label": r["label"], "terms": [list(x) for x in counts], "counts": [list(x.values()) for x in counts]}

    return in_batches(rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("label").cast("int").alias("label"), "text"), run,
                      "doc_id bigint, label int, terms array<string>, counts array<int>")


def fitted(docs: DataFrame, labels: DataFrame, label: str, most: int, terms: int, k: int, frequencies: DataFrame, total: int) -> Model:
    """The model of the training rows. Their terms reach the driver once each, their vectors as numbers."""
    counted = staged(counted_examples(training_rows(docs, labels, label, most)))
    # The terms of the examples, and at most a thousand times the mean number of terms in a text.
    own = frequencies.join(counted.select(F.explode("terms").alias("term")).distinct(), "term", "left_semi")
    sent = own.union(frequencies.where(F.col("n") * 1000 >= total)).distinct().toArrow().sort_by("term")
    df = dict(zip(sent["term"].to_pylist(), sent["n"].to_pylist()))
    del sent
    shared = docs.sparkSession.sparkContext.broadcast({t: i for i, t in enumerate(df)})

    def run(r: dict[str, list]) -> dict[str, list]:
        number, counts = [], []
        for t, c in zip(r["terms"], r["counts"]):
            t = np.array(list(map(shared.value.__getitem__, t)), np.int32)
            order = np.argsort(t)
            number.append(t[order])
            counts.append(np.array(c, np.int32)[order])
        return {"doc_id": r["doc_id"], "label": r["label"], "number": number, "counts": counts}

    got = in_batches(counted, run, "doc_id bigint, label int, number array<int>, counts array<int>").toArrow().sort_by("doc_id")
    names, marks, examples = got["doc_id"].to_pylist(), got["label"].to_pylist(), []
    for number, counts in zip(got["number"].chunks, got["counts"].chunks):
        cut = np.cumsum(number.value_lengths().to_numpy(zero_copy_only=False))[:-1]
        weights = 1.0 + np.log(counts.flatten().to_numpy())
        examples += zip(np.split(number.flatten().to_numpy(), cut), np.split(weights, cut)) if len(number) else ()
    del got
    shared.destroy()
    return Model(examples, marks, names, df, total, terms, k)


def score_toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic", most: int = 10000, terms: int = 512, k: int = 25) -> DataFrame:
    """doc_id, score, and the evidence: ids and cosines of the three nearest examples."""
    spark = prepare(docs.sparkSession)
    frequencies, total = staged(document_frequencies(docs)), docs.count()
    model = fitted(docs, labels, label, most, terms, k, frequencies, total)
    shared, rate = spark.sparkContext.broadcast(model), model.rate
    # Only the tasks need it from here on.
    del model

    def run(r: dict[str, list]) -> dict[str, list]:
        m = shared.value
        return {"row": r["row"], "doc_id": r["doc_id"], "label": [m.label.get(i) for i in r["doc_id"]]} | m.look_up(r["doc_id"], r["text"])

    found = staged(in_batches(docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text"), run,
                              "row bigint, doc_id bigint, label int, near double, all double, share double, known double, without struct<near: double, all: double, share: double>, "
                              "three array<struct<doc_id: bigint, cosine: double>>, others array<struct<term: string, tf: double>>"))
    weight = F.col("tf") * (F.log((F.lit(total) + 1) / (F.col("n") + 1)) + 1)
    # Added in order, so that reruns agree in the last digit.
    rest = (found.select("row", F.inline("others")).join(frequencies, "term").groupBy("row")
            .agg(F.array_sort(F.collect_list(weight * weight)).alias("squares"))
            .select("row", F.aggregate("squares", F.lit(0.0), lambda a, x: a + x).alias("rest")))
    # Without neighbours there is nothing to divide.
    length = F.when(F.col("all") > 0, F.sqrt(F.col("known") + F.coalesce("rest", F.lit(0.0)))).otherwise(F.lit(1.0))

    def curve_of(near, every, share):
        vote = (near / F.col("length") + F.lit(PRIOR * rate)) / (every / F.col("length") + PRIOR)
        vote = F.least(F.greatest(vote, F.lit(1e-6)), F.lit(1 - 1e-6))
        return F.struct(every.alias("all"), F.log(vote / (1 - vote)).alias("odds"), F.log(share + NO_SHARE).alias("telling"))

    judged = staged(found.drop("others").join(rest, "row", "left").withColumn("length", length).select(
        "doc_id", "label", curve_of(F.col("near"), F.col("all"), F.col("share")).alias("now"),
        curve_of(F.col("without.near"), F.col("without.all"), F.col("without.share")).alias("without"),
        F.transform("three", lambda x: F.struct(x["doc_id"].alias("doc_id"), (x["cosine"] / F.col("length")).alias("cosine"))).alias("evidence")))
    # At most ``most`` ids; a repeated id counts once.
    known = (judged.where("label is not null").groupBy("doc_id", "label").agg(F.min("without").alias("without"))
             .select("doc_id", "label", "without.*").toArrow().sort_by("doc_id"))
    every, y = known["all"].to_numpy(), known["label"].to_numpy().astype(float)
    bare = every <= 0
    empty = float((y[bare].sum() + rate) / (bare.sum() + 1))
    by_votes, by_share, shift = fit_curve(np.column_stack([known["odds"].to_numpy(), known["telling"].to_numpy()])[~bare], y[~bare]).tolist()
    score = 1 / (1 + F.exp(-(F.col("now.odds") * by_votes + F.col("now.telling") * by_share + shift)))
    both = 0 < y.sum() < len(y)
    return judged.select("doc_id", (F.when(F.col("now.all") > 0, score).otherwise(F.lit(empty)) if both else F.lit(rate)).alias("score"), "evidence")


def op2_toxicity(spark, sf_dir: str) -> DataFrame:
    scored = score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", (F.crc32(F.col("doc_id").cast("string")) % 5 == 0).alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence")
