"""Byte-level BPE ids of whole texts, and token counts of the parts of a text.

The ids are those of the ``tokenizers`` library for the vocabulary file. The same vocabulary as ranks gives the same
ids several times faster, so that library is asked only for texts in which it would find a special token.

Attribution encodes a document once. The bytes of each token give its character span; spans and sections are both
sorted, so the interval join is two binary searches per section. A token that crosses a boundary is allocated by
``rule``: ``most`` (the section with most of its characters, the earlier one of equals), ``start`` (the section
of its first character) or ``split`` (each section by its share of the characters).

Defined cases: a null text is empty and has one empty section; the sections of a text are its lines with their
line feeds, a line over ``longest`` characters is cut into passages of that many, so sections cover the text and the
counts add up to the tokens of the document; characters outside all given
sections are counted in a last row with a null section number.
"""

from __future__ import annotations

import base64
import functools
import re

import numpy as np
from pyspark.sql import DataFrame, functions as F

from tendersift.llm.common import in_batches, prepare, single_threaded, table


@functools.cache
def _encoder(ranks_path: str):
    import public_tokenizers
    import tiktoken

    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    length = np.zeros(max(ranks.values()) + 1, np.int64)
    for piece, i in ranks.items():
        length[i] = len(piece)
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}), length


@functools.cache
def _tokenizer(json_path: str):
    single_threaded()
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(json_path)
    return tok, [t.content for t in tok.get_added_tokens_decoder().values()]


def vocabulary() -> tuple[str, str]:
    """Default files: the vocabulary of the ``tokenizers`` library and the same one as ranks."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


def encode(text: str, files: tuple[str, str]) -> list[int]:
    tok, special = _tokenizer(files[0])
    if any(s in text for s in special):
        return tok.encode(text, add_special_tokens=False).ids
    return _encoder(files[1])[0].encode_ordinary(text)


def spans(text: str, files: tuple[str, str]) -> tuple[np.ndarray, np.ndarray]:
    """First and one-past-last character of every token of the text as it stands."""
    encoding, length = _encoder(files[1])
    _, special = _tokenizer(files[0])
    if any(s in text for s in special):
        # A special token is one token; what stands between two of them is encoded by itself.
        parts, at = [], 0
        for piece in re.split(f"({'|'.join(re.escape(s) for s in sorted(special, key=len, reverse=True))})", text):
            if piece in special:
                parts.append((np.array([at]), np.array([at + len(piece)])))
            elif piece:
                parts.append(tuple(x + at for x in spans(piece, files)))
            at += len(piece)
        return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    ids = np.array(encoding.encode_ordinary(text), np.int64)
    data = np.frombuffer(text.encode("utf-8"), np.uint8)
    char = np.cumsum((data & 0xC0) != 0x80) - 1
    ends = np.cumsum(length[ids])
    return char[ends - length[ids]], char[ends - 1] + 1


def lines(text: str, longest: int | None = None) -> list[tuple[int, int]]:
    """Spans of the lines, each with its line feed, cut every ``longest`` characters; one empty span for an empty text."""
    cuts, at = [0], 0
    while at < len(text):
        end = text.find("\n", at) + 1 or len(text)
        if longest:
            cuts += range(at + longest, end, longest)
        cuts.append(end)
        at = end
    if len(cuts) == 1:
        cuts.append(0)
    return list(zip(cuts, cuts[1:]))


def allocate(start: np.ndarray, stop: np.ndarray, sections: list[tuple[int, int]], rule: str = "most") -> tuple[np.ndarray, np.ndarray]:
    """Tokens of each section, and how many of those it touches cross its borders. Sections are sorted and disjoint."""
    lo = np.array([s for s, _ in sections], np.int64)
    hi = np.array([e for _, e in sections], np.int64)
    first = np.searchsorted(stop, lo, "right")  # the first token that ends after the section begins
    last = np.searchsorted(start, hi, "left")  # the first token that begins at its end or later
    last = np.maximum(first, np.where(hi > lo, last, first))
    # Only a section's first and last token can cross a border, because spans and sections are sorted.
    edge = np.stack([first, last - 1], axis=1)
    edge[:, 1] = np.where(last - first > 1, last - 1, -1)
    edge[last == first] = -1
    at = np.repeat(np.arange(len(sections)), 2)[(edge >= 0).ravel()]
    token = edge[edge >= 0]
    over = np.minimum(stop[token], hi[at]) - np.maximum(start[token], lo[at])
    whole = stop[token] - start[token]
    cross = over < whole
    at, token, over, whole = at[cross], token[cross], over[cross], whole[cross]
    counts = (last - first).astype(np.float64)
    crossing = np.bincount(at, minlength=len(sections))
    counts -= crossing
    if rule == "split":
        np.add.at(counts, at, over / whole)
    elif rule == "start":
        np.add.at(counts, at, (start[token] >= lo[at]) & (start[token] < hi[at]))
    elif rule == "most":
        # A long token may touch many short sections, so the winner is found over all that it touches.
        many = _touched(start, stop, lo, hi, np.unique(token))
        np.add.at(counts, many, 1.0)
    else:
        raise ValueError(f"unknown rule {rule}")
    return counts, crossing


def _touched(start: np.ndarray, stop: np.ndarray, lo: np.ndarray, hi: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    """For each token the section with most of its characters, the earlier one of equals."""
    out = []
    a, b = np.searchsorted(hi, start[tokens], "right"), np.searchsorted(lo, stop[tokens], "left")
    for t, i, j in zip(tokens, a, b):
        over = np.minimum(stop[t], hi[i:j]) - np.maximum(start[t], lo[i:j])
        out.append(i + int(np.argmax(over)))
    return np.array(out, np.int64)


def from_fields(docs: DataFrame, fields: list[str], separator: str = "\n") -> DataFrame:
    """One text of several columns and the spans of the columns, for ``attribute(..., sections="sections")``."""
    out, at = docs.withColumn("text", F.concat_ws(separator, *[F.coalesce(F.col(f).cast("string"), F.lit("")) for f in fields])), F.lit(0)
    made = []
    for f in fields:
        size = F.length(F.coalesce(F.col(f).cast("string"), F.lit("")))
        made.append(F.struct(at.cast("long").alias("start"), (at + size).cast("long").alias("stop")))
        at = at + size + len(separator)
    return out.withColumn("sections", F.array(*made)) if "text" not in fields else \
        docs.withColumn("sections", F.array(*made)).withColumn("text", F.concat_ws(
            separator, *[F.coalesce(F.col(f).cast("string"), F.lit("")) for f in fields]))


def attribute(docs: DataFrame, sections: str | None = None, rule: str = "most", key: str = "doc_id", text: str = "text",
              files: tuple[str, str] | None = None, longest: int | None = 500) -> DataFrame:
    """One row per section: its number, span, tokens under ``rule``, and crossing tokens that touch it.

    ``sections`` names an array of (start, stop) structs, sorted and disjoint; without it lines are used.
    """
    files = files or vocabulary()
    prepare(docs.sparkSession)

    def count(r: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {c: [] for c in ("key", "section", "start", "stop", "n_tokens", "n_crossing", "doc_tokens")}
        for k, t, given in zip(r["key"], r["text"], r.get("sections") or [None] * len(r["key"])):
            t = t or ""
            parts = lines(t, longest) if given is None else [(s["start"], s["stop"]) for s in given]
            a, b = spans(t, files) if t else (np.zeros(0, np.int64), np.zeros(0, np.int64))
            got, crossing = allocate(a, b, parts, rule)
            n = len(parts)
            out["key"] += [k] * n
            out["section"] += range(n)
            out["start"] += [s for s, _ in parts]
            out["stop"] += [e for _, e in parts]
            out["n_tokens"] += got.tolist()
            out["n_crossing"] += crossing.tolist()
            out["doc_tokens"] += [len(a)] * n
            left = len(a) - float(got.sum())
            if given is not None and left > 1e-9:
                for c, v in (("key", k), ("section", None), ("start", None), ("stop", None), ("n_tokens", left), ("n_crossing", 0), ("doc_tokens", len(a))):
                    out[c].append(v)
        return out

    columns = [F.col(key).alias("key"), F.col(text).alias("text")] + ([F.col(sections).alias("sections")] if sections else [])
    kind = dict(docs.dtypes)[key]
    return in_batches(docs.select(*columns), count, f"key {kind}, section int, start bigint, stop bigint, n_tokens double, "
                      "n_crossing bigint, doc_tokens bigint").withColumnRenamed("key", key)


def op5_token_counts(spark, sf_dir: str) -> DataFrame:
    return attribute(table(spark, sf_dir, "documents")).withColumn("n_tokens", F.col("n_tokens").cast("long"))
