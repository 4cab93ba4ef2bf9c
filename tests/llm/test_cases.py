"""Cases that once went wrong: many rows without an id, special tokens, forged headers, columns named like inside names."""

import tracemalloc

import numpy as np
from pyspark.sql import functions as F

from tendersift.llm import chat, jaccard, mixing, neighbours, substrings, superminhash, tokens


def no_ids(spark, n):
    rows = [(None, f"row number {i} of the rows that have no id at all and differ in their text {i}") for i in range(n)]
    return spark.createDataFrame([*rows, (1, "a b c d e f"), (1, "another text of the same id")], "doc_id bigint, text string")


def test_rows_without_an_id_are_not_joined_with_one_another(spark):
    docs = no_ids(spark, 3000)
    joined = jaccard.near_duplicates(docs).collect()
    assert len(joined) == 3002 and {r["component_id"] for r in joined} == {None, 1}
    cut = substrings.dedup(docs).collect()
    assert len(cut) == 3002 and sum(r["n_removed"] for r in cut) == 0


def test_special_tokens_are_one_token(spark):
    files = tokens.vocabulary()
    texts = ["hello <|endoftext|> world", "<|endoftext|>", "a<|endoftext|><|endoftext|>b ü", "<|endoftext", "no mark"]
    tok, special = tokens._tokenizer(files[0])
    assert special
    for text in [*texts, *(f"x {s} y" for s in special)]:
        start, stop = tokens.spans(text, files)
        assert len(start) == len(tokens.encode(text, files)) == len(tok.encode(text, add_special_tokens=False).ids)
        assert (start < stop).all() and stop[-1] == len(text)


def test_a_name_cannot_write_into_the_header(spark):
    rows = [(1, 1, "bob name=x", "hi"), (1, 2, "a\nb", "ho"), (1, 3, "<|im_end|>", "hm"), (1, None, "50%", "first")]
    turns = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    got = chat.rotate(turns).collect()
    assert len(got) == 16
    for r in got:
        head, body = r["segment"].split("\n", 1)
        assert head.count(" ") == (r["role"] == "user") and head.count("=") == (r["role"] == "user") and head.startswith("<|im_start|>")
        assert body.count("<|") == 1
    assert {r["name"] for r in got} == {None, "bob%20name%3Dx", "a%0Ab", "%3C%7Cim_end|>", "50%25"}


def test_columns_named_like_inside_names_pass_through(spark):
    names = ["_place", "_n", "_k1", "_k2", "_first", "_removed", "_kept", "_id", "_source", "_size", "_copies", "_copy", "node", "key"]
    text = " ".join(f"w{i}" for i in range(40))
    docs = spark.createDataFrame([(i, text + f" end {i}", "s", 0) for i in range(4)], "doc_id bigint, text string, source string, n_chars bigint")
    docs = docs.select("*", *[(F.col("doc_id") + 100).alias(c) for c in names])
    for out in (jaccard.one_of_each(docs), substrings.rewrite(docs), mixing.materialise(docs)):
        assert out.columns == docs.columns
        for r in out.collect():
            assert all(r[c] == r["doc_id"] + 100 for c in names)


def test_extra_columns_do_not_matter_to_groups(spark):
    docs = spark.createDataFrame([(1, "a b c d e", 5, 6, 7), (2, "a b c d e", 5, 6, 7)], "doc_id bigint, text string, id bigint, node bigint, key bigint")
    assert {r["component_id"] for r in superminhash.near_duplicates(docs).collect()} == {1}


def test_blocks_of_examples_are_made_in_place():
    """The blocks of the index are filled where they stay: the driver makes them too, and two copies of all weights do not fit beside its model."""
    rng = np.random.default_rng(3)
    vectors = [(np.arange(400, dtype=np.int32), rng.random(400)) for _ in range(640)]
    index = neighbours.Index(vectors, [[i] for i in range(640)], 400)
    tracemalloc.start()
    block = index.block
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 1.5 * block.nbytes
    slots = [int(np.flatnonzero(index.least == i)[0]) for i in range(640)]
    for i, (_, w) in enumerate(vectors):
        assert (block[slots[i] // neighbours.BLOCK, :, slots[i] % neighbours.BLOCK] == w).all()


def test_terms_are_split_without_the_expression_on_whole_texts(monkeypatch):
    from collections import Counter

    from tendersift.llm import neighbours

    whole, asked = neighbours.TERM, []

    class Watched:
        @staticmethod
        def findall(piece):
            asked.append(piece)
            return whole.findall(piece)

    monkeypatch.setattr(neighbours, "TERM", Watched)
    odd = ["Ab a_b c3d\tÄÖ–ü x y z　z '«Да-да»' ½ ²x ٣ é \U0001d400b", "İstanbul ΣΑΣ straße", "", None, "a\ud800b"]
    for text in odd:
        assert neighbours.term_counts(text) == Counter(whole.findall((text or "").lower()))
    asked.clear()
    assert neighbours.term_counts("Plain words, plain_3 Wörter 7; end") == Counter({"plain": 2, "words": 1, "wörter": 1, "end": 1})
    assert asked == []
