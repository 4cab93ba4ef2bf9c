"""Hard negatives, SuperMinHash groups and the prefix trie against brute force."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_llm import SCHEMA, documents

from tendersift.llm import multiindex, superminhash, trie

# --- 11 hard negatives


def vectors(seed=3, n=700, dims=6):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(5, dims))
    rows = []
    for i in range(n):
        x = centres[i % 5] + rng.normal(size=dims) * (0.05 if i % 3 else 0.6)
        rows.append([i, [float(v) for v in x.astype(np.float32)], int(rng.integers(0, 4))])
    for i in range(20, 60):
        rows[i][1] = rows[10][1]  # one vector many times: ties everywhere
    rows[100][2], rows[101][1], rows[102][1] = None, None, [None] + [0.5] * (dims - 1)
    rows[103][1], rows[104][1] = [float("nan")] * dims, [float("inf")] + [0.1] * (dims - 1)
    rows[105][1], rows[106][1], rows[107][1] = [0.1] * (dims + 1), [], [1e30] * dims
    rows.append([None, rows[3][1], 1])
    rows.append([200, rows[200][1], rows[200][2]])  # a row twice
    rows.append([300, [0.3] * dims, 3])  # an id twice
    return [(*r, i, 0, "x") for i, r in enumerate(rows)]


VECTORS = "vec_id bigint, embedding array<float>, label int, cell int, score bigint, v string"


def slow_negatives(rows, dims, positives=5, negatives=10, low=30, high=90, step=100):
    kept = {}
    for i, x, label, *_ in rows:
        if i is None or x is None or label is None or len(x) != dims or any(v is None or not np.isfinite(v) or abs(v) > 1e9 for v in x):
            continue
        v = tuple(int(np.floor(256 * float(np.float32(c)))) for c in x)
        kept[i] = min(kept.get(i, (label, v)), (label, v))
    out = set()
    for a, (la, va) in kept.items():
        if a % step:
            continue
        scored = sorted((-sum(p * q for p, q in zip(va, vb)), b, lb) for b, (lb, vb) in kept.items() if b != a)
        for s, p, _ in [x for x in scored if x[2] == la][:positives]:
            fit = [(b, -t) for t, b, lb in scored if lb != la and low * -s <= 100 * -t <= high * -s][:negatives]
            out |= {(a, p, r + 1, b, -s, t) for r, (b, t) in enumerate(fit)}
    return out


@pytest.mark.parametrize("block_bytes, first", [(1 << 21, 4096), (6 * 8 * 7, 40)])
def test_hard_negatives_equal_brute_force(spark, block_bytes, first):
    rows = vectors()
    df = spark.createDataFrame(rows, VECTORS).repartition(3)
    got = multiindex.hard_negatives(df, anchor=F.col("vec_id") % 20 == 0, block_bytes=block_bytes, first=first)
    assert {tuple(r) for r in got.collect()} == slow_negatives(rows, 6, step=20)


def test_hard_negatives_of_nothing(spark):
    empty = spark.createDataFrame([], VECTORS)
    assert multiindex.hard_negatives(empty).count() == 0
    no_anchor = spark.createDataFrame(vectors()[1:40], VECTORS)
    assert multiindex.hard_negatives(no_anchor, anchor=F.lit(False)).count() == 0
    one = spark.createDataFrame([(0, [0.5], 1, 0, 0, "")], VECTORS)
    assert multiindex.hard_negatives(one).count() == 0


def test_heap_pops_sums_in_order_and_once():
    rng = np.random.default_rng(1)
    u, w = rng.normal(size=9), rng.normal(size=13)
    got = list(multiindex.visit_order(u, w))
    assert [round(b, 9) for b, _, _ in got] == sorted((round(float(x + y), 9) for x in u for y in w), reverse=True)
    assert len({(i, j) for _, i, j in got}) == 9 * 13


def test_bounds_hold_and_leave_cells_out(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(12, 8)) * 400
    x = np.floor(np.concatenate([c + rng.normal(size=(300, 8)) for c in centres])).astype(int)
    df = spark.createDataFrame([(i, 0, [int(v) for v in r]) for i, r in enumerate(x)], "vec_id bigint, label bigint, v array<bigint>")
    index = multiindex.build(df, 8)
    cell = {r["vec_id"]: r["cell"] for r in index.rows.select("vec_id", "cell").collect()}
    ids = index.codes[0] * len(index.halves[1]) + index.codes[1]
    queries = x[::97]
    scores = queries @ x.T
    floors = np.sort(scores, axis=1)[:, -50]
    seen = 0
    for q, found in enumerate(multiindex.cells_to_visit(index, queries, floors, np.full(len(queries), multiindex.EVER), None)):
        visited = set(ids[found].tolist())
        assert all(cell[i] in visited for i in np.flatnonzero(scores[q] >= floors[q]).tolist())
        seen += len(found)
    assert seen < len(queries) * len(ids) / 3


# --- 12 SuperMinHash


def slow_signature(shingles, slots):
    mask = (1 << 64) - 1

    def scramble(x):
        for _ in range(2):
            x = ((x ^ (x >> 32)) * 0xD6E8FEB86659FD93) & mask
        return x ^ (x >> 32)

    out = [mask] * slots
    for s in shingles:
        walk = list(range(slots))
        for j in range(slots):
            draw = scramble((s + (j + 1) * 0x9E3779B97F4A7C15) & mask)
            k = j + ((draw >> 32) * (slots - j) >> 32)
            walk[j], walk[k] = walk[k], walk[j]
            out[walk[j]] = min(out[walk[j]], (j << 32) | (draw & 0xFFFFFFFF))
    return out


def test_signatures_equal_the_unstopped_ones():
    rng = np.random.default_rng(2)
    sizes = [1, 2, 5, 30, 400]
    sets = [np.unique(rng.integers(0, 1 << 62, n, dtype=np.uint64)) for n in sizes]
    text = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    for piece in (1 << 16, 7):
        got = superminhash.signatures(text, np.concatenate(sets), len(sets), 32, piece)
        assert [g.tolist() for g in got] == [slow_signature([int(x) for x in s], 32) for s in sets]


def test_chances_of_bands_and_marks():
    assert superminhash.rows_of(85) == 4 and superminhash.rows_of(80) == 3 and superminhash.rows_of(100) >= 100
    assert 64 < superminhash.least_matches(85) < 0.85 * 128


def shingles(text, size):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in words.replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ") if w]
    if not words:
        return frozenset()
    return frozenset([tuple(words)] if len(words) < size else [tuple(words[i : i + size]) for i in range(len(words) - size + 1)])


def slow_groups(rows, size, percent):
    sets = [(d, shingles(t, size)) for d, t in rows]
    parent = {d: d for d, _ in sets if d is not None}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[i + 1:]:
            if a is not None and b is not None and x and y and 100 * len(x & y) >= percent * len(x | y):
                parent[max(root(a), root(b))] = min(root(a), root(b))
    return Counter((d, len(s), root(d) if d is not None else None, d is None or root(d) == d) for d, s in sets)


@pytest.mark.parametrize("size, percent", [(3, 85), (5, 80)])
def test_groups_equal_brute_force(spark, size, percent):
    rows = documents()
    got = superminhash.near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(4), size, percent)
    assert Counter(tuple(r) for r in got.collect()) == slow_groups([r[:2] for r in rows], size, percent)


def test_large_buckets_of_texts_that_are_only_similar(spark):
    """600 variants of one text: all meet in bands, most pairs are no links, none may be lost or made up."""
    rnd = random.Random(4)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(600):
        words = list(base)
        for _ in range(rnd.choice([1, 3, 4, 5, 6])):
            words[rnd.randrange(60)] = f"v{rnd.randrange(40)}"
        rows.append((i, " ".join(words), "", "", 0, 0, "", "", ""))
    got = superminhash.near_duplicates(spark.createDataFrame(rows, SCHEMA), 3, 85)
    want = slow_groups([r[:2] for r in rows], 3, 85)
    assert len({w[2] for w in want}) > 50
    assert Counter(tuple(r) for r in got.collect()) == want


@pytest.mark.parametrize("most, stars", [(1 << 17, 0), (40, 1)])
def test_few_links_are_grouped_by_one_forest(spark, monkeypatch, most, stars):
    """Links that fit a task need no contraction of stars; more of them are dealt and give the same groups."""
    rnd, called = random.Random(8), []
    monkeypatch.setattr(superminhash, "LINKS", most)
    monkeypatch.setattr(superminhash, "components", lambda edges, inner=superminhash.components: called.append(1) or inner(edges))
    edges = [(rnd.randrange(150), rnd.randrange(150)) for _ in range(100)]
    got = superminhash.grouped(spark.createDataFrame(edges, "src bigint, dst bigint").repartition(5)).collect()
    forest = superminhash.Forest()
    for e in edges:
        forest.join(*e)
    want = {x: forest.root(x) for x in {x for a, b in edges if a != b for x in (a, b)}}
    assert {r["node"]: r["component"] for r in got} == want and len(got) == len(want)
    assert len(called) == stars


def test_groups_without_ids_stay_small(spark):
    """Rows without an id must not be joined with one another."""
    rows = [(None, f"text number {i} of those without an id", "", "", 0, 0, "", "", "") for i in range(3000)] + [(1, "a b c", "", "", 0, 0, "", "", "")]
    got = superminhash.near_duplicates(spark.createDataFrame(rows, SCHEMA), 3, 85).collect()
    assert len(got) == 3001 and all(r["kept"] and r["component_id"] in (None, 1) for r in got)
    assert superminhash.near_duplicates(spark.createDataFrame([], SCHEMA), 3, 85).count() == 0


# --- 13 prefix trie


def slow_trie(paths):
    """Nodes of {conv_id: [(role, text), ...]}."""
    members = defaultdict(list)
    for c, turns in paths.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    out = {}
    for node, ids in members.items():
        below = [n for n in members if n[: len(node)] == node]
        kids = [n for n in below if len(n) == len(node) + 1]
        leaves = [n for n in below if not any(m[: len(n)] == n and len(m) > len(n) for m in below)]
        saved = sum((len(members[n]) - 1) * len(n[-1][1].encode()) for n in below if n)
        ends = ",".join(str(c) for c in sorted(c for c in ids if len(paths[c]) == len(node)))
        parent = min(members[node[:-1]]) if node else None
        out[(min(ids), len(node))] = (parent, len(ids), len(kids), len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest())
    return out


def talks(seed=7):
    rnd = random.Random(seed)
    rows, say = [], lambda: (rnd.choice(["user", "assistant", None]), rnd.choice(["", "ja", "né", None, "so", "x y"]))
    long = [say() for _ in range(45)]
    for c in [*range(-7, 40), 2**40, 1001, 1003]:
        n = rnd.choice([1, 2, 3, 7, 8, 9, 12, 25])
        turns = (long[: rnd.randrange(1, 46)] if c % 3 else []) + [say() for _ in range(n)]
        rows += [(c, t, *turn) for t, turn in enumerate(turns)]
    rows += [(50, t, *turn) for t, turn in enumerate(long)] + [(51, t, *turn) for t, turn in enumerate(long)]
    rows += [(60, None, "user", "first"), (60, -5, "a", "second"), (60, None, "user", "first"), (60, 3, "user", "third")]
    rows += [(None, 1, "user", "nobody")] * 3 + [(c, 0, "user", "only") for c in (2001, 2002, 2003, 2004)]
    rnd.shuffle(rows)
    return rows


TALKS = "conv_id bigint, turn bigint, role string, text string, block int, level int, z1 string"


def ordered(rows):
    paths = defaultdict(list)
    for c, _, role, text in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] is not None, r[1] or 0)):
        paths[c].append((role or "", text or ""))
    return dict(paths)


def found(made):
    digests = {(r["conv_id"], r["depth"]): r["ends_sha256"] for r in trie.end_digests(made.ends).collect()}
    none = hashlib.sha256(b"").hexdigest()
    return {(r["conv_id"], r["depth"]): (r["parent_conv_id"], r["n_convs"], r["n_children"], r["n_leaves"], r["saved_tokens"],
                                         digests.get((r["conv_id"], r["depth"]), none)) for r in made.nodes.collect()}


def test_trie_equals_brute_force(spark, monkeypatch):
    rows = talks()
    df = spark.createDataFrame([(*r, 1, 2, "z") for r in rows], TALKS).repartition(4)
    assert found(trie.prefix_trie(df)) == slow_trie(ordered(rows))
    monkeypatch.setattr(trie, "CHUNK", 2)  # running names in several chunks
    monkeypatch.setattr(trie, "PIECE", 2)
    assert found(trie.prefix_trie(df)) == slow_trie(ordered(rows))


def test_trie_of_rebuilt_conversations(spark, tmp_path):
    rows = talks(8)
    spark.createDataFrame([(*r, 1, 2, "z") for r in rows], TALKS).write.parquet(f"{tmp_path}/conversations.parquet")
    own, paths = ordered(rows), {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (c % 5 if c >= 0 else -(-c % 5))
        paths[c] = own.get(base, [])[:h] + turns[h:]
    assert not all(paths.values())  # some have no turn left
    got = {(r["conv_id"], r["depth"]): (r["parent_conv_id"], r["n_convs"], r["n_children"], r["n_leaves"], r["saved_tokens"], r["ends_sha256"])
           for r in trie.op13_prefix_trie(spark, str(tmp_path)).collect()}
    assert got == slow_trie(paths)


def test_trie_of_nothing(spark):
    assert trie.prefix_trie(spark.createDataFrame([], TALKS)).nodes.count() == 0
    assert trie.prefix_trie(spark.createDataFrame([(None, 1, "a", "b", 1, 2, "z")], TALKS)).nodes.count() == 0


def test_one_conversation_with_most_turns(spark):
    """A hot conversation: positions come from ranges, not from one ordered task."""
    rows = [(1, t, "user", f"t{t % 5}") for t in range(4000)] + [(2, t, "user", f"t{t % 5}") for t in range(2000)]
    made = trie.prefix_trie(spark.createDataFrame([(*r, 1, 2, "z") for r in rows], TALKS))
    deepest = made.nodes.where("n_children = 0").collect()
    assert [(r["conv_id"], r["depth"], r["n_convs"]) for r in deepest] == [(1, 4000, 1)]
    assert made.nodes.count() == 4001 and made.nodes.where("depth = 2000").first()["n_convs"] == 2
