"""Conversation prefix trie: ROLLUP over positional turn columns.

A turn gets a name of 120 bits from the SHA-256 of its role and text. Every conversation becomes rows of ``WIDTH``
positional columns of turn names, one row per block of as many turns. ``GROUP BY block, key, ROLLUP(t1, ..., t8)``
aggregates all prefixes of all conversations together; grouping() tells at which position a group ends. A block is keyed
by the node that the prior block ended in, so conversations of any length go through the same one statement. The name of a
node is the exclusive or of two 64-bit hashes of (turn, position) over its path, so the keys of all blocks come from
running aggregates instead of one job per block.

Sums over subtrees need no walk. The smallest member of a node owns it, and what a conversation owns is one piece of its
path down to its end. A leaf counts at its owner; the bytes a subtree saves are the bytes its members share with smaller
ones, less those before the node. Both are sums over members, so a second ROLLUP gives them for nodes of several members.

Hot keys: positions are taken per range of (conversation, turn), so one conversation may hold any share of the rows; its
running names are taken in chunks of ``CHUNK`` blocks. Nodes of many members are partially aggregated before the shuffle.
The ids that end in one node are listed in ranges, and only pieces of ``PIECE`` ids meet in the task that hashes them.

Defined cases: null role or text is empty; a null turn comes first; equal turns are ordered by their names (repeated rows
are repeated turns); rows without a conv_id are left out; texts are hashed whole, of any length; an empty table has no
nodes, not even a root. Only conv_id, turn, role and text are read, so other columns of any name do not matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tendersift.llm.common import arrow_schema, parts, prepare, staged, table

WIDTH, CHUNK, PIECE = 8, 1024, 1024


@dataclass
class Trie:
    """``nodes``: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and the name (n1, n2).

    ``ends``: conv_id and depth of a node and ``member``, a conversation of exactly that many turns.
    """

    nodes: DataFrame
    ends: DataFrame


def numbered(conversations: DataFrame) -> DataFrame:
    """Turns as (conv_id, pos from 0, name a and b, bytes), ordered by turn; written to the shared folder."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    sha = F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256)
    rows = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", sha.alias("sha"), F.octet_length(text).cast("long").alias("bytes"))
    name = [F.conv(F.substring("sha", at, 15), 16, 10).cast("long").alias(c) for at, c in ((1, "a"), (16, "b"))]
    # Equal rows are interchangeable, so a running number may deal them out.
    order = ["conv_id", "turn", "a", "b", "_n"]
    rows = rows.select("conv_id", "turn", *name, "bytes", F.monotonically_increasing_id().alias("_n"))
    ranged = staged(rows.repartitionByRange(parts(rows.sparkSession), *order).withColumn("_p", F.spark_partition_id()))
    sizes = ranged.groupBy("conv_id", "_p").agg(F.count("*").alias("m"))
    earlier = Window.partitionBy("conv_id").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("conv_id", "_p", F.coalesce(F.sum("m").over(earlier), F.lit(0)).alias("start"))
    own = F.row_number().over(Window.partitionBy("conv_id", "_p").orderBy(*order[1:])) - 1
    return staged(ranged.withColumn("own", own).join(starts, ["conv_id", "_p"])
                  .select("conv_id", (F.col("start") + F.col("own")).alias("pos"), "a", "b", "bytes"))


def _turn_hash(salt: int, a: str = "a", b: str = "b", pos: str = "pos") -> str:
    return f"xxhash64({salt}L, {a}, {b}, {pos})"


def blocks_of(turns: DataFrame, convs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Block rows with the name (z1, z2) and bytes (before) of the path above them, and a row per conversation.

    ``convs`` (conv_id) may hold conversations without turns: they end in the root.
    """
    at = turns.withColumn("block", F.floor(F.col("pos") / WIDTH)).withColumn("i", F.col("pos") % WIDTH + 1)
    hashes = [F.bit_xor(F.expr(_turn_hash(s))).alias(f"x{s}") for s in (1, 2)]
    picks = [F.expr(f"max({c}) FILTER (WHERE i = {i}) AS {p}{i}") for i in range(1, WIDTH + 1) for c, p in (("a", "a"), ("b", "b"), ("bytes", "l"))]
    flat = staged(at.groupBy("conv_id", "block").agg(*picks, *hashes, F.sum("bytes").alias("s"), F.count("*").alias("k"))
                  .withColumn("chunk", F.floor(F.col("block") / CHUNK)))
    totals = {"z1": F.bit_xor("x1"), "z2": F.bit_xor("x2"), "before": F.sum("s")}
    sums = {"z1": F.bit_xor("z1"), "z2": F.bit_xor("z2"), "before": F.sum("before")}
    over = Window.partitionBy("conv_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    chunks = (flat.groupBy("conv_id", "chunk").agg(*[e.alias(c) for c, e in totals.items()])
              .select("conv_id", "chunk", *[e.over(over).alias(f"c_{c}") for c, e in sums.items()]).where("chunk > 0"))
    inner = Window.partitionBy("conv_id", "chunk").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    within = {c: F.coalesce(e.over(inner), F.lit(0)) for c, e in totals.items()}
    joined = flat.select("*", *[e.alias(c) for c, e in within.items()]).join(chunks, ["conv_id", "chunk"], "left")
    zero = F.lit(0)
    keys = [F.col(c).bitwiseXOR(F.coalesce(f"c_{c}", zero)).alias(c) for c in ("z1", "z2")]
    columns = [f"{p}{i}" for i in range(1, WIDTH + 1) for p in "abl"]
    rows = joined.select("conv_id", "block", *keys, (F.col("before") + F.coalesce("c_before", zero)).alias("before"), *columns)
    ends = (convs.join(flat.groupBy("conv_id").agg(F.bit_xor("x1").alias("e1"), F.bit_xor("x2").alias("e2"),
                                                   F.sum("s").alias("total"), F.sum("k").alias("len")), "conv_id", "left")
            .fillna(0, ["e1", "e2", "total", "len"]))
    ends = staged(ends)
    empty = ends.where("len = 0").select("conv_id", *[F.lit(0).cast("long").alias(c) for c in ("block", "z1", "z2", "before")],
                                         *[F.lit(None).cast("long").alias(c) for c in columns])
    return staged(rows.unionByName(empty)), ends


def _rollup(blocks: DataFrame, values: str) -> DataFrame:
    """``values`` for every prefix: name (n1, n2), parent's name (p1, p2), depth, bytes before its last turn."""
    groups = ", ".join(f"(a{i}, b{i}, l{i})" for i in range(1, WIDTH + 1))
    level = " + ".join(f"(1 - grouping(a{i}))" for i in range(1, WIDTH + 1))
    columns = ", ".join(f"{p}{i}" for i in range(1, WIDTH + 1) for p in "abl")
    found = blocks.sparkSession.sql(
        f"SELECT block, z1, z2, before, {columns}, {level} AS level, {values} "
        f"FROM {{blocks}} GROUP BY block, z1, z2, before, ROLLUP({groups})", blocks=blocks)
    turns = " + ".join(f"int(a{i} IS NOT NULL)" for i in range(1, WIDTH + 1))
    # A shorter conversation has no turn where the group ends; a later block's own key is the prior block's node.
    found = found.where(f"{turns} = level AND (level > 0 OR block = 0)")

    def name(salt: int, shorter: int) -> str:
        # Columns past the end of the group are null and change nothing.
        turn = [f"if(level >= {i + shorter}, {_turn_hash(salt, f'a{i}', f'b{i}', f'block * {WIDTH} + {i - 1}')}, 0L)" for i in range(1, WIDTH + 1)]
        return f"{' ^ '.join([f'z{salt}', *turn])} AS {'np'[shorter]}{salt}"

    names = [name(salt, shorter) for shorter in (0, 1) for salt in (1, 2)]
    sizes = " + ".join(f"if(level > {i}, l{i}, 0L)" for i in range(1, WIDTH + 1))
    given = ["block", "z1", "z2", "level", "before", *columns.split(", ")]
    rest = [c for c in found.columns if c not in given]
    return found.selectExpr(*names, f"block * {WIDTH} + level AS depth", f"before + {sizes} AS above", *rest)


def trie(turns: DataFrame, convs: DataFrame) -> Trie:
    """The trie of ``turns`` (conv_id, pos without gaps, a, b, bytes) of the conversations ``convs`` (conv_id)."""
    blocks, ends = blocks_of(turns, convs)
    nodes = staged(_rollup(blocks, "count(*) AS n_convs, min(conv_id) AS conv_id"))
    # What a conversation owns begins at one node; the parent of that node has another owner.
    tops = nodes.groupBy("conv_id").agg(F.min("depth").alias("top"), *[F.min_by(c, "depth").alias(c) for c in ("p1", "p2", "above")])
    parents = nodes.select(F.col("n1").alias("p1"), F.col("n2").alias("p2"), (F.col("depth") + 1).alias("top"),
                           F.col("conv_id").alias("parent"))
    owners = staged(tops.join(parents, ["p1", "p2", "top"], "left").select("conv_id", "top", F.col("above").alias("shared"),
                                                                          F.when(F.col("top") > 0, F.col("parent")).alias("parent")))
    hung = staged(owners.where("top > 0").groupBy(F.col("parent").alias("conv_id"), (F.col("top") - 1).alias("depth"))
                  .agg(F.count("*").alias("hung")))
    members = staged(
        ends.join(owners, "conv_id", "left")
        .join(hung.select("conv_id", F.col("depth").alias("len"), "hung"), ["conv_id", "len"], "left")
        .select("conv_id", "len", "e1", "e2", "top", "parent", F.coalesce("shared", "total").alias("shared"),
                (F.col("top").isNotNull() & F.col("hung").isNull()).cast("long").alias("leaf")))
    several = nodes.where((F.col("n_convs") > 1) & (F.col("depth") % WIDTH == 0)).select(
        F.col("n1").alias("z1"), F.col("n2").alias("z2"), F.floor(F.col("depth") / WIDTH).alias("block"))
    weighed = blocks.join(several, ["z1", "z2", "block"], "left_semi").join(members.select("conv_id", "shared", "leaf"), "conv_id")
    sums = _rollup(weighed, "sum(leaf) AS leaves, sum(shared) AS all_shared").select("n1", "n2", "depth", "leaves", "all_shared")
    named = (nodes.select("n1", "n2", "conv_id", "depth", "n_convs", "above")
             .join(members.select("conv_id", "len", "top", "parent", "shared"), "conv_id")
             .join(hung, ["conv_id", "depth"], "left").join(sums, ["n1", "n2", "depth"], "left"))
    one = F.col("n_convs") == 1
    saved = F.col("all_shared") - F.col("shared") - (F.col("n_convs") - 1) * F.col("above")
    found = staged(named.select(
        "conv_id", "depth",
        F.when(F.col("depth") > F.col("top"), F.col("conv_id")).otherwise(F.col("parent")).alias("parent_conv_id"), "n_convs",
        (F.coalesce("hung", F.lit(0)) + (F.col("len") > F.col("depth")).cast("long")).alias("n_children"),
        F.when(one, F.lit(1)).otherwise(F.col("leaves")).cast("long").alias("n_leaves"),
        F.when(one, F.lit(0)).otherwise(saved).cast("long").alias("saved_tokens"), "n1", "n2"))
    last = members.select(F.col("conv_id").alias("member"), F.col("len").alias("depth"), F.col("e1").alias("n1"), F.col("e2").alias("n2"))
    return Trie(found, staged(found.select("conv_id", "depth", "n1", "n2").join(last, ["n1", "n2", "depth"])
                              .select("conv_id", "depth", "member")))


def prefix_trie(conversations: DataFrame) -> Trie:
    """The trie of a table of conversations (conv_id, turn, role, text)."""
    prepare(conversations.sparkSession)
    turns = numbered(conversations)
    return trie(turns, turns.select("conv_id").distinct())


def end_digests(ends: DataFrame) -> DataFrame:
    """(conv_id, depth, ends_sha256): hash of the ascending members that end in a node, joined by commas.

    Ids are ordered and joined to pieces range by range; one task then reads the pieces of a node in order and keeps
    nothing but the state of the hash.
    """
    first = arrow_schema("conv_id bigint, depth bigint, first bigint, ids string")
    last = arrow_schema("conv_id bigint, depth bigint, ends_sha256 string")

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids = None, []

        def piece() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([v], t.type) for v, t in zip((*key, ids[0], ",".join(map(str, ids))), first)], schema=first)

        done: list[pa.RecordBatch] = []
        for batch in batches:
            for conv_id, depth, member in zip(*(c.to_pylist() for c in batch.columns)):
                if ids and (key != (conv_id, depth) or len(ids) == PIECE):
                    done.append(piece())
                    ids = []
                key = (conv_id, depth)
                ids.append(member)
            if done:
                yield from pa.Table.from_batches(done).combine_chunks().to_batches()
                done = []
        if ids:
            yield piece()

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, hashlib.sha256()

        def rows(done: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], t.type) for i, t in enumerate(last)], schema=last)

        for batch in batches:
            done = []
            for conv_id, depth, ids in zip(*(c.to_pylist() for c in batch.columns)):
                if key == (conv_id, depth):
                    state.update(b",")
                else:
                    if key is not None:
                        done.append((*key, state.hexdigest()))
                    key, state = (conv_id, depth), hashlib.sha256()
                state.update(ids.encode())
            yield rows(done)
        if key is not None:
            yield rows([(*key, state.hexdigest())])

    spark = ends.sparkSession
    order = ["conv_id", "depth", "member"]
    pieces = ends.select(*order).repartitionByRange(parts(spark), *order).sortWithinPartitions(*order)
    pieces = pieces.mapInArrow(join, "conv_id bigint, depth bigint, first bigint, ids string")
    placed = pieces.repartition(parts(spark), "conv_id", "depth").sortWithinPartitions("conv_id", "depth", "first")
    return placed.select("conv_id", "depth", "ids").mapInArrow(digest, "conv_id bigint, depth bigint, ends_sha256 string")


def branched(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations that begin with the first h turns of conversation c - c % 5 and go on with their own after h.

    h is crc32(decimal c) % 9. Returns the turns and all conversations; no more than 8 turns of one are read by others.
    """
    sizes = turns.groupBy("conv_id").agg(F.count("*").alias("len"))
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % 9
    plan = sizes.select("conv_id", (F.col("conv_id") - F.col("conv_id") % 5).alias("base"), h.alias("h"))
    plan = staged(plan.join(sizes.select(F.col("conv_id").alias("base"), F.col("len").alias("base_len")), "base", "left")
                  .withColumn("taken", F.least("h", F.coalesce("base_len", F.lit(0)))))
    head = turns.where("pos < 8").withColumnRenamed("conv_id", "base").join(plan.select("conv_id", "base", "taken"), "base")
    own = turns.join(plan.select("conv_id", "h", "taken"), "conv_id").where("pos >= h")
    rest = ["a", "b", "bytes"]
    both = head.where("pos < taken").select("conv_id", "pos", *rest).unionByName(
        own.select("conv_id", (F.col("pos") - F.col("h") + F.col("taken")).alias("pos"), *rest))
    return both, plan.select("conv_id")


def op13_prefix_trie(spark, sf_dir: str) -> DataFrame:
    prepare(spark)
    made = trie(*branched(numbered(table(spark, sf_dir, "conversations"))))
    none = F.lit(hashlib.sha256(b"").hexdigest())
    return (made.nodes.drop("n1", "n2").join(end_digests(made.ends), ["conv_id", "depth"], "left")
            .withColumn("ends_sha256", F.coalesce("ends_sha256", none)))


#: crc32 bit by bit over the digits of the id; a path is the list of its turns, and all members are compared.
OP13_SQL = """
WITH turns AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) - 1 AS pos,
         coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL),
ids AS (SELECT conv_id, count(*) AS len FROM turns GROUP BY 1),
plan AS (
  SELECT conv_id, conv_id - conv_id % 5 AS base,
    xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ord(c)::BIGINT)),
      lambda crc, d: list_reduce(list_prepend(xor(crc, d), range(8)),
        lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::BIGINT) ELSE x >> 1 END)), 4294967295::BIGINT) % 9 AS h
  FROM ids),
cut AS (
  SELECT p.conv_id, p.base, p.h, least(p.h, coalesce(i.len, 0)) AS taken FROM plan p LEFT JOIN ids i ON i.conv_id = p.base),
made AS (
  SELECT c.conv_id, t.pos + 1 AS d, t.role, t.text FROM cut c JOIN turns t ON t.conv_id = c.base AND t.pos < c.taken
  UNION ALL
  SELECT c.conv_id, t.pos - c.h + c.taken + 1, t.role, t.text FROM cut c JOIN turns t ON t.conv_id = c.conv_id AND t.pos >= c.h),
paths AS (
  SELECT conv_id, 0 AS d, '' AS path, 0 AS bytes FROM cut
  UNION ALL
  SELECT conv_id, d, sha256(string_agg(length(role) || ':' || role || length(text) || ':' || text, '')
           OVER (PARTITION BY conv_id ORDER BY d)), strlen(text) FROM made),
nodes AS (
  SELECT d, path, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(bytes) AS bytes FROM paths GROUP BY 1, 2),
ends AS (
  SELECT d, path, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) AS ids
  FROM (SELECT conv_id, max(d) AS d FROM paths GROUP BY 1) JOIN paths USING (conv_id, d) GROUP BY 1, 2),
links AS (
  SELECT n.d, n.path, p.conv_id AS parent_conv_id, p.path AS parent_path
  FROM nodes n JOIN paths x ON x.conv_id = n.conv_id AND x.d = n.d - 1 JOIN nodes p ON p.d = x.d AND p.path = x.path),
kids AS (SELECT d - 1 AS d, parent_path AS path, count(*) AS n_children FROM links GROUP BY 1, 2),
below AS (
  SELECT p.d, p.path, sum(CASE WHEN k.n_children IS NULL THEN 1 ELSE 0 END) AS n_leaves, sum((u.n_convs - 1) * u.bytes) AS saved_tokens
  FROM paths p JOIN nodes u ON u.conv_id = p.conv_id AND u.d >= p.d LEFT JOIN kids k ON k.d = u.d AND k.path = u.path
  GROUP BY 1, 2)
SELECT n.conv_id, n.d::BIGINT AS depth, l.parent_conv_id, n.n_convs, coalesce(k.n_children, 0)::BIGINT AS n_children,
  b.n_leaves::BIGINT AS n_leaves, b.saved_tokens::BIGINT AS saved_tokens, sha256(coalesce(e.ids, '')) AS ends_sha256
FROM nodes n LEFT JOIN links l USING (d, path) LEFT JOIN kids k USING (d, path) LEFT JOIN ends e USING (d, path)
JOIN below b USING (d, path)
"""
