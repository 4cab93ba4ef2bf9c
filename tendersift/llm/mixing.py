"""Mixing sources to target weights by Pareto order sampling.

1. Sources get a target number of words: shares by weight, none above a fixed multiple of its size, the excess
   shared again by weight. Within a source longer documents are preferred: a document whose size has ``b`` bits
   weighs ``b``, under the same limit. Both shares are the same water level problem, solved in closed form from a
   running sum over a small table (sources; sources by bit length).
2. A document with ``e`` expected copies gets floor(e) certain copies. The rest ``p`` is its inclusion chance:
   documents are ranked by random odds over inclusion odds, u/(1-u) / (p/(1-p)), and taken in that order until
   the words the source still lacks are used up. The document at the end is taken if that brings the sum nearer,
   so the sum misses its target by half a document at most.

The end of the ranking is found without ordering a source in one task: words are summed per 1024 rank classes,
then per 1024 classes inside the one that holds the end; only the rest (a millionth) is ordered.

Defined cases: null text has size 0; size 0 is never taken; a null source is a source, last in order; random
numbers come from the id, so reruns and repeated rows agree (a null id has its own number); equal ranks go by id
and size. An empty table gives no rows. Other columns of the input do not matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tendersift.llm.common import WORD, prepare, staged, table, unused, word_count

WEIGHTS, SHARE, LIMIT, CLASSES, SEED = (3, 1, 2), 1.5, 2, 1024, "mix"


def water_level(rows: DataFrame, group: list[str], total: Column, tie: str) -> DataFrame:
    """Add ``given``: shares of ``total`` within ``group`` by ``w``, none above ``cap``.

    A row is full when the level that is left after all rows that fill up before it still reaches it.
    """
    w = Window.partitionBy(*group).orderBy("ratio", tie)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    out = (rows.withColumn("ratio", F.when(F.col("w") > 0, F.col("cap") / F.col("w")).otherwise(0.0)).withColumn("total", total)
           .withColumn("cap_before", F.coalesce(F.sum("cap").over(before), F.lit(0)))
           .withColumn("w_from", F.sum("w").over(Window.partitionBy(*group)) - F.coalesce(F.sum("w").over(before), F.lit(0))))
    out = out.withColumn("full", (F.col("w_from") <= 0) | ((F.col("total") - F.col("cap_before")) / F.col("w_from") >= F.col("ratio")))
    whole = Window.partitionBy(*group)
    level = ((F.col("total") - F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0)).over(whole))
             / F.nullif(F.sum(F.when(F.col("full"), 0).otherwise(F.col("w"))).over(whole), F.lit(0)))
    return out.withColumn("given", F.when(F.col("full"), F.col("cap").cast("double")).otherwise(level * F.col("w"))).drop(
        "ratio", "total", "cap_before", "w_from", "full")


def _unit(key: Column) -> Column:
    """A number in (0, 1) from the first 52 bits of the MD5 of the seed and the key."""
    digest = F.md5(F.concat(F.lit(SEED + ":"), F.coalesce(key.cast("string"), F.lit("null"))))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") + F.lit(0.5)) / F.lit(float(2**52))


def targets(sized: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, limit: int = LIMIT) -> DataFrame:
    """One row per source: skey, source, source_size, target."""
    sources = sized.groupBy("skey", "source").agg(F.sum("size").alias("source_size"))
    # One row per source is numbered in one task: the number of sources, not of documents.
    number = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(x) for x in weights]), (number % len(weights) + 1).cast("int"))
    rows = sources.withColumn("w", weight).withColumn("cap", limit * F.col("source_size"))
    filled = water_level(rows, [], share * F.sum("source_size").over(Window.partitionBy()), "skey")
    return filled.select("skey", "source", "source_size", F.col("given").alias("target"))


def mix_sources(docs: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, limit: int = LIMIT,
                key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, copies, taken."""
    prepare(docs.sparkSession)
    sized = staged(docs.select(F.col(key).alias("doc_id"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"))
                   .withColumn("skey", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n"))))
    per_source = staged(targets(sized, weights, share, limit))
    bits = F.length(F.bin("size")).cast("long")
    levels = (sized.where("size > 0").groupBy("skey", bits.alias("bits")).agg(F.sum("size").alias("words"))
              .withColumn("cap", limit * F.col("words")).withColumn("w", F.col("bits") * F.col("words"))
              .join(per_source.select("skey", F.col("target").alias("asked")), "skey"))
    levels = water_level(levels, ["skey"], F.col("asked"), "bits").withColumn("e", F.least(F.col("given") / F.col("words"), F.lit(float(limit))))
    levels = levels.select("skey", "bits", "words", F.floor("e").alias("certain"), (F.col("e") - F.floor("e")).alias("p"))
    lacks = (levels.groupBy("skey").agg(F.sum(F.col("certain") * F.col("words")).alias("held"))
             .join(per_source, "skey").select("skey", (F.col("target") - F.col("held")).alias("lacks")))
    plan = staged(levels.join(lacks, "skey"))
    u, odds = _unit(F.col("doc_id")), F.col("p") / (1 - F.col("p"))
    full = (sized.withColumn("bits", bits).join(plan.drop("words"), ["skey", "bits"], "left")
            .withColumn("certain", F.when(F.col("size") > 0, F.col("certain")).otherwise(0))
            .withColumn("rank", F.when((F.col("size") > 0) & (F.col("p") > 0), (u / (1 - u)) / odds)))
    place = F.col("rank") / (1 + F.col("rank")) * CLASSES
    full = staged(full.withColumn("c1", F.least(F.floor(place), F.lit(CLASSES - 1))).withColumn(
        "c2", F.least(F.floor((place - F.col("c1")) * CLASSES), F.lit(CLASSES - 1))))
    asked = full.where("rank is not null")

    def end_of(rows: DataFrame, c: str, start: Column) -> DataFrame:
        """The class that holds the end of the ranking, and the words ranked before it."""
        w = Window.partitionBy("skey").orderBy(c)
        return (rows.groupBy("skey", c, "lacks", start.alias("start")).agg(F.sum("size").alias("words"))
                .withColumn("to", F.sum("words").over(w) + F.col("start"))
                .withColumn("start", F.col("to") - F.col("words"))
                .where("start < lacks and lacks <= to").select("skey", c, F.col("start").alias(f"{c}_start"))
                .withColumnsRenamed({c: f"{c}_end"}))

    first = staged(end_of(asked, "c1", F.lit(0)))
    inside = asked.join(first, "skey").where("c1 = c1_end")
    second = staged(end_of(inside, "c2", F.col("c1_start")))
    w = Window.partitionBy("skey").orderBy("rank", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    seen = F.coalesce(F.sum("size").over(w), F.lit(0)) + F.col("c2_start")
    last = (inside.join(second, "skey").where("c2 = c2_end")
            .withColumn("picked", (2 * seen + F.col("size") <= 2 * F.col("lacks")).cast("int")))
    columns = ["doc_id", "skey", "source", "size", "certain", "picked"]
    # Classes before the end are taken whole, classes after it not at all; an end on a border belongs to the class
    # before it. Without an end nothing is lacking, or more than all ranked documents have: none of them or all.
    where = full.join(first, "skey", "left").join(second, "skey", "left").join(
        asked.groupBy("skey").agg(F.sum("size").alias("ranked")), "skey", "left")
    sure = (F.when(F.col("rank").isNull(), 0).when(F.col("c1_end").isNull(), (F.col("ranked") <= F.col("lacks")).cast("int"))
            .when(F.col("c1") != F.col("c1_end"), (F.col("c1") < F.col("c1_end")).cast("int"))
            .otherwise((F.col("c2") < F.col("c2_end")).cast("int")))
    open_ = F.col("rank").isNotNull() & (F.col("c1") == F.col("c1_end")) & (F.col("c2") == F.col("c2_end"))
    rest = where.where(~F.coalesce(open_, F.lit(False))).withColumn("picked", sure)
    both = rest.select(*columns).unionByName(last.select(*columns))
    copies = F.col("certain") + F.col("picked")
    return (both.join(per_source.select("skey", "source_size", "target"), "skey")
            .select("doc_id", "source", "size", "source_size", "target", copies.cast("long").alias("copies"),
                    (copies * F.col("size")).cast("long").alias("taken")))


def materialise(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: every document as often as it is taken. Rows alike in id, source and size share one decision."""
    n, id_, source, size, copies, copy = unused(docs, "_n", "_id", "_source", "_size", "_copies", "_copy")
    mixed = mix_sources(docs, **options).groupBy("doc_id", "source", "size").agg(F.max("copies").alias(copies)).where(F.col(copies) > 0)
    mixed = mixed.withColumnsRenamed({"doc_id": id_, "source": source, "size": size})
    rows = docs.withColumn(n, word_count(F.col("text")))
    rows = rows.join(mixed, F.col("doc_id").eqNullSafe(F.col(id_)) & F.col("source").eqNullSafe(F.col(source)) & (F.col(n) == F.col(size)))
    return rows.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(copies).cast("int")))).select(*docs.columns)


def op3_mixing(spark, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", F.round("target", 4).alias("target"), "taken")


OP3_SQL = f"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}'))::BIGINT AS size FROM documents),
s0 AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
s1 AS (SELECT *, [3, 1, 2][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS w, 2 * source_size AS cap,
  1.5 * sum(source_size) OVER () AS total FROM s0),
s2 AS (SELECT *, cap::DOUBLE / w AS ratio FROM s1),
s3 AS (SELECT *, coalesce(sum(cap) OVER b, 0) AS cap_before, sum(w) OVER () - coalesce(sum(w) OVER b, 0) AS w_from FROM s2
  WINDOW b AS (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
s4 AS (SELECT *, (total - cap_before)::DOUBLE / w_from >= ratio AS is_full FROM s3),
src AS (SELECT source, source_size, CASE WHEN is_full THEN cap::DOUBLE ELSE
  (total - sum(CASE WHEN is_full THEN cap ELSE 0 END) OVER ())::DOUBLE / nullif(sum(CASE WHEN is_full THEN 0 ELSE w END) OVER (), 0) * w END AS target
  FROM s4),
l0 AS (SELECT source, length(bin(size)) AS bits, sum(size)::BIGINT AS words FROM sized WHERE size > 0 GROUP BY 1, 2),
l1 AS (SELECT l0.*, 2 * words AS cap, bits * words AS w, target AS total FROM l0 JOIN src ON l0.source IS NOT DISTINCT FROM src.source),
l2 AS (SELECT *, cap::DOUBLE / w AS ratio FROM l1),
l3 AS (SELECT *, coalesce(sum(cap) OVER b, 0) AS cap_before,
  sum(w) OVER (PARTITION BY source) - coalesce(sum(w) OVER b, 0) AS w_from FROM l2
  WINDOW b AS (PARTITION BY source ORDER BY ratio, bits ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l4 AS (SELECT *, (total - cap_before)::DOUBLE / w_from >= ratio AS is_full FROM l3),
l5 AS (SELECT source, bits, words, total, CASE WHEN is_full THEN cap::DOUBLE ELSE
  (total - sum(CASE WHEN is_full THEN cap ELSE 0 END) OVER p)::DOUBLE / nullif(sum(CASE WHEN is_full THEN 0 ELSE w END) OVER p, 0) * w END AS given
  FROM l4 WINDOW p AS (PARTITION BY source)),
l6 AS (SELECT *, least(given / words, 2.0::DOUBLE) AS e FROM l5),
l7 AS (SELECT *, floor(e) AS certain, e - floor(e) AS p, total - sum(floor(e) * words) OVER (PARTITION BY source) AS lacks FROM l6),
d0 AS (SELECT d.doc_id, d.source, d.size, coalesce(certain, 0)::BIGINT AS certain, p, lacks,
  (('0x' || substr(md5('mix:' || coalesce(d.doc_id::VARCHAR, 'null')), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS u
  FROM sized d LEFT JOIN l7 ON d.source IS NOT DISTINCT FROM l7.source AND d.size > 0 AND length(bin(d.size)) = l7.bits),
d1 AS (SELECT *, CASE WHEN p > 0 THEN (u / (1 - u)) / (p / (1 - p)) END AS rank FROM d0),
d2 AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY source, rank IS NULL ORDER BY rank, doc_id, size
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS seen FROM d1)
SELECT doc_id, size, source_size, round(target, 4) AS target,
  (size * (certain + CASE WHEN rank IS NOT NULL AND 2 * seen + size <= 2 * lacks THEN 1 ELSE 0 END))::BIGINT AS taken
FROM d2 JOIN src ON d2.source IS NOT DISTINCT FROM src.source
"""
