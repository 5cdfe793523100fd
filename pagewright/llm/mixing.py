"""Mixing sources to target weights, by DataFrame functions only.

Every document gets an Efraimidis-Spirakis key, ``-ln(u) / quality``; ascending
keys draw a weighted sample without replacement within a source.  A source's
target divided by its size gives complete epochs (every document that often) and
a rest, which is filled along ascending keys until a document's midpoint passes
the rest, so a source misses its target by half a document at most.

Only sums per (source, key bucket) are sorted to place the rest; the rows of the
one bucket in which it ends are the only ones that go through a window, so a
source with a third of all rows is never gathered in one task.  Buckets are a
monotone function of the key, about 10,000 rows each.

Defined cases: null text has size 0; documents of size 0 have no copies; null sources are one source, ordered last; null ids are hashed with their
text; repeated rows are separate documents (equal keys are ordered by size, and
such rows are interchangeable); an empty table gives an empty result; other
columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagewright.llm.shared import NOT_SPACE, cut, table

#: Signs that prose seldom has; their share lowers a document's quality weight.
SIGNS = "*#$%&|!<>{}[]^~=_+/@"
LEAST_QUALITY = 0.05
#: Source weights by code point order of the source, repeating.
WEIGHTS = (5, 2, 1)
MOST_EPOCHS = 3
ROWS_PER_BUCKET = 10_000
LEAST_BUCKETS = 64
SALTS = 32


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(NOT_SPACE)), F.lit(0)).cast("long")


def quality_weight(text: Column) -> Column:
    """1 for prose, falling by ten times the share of rare signs, to LEAST_QUALITY."""
    whole = F.length(text)
    signs = whole - F.length(F.translate(text, SIGNS, ""))
    return F.coalesce(F.greatest(F.lit(LEAST_QUALITY), 1 - 10 * signs / F.greatest(whole, F.lit(1))), F.lit(1.0))


def sampling_key(doc_id: Column, text: Column, quality: Column) -> Column:
    """-ln(u) / quality, u in (0, 1) from 52 bits of an md5 of id and text."""
    label = F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce(text, F.lit(""))))
    bits = F.conv(F.substring(F.md5(label), 1, 13), 16, 10).cast("long")
    return -F.ln((bits.cast("double") + 0.5) / F.lit(float(1 << 52))) / quality


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = MOST_EPOCHS) -> DataFrame:
    """Targets of (skey, source, source_size, n_rows): the total shared by weight, none above ``cap`` sizes.

    Sources sorted by capped size per weight are capped from the front while the
    level that the others would get is not below their own; one row per source.
    """
    rank = F.row_number().over(Window.orderBy(F.col("source").isNull(), "source"))
    ranked = sizes.withColumn("rank", rank).withColumn(
        "weight", F.element_at(F.array(*map(F.lit, weights)), ((F.col("rank") - 1) % len(weights) + 1).cast("int")))
    ranked = ranked.withColumn("full", (cap * F.col("source_size")).cast("double")).withColumn("ratio", F.col("full") / F.col("weight"))
    up = Window.orderBy("ratio", "rank").rowsBetween(Window.unboundedPreceding, -1)
    down = Window.orderBy(F.desc("ratio"), F.desc("rank")).rowsBetween(Window.unboundedPreceding, 0)
    every = Window.partitionBy()
    level = (F.sum("source_size").over(every) - F.coalesce(F.sum("full").over(up), F.lit(0.0))) / F.sum("weight").over(down)
    ranked = ranked.withColumn("level", level).withColumn("open", F.col("ratio") > F.col("level"))
    common = F.max(F.when(F.col("open"), F.col("level"))).over(every)
    return ranked.withColumn("target", F.when(F.col("open"), common * F.col("weight")).otherwise(F.col("full"))).select(
        "skey", "source_size", "n_rows", "target")


def joined_by_source(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """``rows`` with their source's columns; a source's row is copied to SALTS keys, so a hot source is spread."""
    spread = sources.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("salt", F.pmod(F.xxhash64("doc_id", "key"), F.lit(SALTS)).cast("int")).join(spread, ["skey", "salt"]).drop("salt")


def mix(documents: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = MOST_EPOCHS) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken, copies) for every row of (doc_id, text, source)."""
    text = F.col("text")
    base = cut(documents.select(
        "doc_id", "source", F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("skey"), n_words(text).alias("size"),
        sampling_key(F.col("doc_id"), text, quality_weight(text)).alias("key")))
    sizes = base.groupBy("skey", "source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_rows"))
    plan = cut(source_targets(sizes, weights, cap).select(
        "skey", "source_size", "target",
        F.greatest(F.lit(LEAST_BUCKETS), F.ceil(F.col("n_rows") / ROWS_PER_BUCKET)).alias("buckets"),
        F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).alias("epochs"))
        .withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size")))
    bucket = F.floor(F.col("key") / (1 + F.col("key")) * F.col("buckets"))
    placed = joined_by_source(base, plan).withColumn("bucket", bucket)
    sums = placed.groupBy("skey", "rest", "bucket").agg(F.sum("size").alias("words"))
    along = Window.partitionBy("skey").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("before", F.coalesce(F.sum("words").over(along), F.lit(0)))
    ends = sums.groupBy("skey").agg(
        F.min(F.when(F.col("before") + F.col("words") > F.col("rest"), F.struct("bucket", "before"))).alias("first"),
        F.min(F.when(F.col("before") > F.col("rest"), F.col("bucket"))).alias("past"))
    # Rows before `first` are inside the rest, rows from `past` on are outside; those between are looked at one by one.
    placed = joined_by_source(base, cut(plan.join(ends, "skey"))).withColumn("bucket", bucket)
    place = (F.when(F.col("first").isNull() | (F.col("bucket") < F.col("first.bucket")), 1)
             .when(F.col("bucket") >= F.col("past"), 0))
    placed = placed.select("doc_id", "source", "size", "source_size", "target", "epochs", "rest", "skey", "key",
                           F.col("first.before").alias("before"), place.alias("inside"))
    in_order = Window.partitionBy("skey").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    edge = placed.where("inside IS NULL").withColumn("upto", F.col("before") + F.sum("size").over(in_order)).withColumn(
        "inside", (F.col("upto") - F.col("size") / 2 <= F.col("rest")).cast("int")).drop("upto")
    copies = F.when(F.col("size") > 0, F.col("epochs") + F.col("inside")).otherwise(0).cast("long")
    return placed.where("inside IS NOT NULL").unionByName(edge).select(
        "doc_id", "source", "size", "source_size", "target", (F.col("size") * copies).alias("taken"), copies.alias("copies"))


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source")).drop("source", "copies")


ORACLE = r"""
WITH base AS (
  SELECT doc_id, source,
    coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
    -ln((('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0)
      / coalesce(greatest(0.05, 1 - 10 * (length(text) - length(translate(text, '*#$%&|!<>{}[]^~=_+/@', '')))::DOUBLE / greatest(length(text), 1)), 1.0) AS key
  FROM documents),
sizes AS (SELECT source, sum(size)::BIGINT AS source_size FROM base GROUP BY source),
ranked AS (SELECT *, row_number() OVER (ORDER BY (source IS NULL), source) AS rank FROM sizes),
weighed AS (SELECT *, [5, 2, 1][(rank - 1) % 3 + 1] AS weight, (3 * source_size)::DOUBLE AS "full" FROM ranked),
levels AS (
  SELECT *, "full" / weight AS ratio FROM weighed),
leveled AS (
  SELECT *, ((sum(source_size) OVER ())::DOUBLE
    - coalesce(sum("full") OVER (ORDER BY ratio, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / (sum(weight) OVER (ORDER BY ratio DESC, rank DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))::DOUBLE AS level FROM levels),
targets AS (
  SELECT source, source_size, CASE WHEN ratio > level
    THEN (max(CASE WHEN ratio > level THEN level END) OVER ()) * weight ELSE "full" END AS target FROM leveled),
shares AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS epochs FROM targets),
running AS (
  SELECT b.doc_id, b.size, s.source_size, s.target, s.epochs, s.target - s.epochs * s.source_size AS rest,
    sum(b.size) OVER (PARTITION BY b.source ORDER BY b.key, b.doc_id, b.size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto
  FROM base b JOIN shares s ON b.source IS NOT DISTINCT FROM s.source)
SELECT doc_id, size, source_size, target,
  (size * (epochs + CASE WHEN upto - size / 2.0 <= rest THEN 1 ELSE 0 END))::BIGINT AS taken
FROM running
"""
