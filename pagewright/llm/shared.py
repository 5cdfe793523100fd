"""What several operators of this package share: lineage cuts, hashing and table access."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, VariantType

from pagewright.scratch import cut, shared_folder, stored

#: Separators of words in the contracts: space and the five ASCII controls 0x09-0x0D.
NOT_SPACE = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: A key is hot where it holds more than this share of the rows, so there are fewer than 1 / HOT_SHARE hot keys.
HOT_SHARE = 1 / 1024
#: A key of fewer rows is never hot.
LEAST_HOT = 500
#: Parts that a hot key's rows are dealt to.
SALTS = 64


def hot_keys(rows: DataFrame, *keys: str) -> DataFrame | bool:
    """(keys, _hot) of the keys that hold more than HOT_SHARE of ``rows``, and LEAST_HOT of them; False where there is none.

    One aggregation of the keys; their list is written only if there is one.
    """
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    seen = counts.agg(F.sum("n").alias("all"), F.max("n").alias("most")).first()
    least = max((seen["all"] or 0) * HOT_SHARE, LEAST_HOT)
    if (seen["most"] or 0) <= least:
        return False
    return stored(counts.where(F.col("n") > least).select(*keys, F.lit(True).alias("_hot")))


def spread_join(rows: DataFrame, facts: DataFrame, *keys: str, hot: DataFrame | bool | None = None, by: list[str] | None = None) -> DataFrame:
    """``rows`` left joined with ``facts``; the rows of a hot key are dealt to SALTS parts by a hash of the columns ``by`` (all).

    Hot keys (see hot_keys) are counted over all rows; only their list, bounded by 1 / HOT_SHARE, is broadcast.
    """
    keys = list(keys)
    hot = hot_keys(rows, *keys) if hot is None else hot
    if hot is False:
        return rows.join(facts, keys, "left")
    plain = by or [f"`{f.name}`" for f in rows.schema if not isinstance(f.dataType, (MapType, VariantType))]
    salt = F.when(F.col("_hot"), F.pmod(F.xxhash64(*plain), F.lit(SALTS)).cast("int")).otherwise(0)
    dealt = rows.join(F.broadcast(hot), keys, "left").withColumn("_salt", salt).drop("_hot")
    parts = hot.select(*keys, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"))
    spread = facts.join(F.broadcast(parts), keys, "left").withColumn("_salt", F.coalesce("_salt", F.lit(0)))
    return dealt.join(spread, [*keys, "_salt"], "left").drop("_salt")


__all__ = ["bound_batches", "cut", "fold", "hot_keys", "shared_folder", "spread_join", "stored", "table"]


def bound_batches(spark: SparkSession, rows: int = 2000, size: int = 8 << 20) -> None:
    """Keep the Arrow batches that go to Python workers small: by rows, and by bytes for long texts."""
    if not 0 < int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))


def fold(id_column: str, modulus: int = 5) -> Column:
    """crc32 of the id as text, modulo ``modulus``; null ids hash as the empty string."""
    return F.crc32(F.coalesce(F.col(id_column).cast("string"), F.lit(""))) % modulus
