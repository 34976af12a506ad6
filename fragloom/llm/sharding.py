"""Weighted rendezvous hashing of record keys, in plain Column functions.

Every (key, shard) pair has a score, and the smallest of -ln(u) / weight wins: shards get keys
in proportion to their weights, and a new shard takes rows only into itself.  Slots number the
rows of a shard without gaps: rows are merged by what orders them, ordered inside hash-prefix
buckets, and shifted by the sizes of the earlier buckets, so no task holds a shard.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .rows import named

#: Copies of one row that are numbered in one go.
RUN = 100_000


def key_text(key: Column) -> Column:
    """Text to hash: a null key is a key of its own."""
    return F.coalesce(F.concat(F.lit("k"), key.cast("string")), F.lit("n"))


def score(key: Column, shard, weight: float = 1.0) -> Column:
    """The rendezvous score of a key at a shard; 13 hex digits of its digest are uniform in (0, 1)."""
    digest = F.substring(F.md5(F.concat(key_text(key), F.lit(f":{shard}"))), 1, 13)
    uniform = (F.conv(digest, 16, 10).cast("double") + 0.5) / float(1 << 52)
    return -F.log(uniform) / float(weight)


def rendezvous(key: Column, shards: dict) -> Column:
    """The shard of a key; shards: {label: positive weight}.  Equal scores go to the smaller label."""
    if not shards or min(shards.values()) <= 0:
        raise ValueError("shards need positive weights")
    return F.array_min(F.array(*[F.struct(score(key, s, w).alias("score"), F.lit(s).alias("shard"))
                                 for s, w in shards.items()])).getField("shard")


def assign(df: DataFrame, shards: dict, key: str = "doc_id", name: str = "shard") -> DataFrame:
    """Adds the shard column to every row; no shuffle.  A null key has a shard like any other."""
    return df.withColumn(name, rendezvous(named(key), shards))


def slots(df: DataFrame, columns: list, shard: str = "shard", digits: int = 3) -> DataFrame:
    """(shard, *columns, slot): slots 0 .. n-1 in each shard, one row for each row.

    Rows are ordered by the digest of `columns`; equal rows, which nothing tells apart, are
    counted before the shuffle and numbered in a run.  A group that one task orders is
    1 / 16^digits of a shard's different rows: raise `digits` with the data.
    """
    digest = F.md5(F.concat_ws("|", *[key_text(named(c)) for c in columns]))
    merged = (df.groupBy(shard, *columns).agg(F.count(F.lit(1)).alias("_n"))
              .withColumn("_digest", digest).withColumn("_bucket", F.substring("_digest", 1, digits)))
    before = Window.partitionBy(shard).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (merged.groupBy(shard, "_bucket").agg(F.sum("_n").alias("_size"))
               .select(shard, "_bucket", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset")))
    inside = Window.partitionBy(shard, "_bucket").orderBy("_digest", *columns).rowsBetween(Window.unboundedPreceding, -1)
    first = F.col("_offset") + F.coalesce(F.sum("_n").over(inside), F.lit(0))
    placed = merged.join(offsets, [shard, "_bucket"]).withColumn("_first", first)
    # runs of copies are dealt out in parts, so that no task writes a large group alone
    parts = placed.withColumn("_part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("_n") - 1) / RUN))))
    parts = parts.repartition(F.col("_digest"), F.col("_part"))
    start = F.col("_part") * RUN
    copies = F.explode(F.sequence(start, F.least(F.col("_n"), start + RUN) - 1))
    return parts.withColumn("_copy", copies).select(shard, *columns, (F.col("_first") + F.col("_copy")).alias("slot"))


def sized(df: DataFrame, id: str = "doc_id", text: str = "text", overhead: int = 8) -> DataFrame:
    """(id, size, text_crc32): UTF-8 bytes plus overhead; a null text counts as empty."""
    raw = F.coalesce(named(text), F.lit("")).cast("binary")
    return df.select(named(id).alias(id), (F.octet_length(raw) + overhead).cast("bigint").alias("size"), F.crc32(raw).alias("text_crc32"))
