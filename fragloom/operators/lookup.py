"""Left joins to a table of one row a key, in which no frequent key meets in one task."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is frequent when its uses exceed this share of one shuffle partition's fair part; so at most
#: partitions / SHARE keys are.  Bytes of their rows that may be broadcast, and slots for rows already served.
SHARE, BROADCAST_BYTES, SLOTS = 0.5, 8 << 20, 1024


def frequent(table: DataFrame, uses: str) -> DataFrame:
    """The rows of frequent keys, as many of the most used ones as BROADCAST_BYTES hold."""
    spark = table.sparkSession
    total = table.agg(F.sum(uses)).first()[0] or 0
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = table.where(F.col(uses) > total / partitions * SHARE)
    widest = rows.agg(F.max(F.octet_length(F.to_json(F.struct("*"))))).first()[0] or 1
    return rows.orderBy(F.desc(uses)).limit(max(BROADCAST_BYTES // widest, 1))


def lookup(rows: DataFrame, table: DataFrame, keys: list, uses: str) -> DataFrame:
    """`rows` with the columns of `table`, NULL where it lacks the key.

    `uses` counts the rows of each key.  Rows of frequent keys take their values from a broadcast
    table; in the join of the rest they carry a slot that no key has, so they are spread evenly.
    """
    found = [c for c in table.columns if c not in (*keys, uses)]
    heavy = frequent(table, uses).select(*keys, F.struct(*found).alias("_heavy"))
    # slot 0, but no literal: the optimizer would take a constant out of the keys, and all rows of a key met again
    light = table.select(*keys, (F.col(uses) % 1).cast("int").alias("_slot"), F.struct(*found).alias("_light"))
    served = rows.join(F.broadcast(heavy), keys, "left")
    is_served = F.col("_heavy").isNotNull()
    plain = [c for c, kind in rows.dtypes if "map<" not in kind and kind != "variant"]  # the others have no hash
    slot = F.when(is_served, F.pmod(F.xxhash64(*plain), F.lit(SLOTS)).cast("int") + 1).otherwise(0)
    joined = served.withColumn("_slot", slot).join(light, [*keys, "_slot"], "left")
    return joined.select(*rows.columns, *[F.when(is_served, F.col("_heavy")[c]).otherwise(F.col("_light")[c]).alias(c) for c in found])
