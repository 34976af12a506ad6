"""Vocabularies as tables (side, token, id)."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import tokens
from .lineage import materialise
from .lookup import lookup
from .ranking import ranked

def corpus_tokens(df: DataFrame, sides: dict) -> DataFrame:
    """Distinct (side, token) of the text columns given as {side: column}."""
    pairs = F.array(*[F.struct(F.lit(s).alias("side"), F.col(c).alias("text")) for s, c in sides.items()])
    # tokens are merged map-side, so the shuffle carries an alphabet per task and no text
    found = F.array_distinct(tokens.tokenize(F.col("text"), marks=False))
    return df.select(F.inline(pairs)).select("side", F.explode(found).alias("token")).distinct()


def build(df: DataFrame, sides: dict) -> DataFrame:
    """Ids 0..2 for the special tokens, then the corpus tokens in code-point order."""
    found = ranked(corpus_tokens(df, sides), ["side"], ["token"], "_r")
    special = df.sparkSession.range(1).select(F.explode(F.array(*[F.lit(s) for s in sides])).alias("side"))
    special = special.select("side", F.posexplode(F.array(*[F.lit(t) for t in tokens.SPECIAL])).alias("id", "token"))
    return special.select("side", "token", F.col("id").cast("bigint")).unionByName(
        found.select("side", "token", (F.col("_r") + len(tokens.SPECIAL) - 1).cast("bigint").alias("id")))


def sizes(vocabulary: DataFrame) -> DataFrame:
    return vocabulary.groupBy("side").agg(F.count(F.lit(1)).alias("n_tokens"))


def extend(vocabulary: DataFrame, new: DataFrame) -> DataFrame:
    """Add unseen (side, token) rows behind the largest id of their side, in token order."""
    unseen = new.select("side", "token").distinct().join(vocabulary, ["side", "token"], "left_anti")
    numbered = ranked(unseen, ["side"], ["token"], "_r")
    top = vocabulary.groupBy("side").agg(F.max("id").alias("_top"))
    added = numbered.join(top, "side", "left").select(
        "side", "token", (F.coalesce(F.col("_top"), F.lit(-1)) + F.col("_r")).alias("id"))
    return vocabulary.unionByName(added)


def delete(vocabulary: DataFrame, gone: DataFrame) -> DataFrame:
    return vocabulary.join(gone.select("side", "token"), ["side", "token"], "left_anti")


def contains(vocabulary: DataFrame, wanted: DataFrame) -> DataFrame:
    return wanted.join(vocabulary, ["side", "token"], "left_semi")


def difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows in only one of two vocabularies; empty when they are equal."""
    return left.exceptAll(right).withColumn("only_in", F.lit("left")).unionByName(
        right.exceptAll(left).withColumn("only_in", F.lit("right")))


def add_rows(vocabulary: DataFrame, rows: DataFrame) -> DataFrame:
    """Add (side, token, id) rows; an id already in use raises when the result is read."""
    both = vocabulary.unionByName(rows)
    uses = both.groupBy("side", "id").agg(F.count(F.lit(1)).alias("_uses"))
    return both.join(uses, ["side", "id"]).withColumn(
        "id", F.when(F.col("_uses") == 1, F.col("id")).otherwise(
            F.raise_error(F.lit("id already present in vocabulary")).cast("bigint"))).select("side", "token", "id")


def encode(df: DataFrame, vocabulary: DataFrame, sides: dict) -> DataFrame:
    """Add `<side>_ids` (NULL when a token is unknown or the text is) for text columns {side: column}."""
    for side, column in sides.items():
        df = _translate(df, vocabulary, side, column, lambda c: F.sha2(c, 256), tokens.tokenize, f"{side}_ids", True)
    return df


def decode(df: DataFrame, vocabulary: DataFrame, sides: dict) -> DataFrame:
    """Add `<side>_text` for id columns {side: column}; no ids are the empty text, unknown or NULL ids NULL."""
    def name(ids):
        return F.sha2(F.array_join(ids.cast("array<string>"), ",", "?"), 256)

    for side, column in sides.items():
        df = _translate(df, vocabulary, side, column, name, lambda ids: ids, f"{side}_text", False, tokens.untokenize)
    return df


def _translate(df, vocabulary, side, column, name, array, out, forward, finish=lambda found: found):
    """Translate every different sequence once, by a join of its tokens; `name` gives a sequence's digest.

    Equal sequences are counted map-side.  Rows look their result up by the digest, with frequent ones
    set apart, so repeated rows and keys do not meet.  Whether the vocabulary and the results are
    broadcast is left to their measured size; the result is the same.
    """
    source, target = ("token", "id") if forward else ("id", "token")
    words = vocabulary.where(F.col("side") == side).select(F.col(source).alias("_word"), F.col(target).alias("_hit"))
    counted = df.select(F.col(column).alias("_key")).where(F.col("_key").isNotNull()).groupBy("_key").agg(F.count(F.lit(1)).alias("_uses"))
    different = counted.select(name(F.col("_key")).alias("_name"), array(F.col("_key")).alias("_seq"), "_uses")
    spread = different.select("_name", "_uses", F.posexplode_outer("_seq").alias("_pos", "_word"))
    found = spread.join(words, "_word", "left").groupBy("_name", "_uses").agg(
        F.array_sort(F.collect_list(F.when(F.col("_pos").isNotNull(), F.struct("_pos", "_hit")))).alias("_found"))
    hits = F.when(F.forall("_found", lambda e: e["_hit"].isNotNull()), F.transform("_found", lambda e: e["_hit"])).alias("_hits")
    found = materialise(found.select("_name", "_uses", hits).select("_name", "_uses", finish(F.col("_hits")).alias(out)))
    return lookup(df.drop(out).withColumn("_name", name(F.col(column))), found, ["_name"], "_uses").drop("_name")
