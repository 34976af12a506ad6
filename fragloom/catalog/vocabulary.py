"""Queries of vocabularies, encodings and batches."""

from pyspark.sql import functions as F

from ..functions import tokens
from ..operators import dataset, vocab
from ..plans import jobs
from . import fixtures as fx
from .registry import query
from .text import TOK

SIDES = {"scaffold": "scaffold", "decoration": "decoration"}
VOCAB = fx.sql("fx_train") + rf""", words AS (
    SELECT DISTINCT 'scaffold' AS side, unnest(regexp_extract_all(scaffold, '{TOK}')) AS token FROM fx_train
    UNION SELECT DISTINCT 'decoration', unnest(regexp_extract_all(decoration, '{TOK}')) FROM fx_train),
    vocab AS (SELECT side, token, row_number() OVER (PARTITION BY side ORDER BY token) + 2 AS id FROM words
    UNION ALL SELECT side, token, id FROM (VALUES ('scaffold'), ('decoration')) s(side), (VALUES ('<pad>', 0), ('$', 1), ('^', 2)) v(token, id)) """


def _vocab(spark, sf):
    return vocab.build(fx.view(spark, sf, "fx_train"), SIDES)


@query("vocab_build", "WITH " + VOCAB + "SELECT side, token, CAST(id AS BIGINT) AS id FROM vocab")
def vocab_build(spark, sf):
    return _vocab(spark, sf)


@query("vocab_documents", rf"""WITH words AS (SELECT DISTINCT unnest(regexp_extract_all(text, '{TOK}')) AS token FROM documents)
    SELECT 'text' AS side, token, CAST(row_number() OVER (ORDER BY token) + 2 AS BIGINT) AS id FROM words
    UNION ALL SELECT 'text', token, CAST(id AS BIGINT) FROM (VALUES ('<pad>', 0), ('$', 1), ('^', 2)) v(token, id)""")
def vocab_documents(spark, sf):
    return vocab.build(fx.table(spark, sf, "documents"), {"text": "text"})


@query("vocab_sizes", "WITH " + VOCAB + "SELECT side, count(*) AS n_tokens FROM vocab GROUP BY side")
def vocab_sizes(spark, sf):
    return vocab.sizes(_vocab(spark, sf))


def _pair_words(spark, sf):
    return vocab.corpus_tokens(fx.view(spark, sf, "fx_pair"), SIDES)


PAIR_WORDS = ", " + fx.sql("fx_pair") + rf""", fresh AS (
    SELECT DISTINCT 'scaffold' AS side, unnest(regexp_extract_all(scaffold, '{TOK}')) AS token FROM fx_pair
    UNION SELECT DISTINCT 'decoration', unnest(regexp_extract_all(decoration, '{TOK}')) FROM fx_pair) """


@query("vocab_extend", "WITH " + VOCAB + PAIR_WORDS + """
    , top AS (SELECT side, max(id) AS m FROM vocab GROUP BY side)
    SELECT side, token, CAST(id AS BIGINT) AS id FROM vocab
    UNION ALL SELECT f.side, f.token, CAST(m + row_number() OVER (PARTITION BY f.side ORDER BY f.token) AS BIGINT)
    FROM fresh f JOIN top USING (side) ANTI JOIN vocab v ON f.side = v.side AND f.token = v.token""")
def vocab_extend(spark, sf):
    return vocab.extend(_vocab(spark, sf), _pair_words(spark, sf))


@query("vocab_delete", "WITH " + VOCAB + PAIR_WORDS + """
    SELECT v.side, v.token, CAST(id AS BIGINT) AS id FROM vocab v ANTI JOIN fresh f ON f.side = v.side AND f.token = v.token""")
def vocab_delete(spark, sf):
    return vocab.delete(_vocab(spark, sf), _pair_words(spark, sf))


@query("vocab_contains", "WITH " + VOCAB + PAIR_WORDS + "SELECT f.side, f.token FROM fresh f SEMI JOIN vocab v ON f.side = v.side AND f.token = v.token")
def vocab_contains(spark, sf):
    return vocab.contains(_vocab(spark, sf), _pair_words(spark, sf))


@query("vocab_diff", "WITH " + VOCAB + PAIR_WORDS + """
    , other AS (SELECT side, token, row_number() OVER (PARTITION BY side ORDER BY token) + 2 AS id FROM fresh
    UNION ALL SELECT side, token, id FROM (VALUES ('scaffold'), ('decoration')) s(side), (VALUES ('<pad>', 0), ('$', 1), ('^', 2)) v(token, id))
    SELECT *, 'left' AS only_in FROM (SELECT side, token, CAST(id AS BIGINT) AS id FROM vocab EXCEPT ALL SELECT side, token, CAST(id AS BIGINT) FROM other)
    UNION ALL SELECT *, 'right' FROM (SELECT side, token, CAST(id AS BIGINT) AS id FROM other EXCEPT ALL SELECT side, token, CAST(id AS BIGINT) FROM vocab)""")
def vocab_diff(spark, sf):
    return vocab.difference(_vocab(spark, sf), vocab.build(fx.view(spark, sf, "fx_pair"), SIDES))


@query("vocab_tokens", "WITH " + VOCAB + "SELECT side, string_agg(token, ' ' ORDER BY id) AS tokens FROM vocab GROUP BY side")
def vocab_tokens(spark, sf):
    rows = _vocab(spark, sf).groupBy("side").agg(F.array_sort(F.collect_list(F.struct("id", "token"))).alias("l"))
    return rows.select("side", F.array_join(F.transform("l", lambda e: e["token"]), " ").alias("tokens"))


ENCODED = VOCAB + rf""", body AS (SELECT pair_id, scaffold, decoration,
        list_concat(['^'], regexp_extract_all(scaffold, '{TOK}'), ['$']) AS st,
        list_concat(['^'], regexp_extract_all(decoration, '{TOK}'), ['$']) AS dt FROM {{source}}),
    maps AS (SELECT map_from_entries(list((token, id)) FILTER (side = 'scaffold')) AS sm,
                    map_from_entries(list((token, id)) FILTER (side = 'decoration')) AS dm FROM vocab),
    enc AS (SELECT pair_id, scaffold, decoration, [sm[t] for t in st] AS s_ids, [dm[t] for t in dt] AS d_ids FROM body, maps) """


def _flat(ids):
    return F.array_join(ids.cast("array<string>"), " ")


@query("encode", "WITH " + ENCODED.replace("{source}", "fx_train") + """
    SELECT pair_id, array_to_string(s_ids, ' ') AS scaffold_ids, array_to_string(d_ids, ' ') AS decoration_ids FROM enc""")
def encode(spark, sf):
    rows = vocab.encode(fx.view(spark, sf, "fx_train"), _vocab(spark, sf), SIDES)
    return rows.select("pair_id", _flat(F.col("scaffold_ids")).alias("scaffold_ids"),
                       _flat(F.col("decoration_ids")).alias("decoration_ids"))


@query("decode", "WITH " + fx.sql("fx_train") + " SELECT pair_id, scaffold AS scaffold_text, decoration AS decoration_text FROM fx_train")
def decode(spark, sf):
    words = _vocab(spark, sf)
    ids = vocab.encode(fx.view(spark, sf, "fx_train"), words, SIDES)
    back = vocab.decode(ids, words, {"scaffold": "scaffold_ids", "decoration": "decoration_ids"})
    return back.select("pair_id", "scaffold_text", "decoration_text")


@query("encode_repeated_keys", "WITH " + ENCODED.replace("{source}", "fx_train") + """
    SELECT split_part(pair_id, '-', 1) AS order_key, array_to_string(d_ids, ' ') AS decoration_ids FROM enc""")
def encode_repeated_keys(spark, sf):
    """The order key repeats, and rows of one order have different texts."""
    rows = fx.view(spark, sf, "fx_train").select(F.split_part("pair_id", F.lit("-"), F.lit(1)).alias("order_key"), "decoration")
    return vocab.encode(rows, _vocab(spark, sf), {"decoration": "decoration"}).select("order_key", _flat(F.col("decoration_ids")).alias("decoration_ids"))


@query("decode_empty", "WITH " + fx.sql("fx_train") + """
    SELECT pair_id, CASE CAST(split_part(pair_id, '-', 2) AS INT) % 3 WHEN 0 THEN '' WHEN 1 THEN NULL ELSE decoration END AS decoration_text FROM fx_train""")
def decode_empty(spark, sf):
    """Every third row has no ids, every third has an id outside the vocabulary."""
    words = _vocab(spark, sf)
    ids = vocab.encode(fx.view(spark, sf, "fx_train"), words, {"decoration": "decoration"})
    kind = F.split_part("pair_id", F.lit("-"), F.lit(2)).cast("int") % 3
    none = F.slice("decoration_ids", 1, 0)
    ids = ids.withColumn("decoration_ids", F.when(kind == 0, none).when(kind == 1, F.array(F.lit(-7).cast("bigint"))).otherwise(F.col("decoration_ids")))
    return vocab.decode(ids, words, {"decoration": "decoration_ids"}).select("pair_id", "decoration_text")


@query("oov_rows", "WITH " + ENCODED.replace("{source}", "fx_pair").replace("body AS", fx.sql("fx_pair") + ", body AS", 1) + """
    SELECT pair_id, len(list_filter(s_ids, lambda x: x IS NULL)) > 0 AS scaffold_oov,
           len(list_filter(d_ids, lambda x: x IS NULL)) > 0 AS decoration_oov FROM enc""")
def oov_rows(spark, sf):
    rows = vocab.encode(fx.view(spark, sf, "fx_pair"), _vocab(spark, sf), SIDES)
    return rows.select("pair_id", F.col("scaffold_ids").isNull().alias("scaffold_oov"),
                       F.col("decoration_ids").isNull().alias("decoration_oov"))


SHUFFLED = """, spread AS (SELECT *, md5(concat_ws('|', '7', pair_id, CAST(epoch AS VARCHAR))) AS h FROM enc, range(1, 3) e(epoch)),
    placed AS (SELECT *, CAST(floor((row_number() OVER (PARTITION BY epoch ORDER BY h, pair_id) - 1) / 128) AS BIGINT) AS batch FROM spread),
    kept AS (SELECT * FROM placed WHERE batch < (SELECT floor(count(*) / 128) FROM enc)) """


@query("epoch_batches", "WITH " + fx.sql("fx_train") + ", enc AS (SELECT pair_id FROM fx_train)" + SHUFFLED + """
    SELECT pair_id, CAST(epoch AS INT) AS epoch, batch FROM kept""")
def epoch_batches(spark, sf):
    rows = fx.view(spark, sf, "fx_train").select("pair_id")
    return dataset.batches(rows, "pair_id", 2, 128, 7).select("pair_id", "epoch", "batch")


@query("batch_counts", "WITH " + fx.sql("fx_train") + """ SELECT CAST(epoch AS INT) AS epoch, CAST(floor(count(*) / 128) AS BIGINT) AS n_batches
    FROM fx_train, range(1, 3) e(epoch) GROUP BY epoch""")
def batch_counts(spark, sf):
    rows = fx.view(spark, sf, "fx_train").select("pair_id")
    return dataset.n_batches(dataset.batches(rows, "pair_id", 2, 128, 7))


@query("padded_batches", "WITH " + ENCODED.replace("{source}", "fx_train") + SHUFFLED + """
    , wide AS (SELECT *, max(len(d_ids)) OVER (PARTITION BY epoch, batch) AS w FROM kept)
    SELECT pair_id, CAST(epoch AS INT) AS epoch, batch, CAST(len(d_ids) AS BIGINT) AS n,
           array_to_string(list_concat(d_ids, [0 for i in range(0, w - len(d_ids))]), ' ') AS ids FROM wide""")
def padded_batches(spark, sf):
    rows = jobs.epoch_batches(fx.view(spark, sf, "fx_train"), _vocab(spark, sf), 2, 128, "pair_id", 7)
    return rows.select("pair_id", "epoch", "batch", F.col("decoration_ids_len").cast("bigint").alias("n"),
                       _flat(F.col("decoration_ids")).alias("ids"))


@query("epoch_sets", "WITH " + fx.sql("fx_train") + """, s AS (SELECT CAST(substr(pair_id, 1, 1) AS INT) % 3 AS set_no, pair_id FROM fx_train)
    SELECT CAST(epoch AS INT) AS epoch, set_no, count(*) AS n_rows FROM s, range(1, 8) e(epoch) WHERE (epoch - 1) % 3 = set_no GROUP BY ALL""")
def epoch_sets(spark, sf):
    sets = fx.view(spark, sf, "fx_train").select((F.substring("pair_id", 1, 1).cast("int") % 3).alias("set_no"), "pair_id")
    epochs = spark.range(1, 8).select(F.col("id").cast("int").alias("epoch"))
    return dataset.assign_sets(epochs, sets).groupBy("epoch", "set_no").agg(F.count(F.lit(1)).alias("n_rows"))
