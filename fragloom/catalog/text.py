"""Queries of the text operators: fields, attachment points, tokens."""

from pyspark.sql import functions as F

from ..functions import attach, tokens
from ..sources import readers
from . import fixtures as fx
from .registry import query

AP = r"(?:\*|\[\*[^\]]*\])"
NUM = r"\[\*:(\d+)\]"
TOK = r"(?s)\[[^\]]*\]|%\d{2}|Br|Cl|."
PAIRS = "WITH " + fx.sql("fx_pair") + ", p AS (SELECT pair_id, concat(scaffold, '.', decoration) AS smi FROM fx_pair) "


def _pairs(spark, sf):
    return fx.view(spark, sf, "fx_pair").select("pair_id", F.concat_ws(".", "scaffold", "decoration").alias("smi"))


@query("read_fields", "WITH " + fx.sql("fx_line") + r"""
    , s AS (SELECT line_no, string_split(regexp_replace(line, '\s+$', ''), chr(9)) AS f FROM fx_line WHERE regexp_full_match(line, '(?s)\s*') = false)
    SELECT line_no, f[1] AS first_field, CAST(len(f) AS BIGINT) AS n_fields, array_to_string(f[1:2], '|') AS first_two FROM s""")
def read_fields(spark, sf):
    lines = fx.view(spark, sf, "fx_line").where(readers.keep_filled(F.col("line")))
    return lines.select(
        "line_no", F.get(readers.fields(F.col("line")), F.lit(0)).alias("first_field"),
        F.size(readers.fields(F.col("line"))).cast("bigint").alias("n_fields"),
        F.array_join(readers.fields(F.col("line"), 2), "|").alias("first_two"))


@query("read_head", "WITH " + fx.sql("fx_line") + " SELECT line_no, line FROM fx_line ORDER BY line_no LIMIT 100")
def read_head(spark, sf):
    return fx.view(spark, sf, "fx_line").orderBy("line_no").limit(100)


@query("ap_remove", PAIRS + rf"SELECT pair_id, regexp_replace(smi, '{NUM}', '[*]', 'g') AS smi FROM p")
def ap_remove(spark, sf):
    return _pairs(spark, sf).select("pair_id", attach.remove_numbers(F.col("smi")).alias("smi"))


@query("ap_number_all", PAIRS + rf""", s AS (SELECT pair_id, string_split_regex(smi, '{AP}') AS l FROM p)
    SELECT pair_id, array_to_string([CASE WHEN i = 1 THEN l[i] ELSE concat('[*:', i - 2, ']', l[i]) END for i in range(1, len(l) + 1)], '') AS smi FROM s""")
def ap_number_all(spark, sf):
    return _pairs(spark, sf).select("pair_id", attach.number_all(F.col("smi")).alias("smi"))


@query("ap_first", PAIRS + rf"""SELECT pair_id, regexp_replace(smi, '{AP}', '[*:7]') AS smi,
    CAST(nullif(regexp_extract(smi, '{NUM}', 1), '') AS INT) AS first_point FROM p""")
def ap_first(spark, sf):
    return _pairs(spark, sf).select("pair_id", attach.number_first(F.col("smi"), 7).alias("smi"),
                                    attach.first_point(F.col("smi")).alias("first_point"))


@query("ap_brackets", PAIRS + r"""SELECT pair_id, array_to_string([CASE WHEN t = '*' THEN '[*]' ELSE t END
    for t in regexp_extract_all(smi, '\[[^\]]*\]|.')], '') AS smi FROM p""")
def ap_brackets(spark, sf):
    return _pairs(spark, sf).select("pair_id", attach.add_brackets(F.col("smi")).alias("smi"))


@query("ap_points", PAIRS + rf"SELECT pair_id, array_to_string(regexp_extract_all(smi, '{NUM}', 1), ',') AS points FROM p")
def ap_points(spark, sf):
    points = attach.points(F.col("smi")).cast("array<string>")
    return _pairs(spark, sf).select("pair_id", F.array_join(points, ",").alias("points"))


@query("ap_count", PAIRS + rf"SELECT pair_id, CAST(len(regexp_extract_all(smi, '{AP}')) AS BIGINT) AS n_points FROM p")
def ap_count(spark, sf):
    return _pairs(spark, sf).select("pair_id", attach.count_points(F.col("smi")).cast("bigint").alias("n_points"))


@query("pack_unpack", "WITH " + fx.sql("fx_pair") + rf""", p AS (SELECT pair_id, scaffold, concat(decoration, '|', decoration, '|[*]C') AS packed FROM fx_pair)
    SELECT pair_id, replace(packed, '|', ';') AS listed, CAST(len(string_split(packed, '|')) AS BIGINT) AS n_parts,
           len(string_split(packed, '|')) = len(regexp_extract_all(scaffold, '{AP}')) AS fits,
           string_split(packed, '|')[3] AS last_part FROM p""")
def pack_unpack(spark, sf):
    pairs = fx.view(spark, sf, "fx_pair")
    packed = attach.pack_single(F.array("decoration", "decoration", F.lit("[*]C")))
    rows = pairs.select("pair_id", "scaffold", packed.alias("packed"))
    listed = attach.pack_list(attach.unpack_single(F.col("packed")))
    return rows.select(
        "pair_id", listed.alias("listed"), F.size(attach.unpack_list(listed)).cast("bigint").alias("n_parts"),
        attach.arity_matches(F.col("scaffold"), F.col("packed")).alias("fits"),
        F.get(attach.unpack_single(F.col("packed")), F.lit(2)).alias("last_part"))


@query("tokenize", "WITH " + fx.sql("fx_train") + rf""", t AS (
    SELECT pair_id AS id, concat(scaffold, '.', decoration) AS text FROM fx_train
    UNION ALL SELECT CAST(doc_id AS VARCHAR), text FROM documents),
    k AS (SELECT id, regexp_extract_all(text, '{TOK}') AS l FROM t)
    SELECT id, CAST(len(l) + 2 AS BIGINT) AS n_tokens, md5(concat('^', chr(1), array_to_string(l, chr(1)), chr(1), '$')) AS digest FROM k""")
def tokenize(spark, sf):
    train = fx.view(spark, sf, "fx_train").select(
        F.col("pair_id").alias("id"), F.concat_ws(".", "scaffold", "decoration").alias("text"))
    docs = fx.table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("id"), "text")
    rows = train.unionByName(docs).select("id", tokens.tokenize(F.col("text")).alias("tokens"))
    return rows.select("id", F.size("tokens").cast("bigint").alias("n_tokens"),
                       F.md5(F.array_join("tokens", "\x01")).alias("digest"))


@query("untokenize", "WITH " + fx.sql("fx_train") + """
    SELECT pair_id, decoration AS whole, string_split(decoration, 'C')[1] AS upto_end FROM fx_train""")
def untokenize(spark, sf):
    rows = fx.view(spark, sf, "fx_train")
    marked = F.transform(tokens.tokenize(F.col("decoration")), lambda t: F.when(t.startswith("C"), F.lit("$")).otherwise(t))
    return rows.select("pair_id", tokens.untokenize(tokens.tokenize(F.col("decoration"))).alias("whole"),
                       tokens.untokenize(marked).alias("upto_end"))


@query("decorations_map", "WITH " + fx.sql("fx_round") + """
    SELECT smiles, point, decoration, scaffold,
           CASE WHEN point = 0 THEN concat('0=', decoration, ';1=b') WHEN point = 1 THEN concat('0=a;1=', decoration)
                ELSE concat('0=a;1=b;2=', decoration) END AS entries,
           CASE WHEN point = 0 THEN concat(decoration, ';b') WHEN point = 1 THEN concat('a;', decoration)
                ELSE concat('a;b;', decoration) END AS by_point,
           CASE WHEN point = 0 THEN concat('5=', decoration, ';6=b') WHEN point = 1 THEN concat('5=a;6=', decoration)
                ELSE concat('5=a;6=b;7=', decoration) END AS rekeyed FROM fx_round""")
def decorations_map(spark, sf):
    rows = fx.view(spark, sf, "fx_round")
    base = attach.zip_map(F.array(F.lit(1), F.lit(0), F.lit(9)), F.array(F.lit("b"), F.lit("a")))
    rows = rows.withColumn("m", attach.add_entry(base, F.col("point"), F.col("decoration")))
    remap = F.create_map(*[F.lit(x) for x in (0, 5, 1, 6, 2, 7)])

    def entries(m):
        return F.array_join(F.transform(F.array_sort(F.map_entries(m)),
                                        lambda e: F.concat(e["key"].cast("string"), F.lit("="), e["value"])), ";")

    return rows.select("smiles", "point", "decoration", "scaffold", entries(F.col("m")).alias("entries"),
                       F.array_join(attach.values_by_point(F.col("m")), ";").alias("by_point"),
                       entries(attach.rekey(F.col("m"), remap)).alias("rekeyed"))


@query("numbered_map", "WITH " + fx.sql("fx_round") + """
    SELECT smiles, scaffold, decoration, CASE WHEN decoration LIKE '%*%'
        THEN concat('3=', regexp_replace(decoration, '\\[\\*\\]|\\*', '[*]'), ';8=[*]O') ELSE '8=[*]O' END AS entries,
        CASE WHEN decoration LIKE '%*%' THEN '' ELSE decoration END AS left_out FROM fx_round""")
def numbered_map(spark, sf):
    rows = fx.view(spark, sf, "fx_round")
    pair = F.array(attach.number_first(F.col("decoration"), 3), F.lit("[*:8]O"))
    entries = F.transform(F.array_sort(F.map_entries(attach.map_by_number(pair))),
                          lambda e: F.concat(e["key"].cast("string"), F.lit("="), e["value"]))
    return rows.select("smiles", "scaffold", "decoration", F.array_join(entries, ";").alias("entries"),
                       F.array_join(attach.unnumbered(pair), ";").alias("left_out"))


@query("merged_labels", "WITH " + fx.sql("fx_round") + """
    SELECT smiles, scaffold, point, CASE point WHEN 0 THEN '0,10,2' WHEN 1 THEN '1,10,2' ELSE '10,2' END AS labels FROM fx_round""")
def merged_labels(spark, sf):
    rows = fx.view(spark, sf, "fx_round")
    labels = attach.merge_labels(F.array(F.lit("2"), F.lit("10"), F.lit("2")), F.col("point"))
    return rows.select("smiles", "scaffold", "point", F.array_join(labels, ",").alias("labels"))
