"""Registered queries of the training-data operators: each over its whole table, with production parameters."""

from pyspark.sql import functions as F

from ..operators.lineage import new_path
from . import (bpe, decontaminate, hard_negatives, html_text, lexical_search, license_scan, oracles, ordinal, phrases, quality, secret_scan,
               sharding, simhash, warc)

LLM_QUERIES, LLM_ORACLES = {}, {}
SHARDS = 24
RANKS = "byte_bpe_50k.tiktoken"


def query(name: str, oracle: str = None):
    def add(fn):
        LLM_QUERIES[name] = fn
        if oracle:
            LLM_ORACLES[name] = oracle
        return fn
    return add


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_rendezvous_sharding", oracles.RENDEZVOUS)
def rendezvous_sharding(spark, sf_dir):
    """Law `key`: doc_id and the number of shards decide; one more shard takes rows only into itself."""
    rows = sharding.sized(table(spark, sf_dir, "documents"))
    columns = ["doc_id", "size", "text_crc32"]
    placed = sharding.slots(sharding.assign(rows, dict.fromkeys(range(SHARDS), 1.0)), columns)
    grown = sharding.assign(placed, dict.fromkeys(range(SHARDS + 1), 1.0), name="grown_shard")
    return grown.select(*columns, F.lit("key").alias("law"), "shard", "slot", "grown_shard")


@query("op2_warc_round_trip", oracles.WARC)
def warc_round_trip(spark, sf_dir):
    path = new_path(spark, "warc")
    warc.archive(table(spark, sf_dir, "pages"), path)
    heads = ["record_id", "record_type", "refers_to", "payload_digest", "payload_bytes"]
    full = warc.read(spark, path, [*heads, "payload"]).where("record_type = 'response'")  # both filters reach the reader
    again = warc.read(spark, path, heads).where("record_type = 'revisit'")  # no block is inflated

    def number(urn):
        return F.regexp_extract(urn, r"^urn:page:(-?\d+)$", 1).try_cast("bigint")

    sized = F.octet_length("payload").cast("bigint").alias("payload_bytes")
    found = full.select("record_id", "record_type", "refers_to", warc.base32(F.upper(F.sha1("payload"))).alias("payload_digest"), sized)
    return found.unionByName(again).select(
        number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to"))


#: Grades of the classifier: 0 low quality, 1 fair text that is toxic, 2 good.  Kept: P(grade >= 2) at least this.
GRADES, TAIL = 3, 0.5


@query("op3_ordinal_quality")
def ordinal_quality(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    grade = F.when(F.col("quality") == 0, 0).when(F.col("toxic") == 1, 1).when(F.col("quality") == 1, 2)
    rated = table(spark, sf_dir, "labels").select("doc_id", grade.alias("grade"))
    model = ordinal.fit(docs, GRADES, rated)
    return ordinal.grade(docs, model, GRADES - 1, keep=["doc_id"]).withColumn("kept", F.col("tail_probability") >= TAIL)


def joined_spans(spans):
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


@query("op4_secret_scan")
def scan_secrets(spark, sf_dir):
    rows = secret_scan.scan(table(spark, sf_dir, "documents").select("doc_id", "text"), keep=["doc_id"])

    def of(kind):
        return F.filter("secrets", lambda s: s["kind"] == kind)

    base = F.filter("secrets", lambda s: s["kind"] != "random")
    return rows.select("doc_id", *[F.size(of(k)).cast("bigint").alias(f"n_{k}") for k in secret_scan.KINDS],
                       F.sha2(joined_spans(base).cast("binary"), 256).alias("base_sha256"), joined_spans(F.col("secrets")).alias("spans"))


@query("op5_simhash_near_dedup")
def simhash_near_dedup(spark, sf_dir):
    rows = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


@query("op6_benchmark_decontamination", oracles.DECONTAMINATION)
def benchmark_decontamination(spark, sf_dir):
    rows = decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    pairs = F.sequence(F.lit(0), F.size("hit_spans") - 2, F.lit(2))
    n_hit = F.when(F.size("hit_spans") > 0, F.aggregate(
        F.transform(pairs, lambda i: F.get("hit_spans", i + 1) - F.get("hit_spans", i)), F.lit(0).cast("bigint"), lambda a, b: a + b))
    n_hit = F.coalesce(n_hit, F.lit(0)).cast("bigint")
    return rows.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("hit_items").cast("bigint").alias("n_items"),
                       F.sha2(F.array_join("hit_items", ",").cast("binary"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
                       "longest_match")


@query("op7_quality_rules", oracles.QUALITY)
def quality_rules(spark, sf_dir):
    return quality.rated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op8_html_extraction")
def html_extraction(spark, sf_dir):
    rows = html_text.extract(table(spark, sf_dir, "pages"), keep=["page_id", "url"])
    return rows.withColumn("n_chars", F.length("text").cast("bigint"))


@query("op9_byte_bpe")
def byte_bpe(spark, sf_dir):
    import public_tokenizers as public

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe_digests(docs, public.path(RANKS), public.PATTERN)


def bpe_digests(docs, path, pattern, **options):
    rows = bpe.encode(docs, "text", path, pattern, keep=["doc_id"], back=True, **options)
    return rows.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@query("op10_repeated_phrases", oracles.PHRASES)
def repeated_phrases(spark, sf_dir):
    return phrases.without_repeats(table(spark, sf_dir, "documents"))


@query("op11_lexical_search", oracles.LEXICAL)
def ranked_lexical_search(spark, sf_dir):
    return lexical_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op12_hard_negatives", oracles.HARD_NEGATIVES)
def hard_negative_mining(spark, sf_dir):
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(table(spark, sf_dir, "embeddings").withColumn("label", label), F.col("vec_id") % 100 == 0)


@query("op13_license_scan", oracles.LICENSES)
def scan_licenses(spark, sf_dir):
    return license_scan.scan(table(spark, sf_dir, "documents"), keep=["doc_id"]).drop("license_spans")
