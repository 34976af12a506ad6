"""Queries of dedup, merge and distribution statistics."""

from pyspark.sql import functions as F

from ..operators import merge, stats
from ..sources import writers
from . import fixtures as fx
from .registry import query

ROUND = "WITH " + fx.sql("fx_round") + """, r AS (SELECT round_no, smiles, scaffold, concat(point, '=', decoration) AS d, point, decoration FROM fx_round) """
# structs compare field by field, like the rank of the engine
DEDUP = ROUND + """, dedup AS (SELECT round_no, smiles, min(struct_pack(s := scaffold, p := point, d := decoration)) AS b, count(*) AS n FROM r GROUP BY round_no, smiles) """


def _rows(spark, sf):
    rows = fx.view(spark, sf, "fx_round")
    return rows.select("round_no", "smiles", "scaffold", F.create_map("point", "decoration").alias("decorations"))


def _flat(df):
    entry = F.get(F.map_entries("decorations"), F.lit(0))
    return df.withColumn("decorations", F.concat_ws("=", entry["key"].cast("string"), entry["value"]))


@query("dedup_counts", DEDUP.replace("round_no, smiles, min", "smiles, min").replace("GROUP BY round_no, smiles", "GROUP BY smiles") + """
    SELECT smiles, b.s AS scaffold, concat(b.p, '=', b.d) AS decorations, n AS "count" FROM dedup""")
def dedup_counts(spark, sf):
    return _flat(merge.dedup(_rows(spark, sf)))


def _rounds(spark, sf):
    rows = _rows(spark, sf)
    return [merge.dedup(rows.where(F.col("round_no") == i)) for i in range(3)]


@query("merge_counts", DEDUP + """
    , m AS (SELECT smiles, min(struct_pack(i := round_no, b := b)) AS m, sum(n) AS n FROM dedup GROUP BY smiles)
    SELECT smiles, m.b.s AS scaffold, concat(m.b.p, '=', m.b.d) AS decorations, CAST(n AS BIGINT) AS "count" FROM m""")
def merge_counts(spark, sf):
    return _flat(merge.merge(_rounds(spark, sf)))


@query("total_count", ROUND + "SELECT count(*) AS total, count(DISTINCT smiles) AS n_molecules FROM r")
def total_count(spark, sf):
    merged = merge.merge(_rounds(spark, sf))
    return merged.agg(F.sum("count").alias("total"), F.countDistinct("smiles").alias("n_molecules"))


@query("frontier", DEDUP + """
    , old AS (SELECT DISTINCT smiles FROM r WHERE round_no = 0 AND length(smiles) % 2 = 0)
    SELECT d.smiles, d.b.s AS scaffold, concat(d.b.p, '=', d.b.d) AS decorations FROM dedup d ANTI JOIN old ON d.smiles = old.smiles
    WHERE d.round_no = 1 AND d.smiles LIKE '%*%'""")
def frontier(spark, sf):
    fresh = _rounds(spark, sf)[1]
    old = _rounds(spark, sf)[0].where(F.length("smiles") % 2 == 0).select("smiles")
    return _flat(merge.frontier(fresh, old))


@query("results_csv", ROUND + """SELECT smiles, scaffold, concat('{"', point, '":"', decoration, '"}') AS decorations FROM r""")
def results_csv(spark, sf):
    return writers.results_csv(_rows(spark, sf).drop("round_no"))


NLL = "WITH " + fx.sql("fx_nll")
BIN = """CASE WHEN nll < g * 0.1::DOUBLE THEN g - 1 WHEN nll >= (g + 1) * 0.1::DOUBLE AND g <> 999 THEN g + 1 ELSE g END"""
PLACED = """, q AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY event_id) AS pos FROM fx_nll),
    t AS (SELECT * FROM q WHERE pos <= (SELECT min(n) FROM (SELECT count(*) AS n FROM fx_nll GROUP BY grp))) """


def hist_sql(source, name="h"):
    return f""", g_{name} AS (SELECT grp, nll, CAST(least(floor(nll * 10.0::DOUBLE), 999) AS INT) AS g FROM {source} WHERE nll BETWEEN 0 AND 100),
    b_{name} AS (SELECT grp, {BIN} AS bin, count(*) AS n FROM g_{name} GROUP BY ALL),
    f_{name} AS (SELECT grp, CAST(r.bin AS INT) AS bin, coalesce(b.n, 1) AS n FROM (SELECT DISTINCT grp FROM {source}) s CROSS JOIN range(0, 1000) r(bin)
          LEFT JOIN b_{name} b USING (grp, bin)),
    {name} AS (SELECT grp, bin, n, n / sum(n) OVER (PARTITION BY grp) AS p FROM f_{name}) """


def jsd_sql(source, at):
    return f"""WITH norm AS (SELECT grp, sum(p) AS s FROM {source} GROUP BY grp),
    avgd AS (SELECT {at}, sum(p) AS q FROM {source} GROUP BY {at}),
    tot AS (SELECT sum(s) AS a, count(*) AS n_grp FROM norm)
    SELECT round(sum(CASE WHEN p > 0 THEN p / s * ln((p / s) / (q / a)) ELSE 0 END) / max(n_grp), 6) AS jsd
    FROM {source} JOIN norm USING (grp) JOIN avgd USING ({at}), tot"""


def _nll(spark, sf):
    return fx.view(spark, sf, "fx_nll")


@query("nll_moments", NLL + " SELECT grp, round(avg(nll), 6) AS mean_nll, round(var_pop(nll), 6) AS var_nll FROM fx_nll GROUP BY grp")
def nll_moments(spark, sf):
    return stats.moments(_nll(spark, sf)).select(
        "grp", F.round("mean_nll", 6).alias("mean_nll"), F.round("var_nll", 6).alias("var_nll"))


@query("nll_metrics", NLL + """ SELECT concat('nll/avg.', grp) AS metric, round(avg(nll), 6) AS value FROM fx_nll GROUP BY grp
    UNION ALL SELECT concat('nll/var.', grp), round(var_pop(nll), 6) FROM fx_nll GROUP BY grp""")
def nll_metrics(spark, sf):
    long = stats.moments(_nll(spark, sf)).select("grp", F.expr("stack(2, 'avg', mean_nll, 'var', var_nll) AS (what, value)"))
    return long.select(F.concat(F.lit("nll/"), "what", F.lit("."), "grp").alias("metric"), F.round("value", 6).alias("value"))


@query("nll_hist", NLL + hist_sql("fx_nll") + "SELECT grp, bin, n, round(p, 9) AS p FROM h")
def nll_hist(spark, sf):
    return stats.histogram(_nll(spark, sf)).withColumn("p", F.round("p", 9))


@query("first_rows", NLL + PLACED + "SELECT event_id, grp, CAST(pos AS BIGINT) AS pos FROM t")
def first_rows(spark, sf):
    return stats.truncated(_nll(spark, sf), ["event_id"]).select("event_id", "grp", "pos")


@query("jsd_binned", NLL + PLACED + hist_sql("t") + "SELECT * FROM (" + jsd_sql("h", "bin") + ")")
def jsd_binned(spark, sf):
    rows = stats.truncated(_nll(spark, sf), ["event_id"])
    return stats.jsd_binned(rows).select(F.round("jsd", 6).alias("jsd"))


@query("jsd_raw", NLL + PLACED + ", v AS (SELECT grp, pos, nll AS p FROM t) SELECT * FROM (" + jsd_sql("v", "pos") + ")")
def jsd_raw(spark, sf):
    rows = stats.truncated(_nll(spark, sf), ["event_id"])
    return stats.jsd_raw(rows).select(F.round("jsd", 6).alias("jsd"))


@query("sample_rows", NLL + " SELECT event_id, grp, nll FROM fx_nll ORDER BY md5(concat_ws('|', '3', CAST(event_id AS VARCHAR))), event_id LIMIT 500")
def sample_rows(spark, sf):
    return stats.sample_rows(_nll(spark, sf), 500, ["event_id"], 3)


@query("validity", NLL + """ SELECT grp, round(100.0 * count(*) FILTER (nll <= 100) / 5000, 6) AS valid_percent, count(*) AS n_scored FROM fx_nll GROUP BY grp""")
def validity(spark, sf):
    rows = _nll(spark, sf).withColumn("smiles", F.when(F.col("nll") <= 100, "C"))
    return stats.validity(rows, 5000).withColumn("valid_percent", F.round("valid_percent", 6))
