"""Queries of the token model: fit, score, sample, and the lines written from them."""

from pyspark.sql import functions as F

from ..operators import dataset, tokenmodel
from ..operators.lineage import materialise, new_path
from ..plans import jobs, quality
from ..sources import readers, writers
from . import fixtures as fx
from .registry import query
from .statistics import hist_sql, jsd_sql
from .text import TOK


def _events(source, key, n=""):
    """Token events ev<n> of (key, scaffold, decoration) rows: near, h1, h2, token."""
    return rf""", st{n} AS (SELECT {key}, decoration, regexp_extract_all(scaffold, '{TOK}') AS s FROM {source}),
    spot{n} AS (SELECT *, list_position([regexp_full_match(x, '\*|\[\*.*\]') for x in s], true) AS i FROM st{n}),
    body{n} AS (SELECT {key}, CASE WHEN i > 0 THEN coalesce(s[i + 1], s[nullif(i - 1, 0)], '') ELSE '' END AS near,
             list_concat(regexp_extract_all(decoration, '{TOK}'), ['$']) AS l FROM spot{n}),
    pos{n} AS (SELECT {key}, near, l, unnest(range(1, len(l) + 1)) AS i FROM body{n}),
    ev{n} AS (SELECT {key}, near, CASE WHEN i > 2 THEN l[i - 2] ELSE '^' END AS h1, CASE WHEN i > 1 THEN l[i - 1] ELSE '^' END AS h2, l[i] AS token FROM pos{n}) """


MODEL = fx.sql("fx_train") + _events("fx_train", "pair_id") + """,
    gram AS (SELECT near, h1, h2, token, count(*) AS n FROM ev GROUP BY ALL),
    alphabet AS (SELECT count(DISTINCT token) AS v FROM gram),
    model AS (SELECT *, CAST(sum(n) OVER (PARTITION BY near, h1, h2) AS BIGINT) AS n_context FROM gram) """
P = "((coalesce(m.n, 0) + 1.0::DOUBLE) / (coalesce(c.n_context, 0) + 1.0::DOUBLE * v))"


def _model(spark, sf):
    return tokenmodel.fit(fx.view(spark, sf, "fx_train"))


@query("token_model", "WITH " + MODEL + """SELECT concat_ws(' ', h1, h2, near) AS context, token, n, n_context,
    v AS n_tokens, round(ln((n + 1.0::DOUBLE) / (n_context + 1.0::DOUBLE * v)), 6) AS logp FROM model, alphabet""")
def token_model(spark, sf):
    return _model(spark, sf).select(F.array_join("context", " ").alias("context"), "token", "n", "n_context", "n_tokens",
                                    F.round("logp", 6).alias("logp"))


# scored pairs: the scaffolds and decorations of fx_pair against the model of fx_train
SCORED = MODEL + ", " + fx.sql("fx_pair") + _events("fx_pair", "pair_id", 2) + f""",
    scored AS (SELECT e.pair_id, sum(-ln({P})) AS nll, bool_or(k.token IS NULL) AS oov
        FROM ev2 e LEFT JOIN (SELECT DISTINCT token FROM gram) k ON k.token = e.token
        LEFT JOIN (SELECT DISTINCT near, h1, h2, n_context FROM model) c ON c.near = e.near AND c.h1 = e.h1 AND c.h2 = e.h2
        LEFT JOIN model m ON m.near = e.near AND m.h1 = e.h1 AND m.h2 = e.h2 AND m.token = e.token, alphabet GROUP BY e.pair_id) """


def _scored(spark, sf):
    return tokenmodel.score(fx.view(spark, sf, "fx_pair"), _model(spark, sf))


@query("nll_scores", "WITH " + SCORED + "SELECT pair_id, scaffold, decoration, oov, CASE WHEN NOT oov THEN round(nll, 6) END AS nll FROM scored JOIN fx_pair USING (pair_id)")
def nll_scores(spark, sf):
    return _scored(spark, sf).withColumn("nll", F.round("nll", 6))


@query("nll_training", "WITH " + MODEL + f"""SELECT pair_id, round(sum(-ln({P.replace('c.n_context', 'm.n_context')})), 6) AS nll
    FROM ev e JOIN model m USING (near, h1, h2, token), alphabet GROUP BY pair_id""")
def nll_training(spark, sf):
    scored = tokenmodel.score(fx.view(spark, sf, "fx_train"), _model(spark, sf))
    return scored.select("pair_id", F.round("nll", 6).alias("nll"))


@query("nll_lines", "WITH " + SCORED + """SELECT concat_ws(chr(9), scaffold, decoration, pair_id, CASE WHEN oov THEN '' ELSE printf('%.6f', round(nll, 6)) END) AS line
    FROM scored JOIN fx_pair USING (pair_id)""")
def nll_lines(spark, sf):
    # two digits fewer than the file format, so that both engines' last digits agree
    line = F.regexp_replace(writers.scored_line(["scaffold", "decoration", "pair_id"]), r"(\.\d{6})\d\d$", "$1")
    return _scored(spark, sf).withColumn("nll", F.round("nll", 6)).select(line.alias("line"))


@query("nll_batch_mean", "WITH " + MODEL + """, t AS (SELECT pair_id, sum(-ln((n + 1.0::DOUBLE) / (n_context + 1.0::DOUBLE * v))) AS nll
        FROM ev JOIN model USING (near, h1, h2, token), alphabet GROUP BY pair_id),
    spread AS (SELECT *, md5(concat_ws('|', '7', pair_id, CAST(epoch AS VARCHAR))) AS h FROM t, range(1, 3) e(epoch)),
    placed AS (SELECT *, CAST(floor((row_number() OVER (PARTITION BY epoch ORDER BY h, pair_id) - 1) / 128) AS BIGINT) AS batch FROM spread)
    SELECT CAST(epoch AS INT) AS epoch, batch, round(avg(nll), 6) AS loss FROM placed
    WHERE batch < (SELECT floor(count(*) / 128) FROM t) GROUP BY ALL""")
def nll_batch_mean(spark, sf):
    scored = materialise(tokenmodel.score(fx.view(spark, sf, "fx_train"), _model(spark, sf)).select("pair_id", "nll"))
    return tokenmodel.batch_mean(dataset.batches(scored, "pair_id", 2, 128, 7)).withColumn("loss", F.round("loss", 6))


# A draw walks the dense table of running probabilities; '?' stands for an unseen context.
SAMPLED = MODEL + ", " + fx.sql("fx_scaffold") + rf""",
    toks AS (SELECT token, row_number() OVER (ORDER BY token) AS j FROM (SELECT DISTINCT token FROM gram)),
    ctx AS (SELECT DISTINCT concat_ws(' ', h1, h2, near) AS c, n_context AS t FROM model UNION ALL SELECT '?', 0),
    dense AS (SELECT c, t, k.token, j, coalesce(n, 0) AS n,
              sum(coalesce(n, 0)) OVER (PARTITION BY c ORDER BY j) AS run FROM ctx CROSS JOIN toks k
              LEFT JOIN (SELECT concat_ws(' ', h1, h2, near) AS c, token, n FROM model) m USING (c, token)),
    walk AS (SELECT c, token, (run + 1.0::DOUBLE * j) / (t + 1.0::DOUBLE * v) AS hi,
             coalesce(lag((run + 1.0::DOUBLE * j) / (t + 1.0::DOUBLE * v)) OVER (PARTITION BY c ORDER BY j), -1) AS lo,
             -ln((n + 1.0::DOUBLE) / (t + 1.0::DOUBLE * v)) AS nll FROM dense, alphabet),
    sst AS (SELECT scaffold_id, regexp_extract_all(scaffold, '{TOK}') AS s FROM fx_scaffold),
    sat AS (SELECT *, list_position([regexp_full_match(x, '\*|\[\*.*\]') for x in s], true) AS i FROM sst),
    start AS (SELECT scaffold_id, CAST(draw AS INT) AS draw, CASE WHEN i > 0 THEN coalesce(s[i + 1], s[nullif(i - 1, 0)], '') ELSE '' END AS near,
              ('0x' || substr(md5(concat_ws('|', '5', CAST(scaffold_id AS VARCHAR), CAST(draw AS VARCHAR))), 1, 8))::BIGINT % 2147483646 + 1 AS state
              FROM sat, range(1, 4) d(draw)),
    path AS (SELECT scaffold_id, draw, near, state, '^' AS h1, '^' AS h2, '' AS decoration, 0.0::DOUBLE AS nll, 0 AS step FROM start
      UNION ALL SELECT p.scaffold_id, p.draw, p.near, p.state * 48271 % 2147483647, p.h2, w.token,
             concat(p.decoration, CASE WHEN w.token = '$' THEN '' ELSE w.token END), p.nll + w.nll, p.step + 1
      FROM path p LEFT JOIN ctx x ON x.c = concat_ws(' ', p.h1, p.h2, p.near)
      JOIN walk w ON w.c = coalesce(x.c, '?') AND w.hi > (p.state * 48271 % 2147483647) / 2147483647.0::DOUBLE
                 AND w.lo <= (p.state * 48271 % 2147483647) / 2147483647.0::DOUBLE
      WHERE p.h2 <> '$' AND p.step < 39) """


@query("sampled_decorations", "WITH RECURSIVE " + SAMPLED + """
    SELECT scaffold_id, draw, decoration, round(nll, 6) AS nll FROM path WHERE h2 = '$' OR step = 39""")
def sampled_decorations(spark, sf):
    scaffolds = fx.view(spark, sf, "fx_scaffold")
    drawn = tokenmodel.sample(scaffolds, _model(spark, sf), 3, max_len=40, seed=5, key=["scaffold_id"])
    return drawn.select("scaffold_id", "draw", "decoration", F.round("nll", 6).alias("nll"))


@query("sampled_decorations_whole", "WITH RECURSIVE " + SAMPLED.replace("p.step < 39", "p.step < 255") + """
    SELECT scaffold_id, draw, decoration, round(nll, 6) AS nll, h2 = '$' AS finished FROM path WHERE h2 = '$' OR step = 255""")
def sampled_decorations_whole(spark, sf):
    """The same draws at the default length, each marked as ended or cut off."""
    drawn = tokenmodel.sample(fx.view(spark, sf, "fx_scaffold"), _model(spark, sf), 3, seed=5, key=["scaffold_id"])
    return drawn.select("scaffold_id", "draw", "decoration", F.round("nll", 6).alias("nll"), "finished")


# Draws of lines: equal scaffold lines are numbered, and each has a draw of its own.
_LINES = SAMPLED.replace("FROM fx_scaffold)", """FROM (SELECT scaffold, concat_ws('|', scaffold, CAST(row_number() OVER (PARTITION BY scaffold) AS VARCHAR)) AS scaffold_id
    FROM fx_scaffold))""").replace("range(1, 4) d(draw)", "range(1, 2) d(draw)").replace("p.step < 39", "p.step < 255")


@query("sample_job", "WITH RECURSIVE " + _LINES + """
    SELECT regexp_replace(scaffold_id, '\\|\\d+$', '') AS scaffold, decoration, round(CAST(printf('%.8f', nll) AS DOUBLE), 6) AS nll FROM path WHERE h2 = '$' OR step = 255""")
def sample_job(spark, sf):
    """From a compressed file of scaffold lines to a file of samples with their scores, read back."""
    folder = new_path(spark, "samples")
    fx.view(spark, sf, "fx_scaffold").select(F.concat(F.col("scaffold"), F.lit("\tname ")).alias("value")).write.option("compression", "gzip").text(f"{folder}/in")
    jobs.samples(spark, f"{folder}/in", _model(spark, sf), f"{folder}/out", with_nll=True, gzip=True, seed=5)
    return readers.read_pairs(spark, f"{folder}/out").select("scaffold", "decoration", F.round(F.col("rest").cast("double"), 6).alias("nll"))


# Statistics of one epoch, from two different sets.  The model sees every token before (order 40) and hardly smooths, so its
# draws are decorations of the training set; one of them cannot be read, and one of the validation set has an unknown token.
_SETS = "WITH RECURSIVE " + fx.sql("fx_train", "fx_check") + """,
    train AS (SELECT pair_id, scaffold, CASE WHEN pair_id LIKE '%7' THEN '[*]C(' ELSE decoration END AS decoration FROM fx_train) """
_ORDER, _ALPHA, _SIZE = 40, 1e-9, 400


def _prefixes(source, n):
    """Token events of a source whose context is the whole text before the token."""
    return rf""", ws{n} AS (SELECT pair_id, regexp_extract_all(scaffold, '{TOK}') AS s, list_concat(regexp_extract_all(decoration, '{TOK}'), ['$']) AS l FROM {source}),
    wi{n} AS (SELECT *, list_position([regexp_full_match(x, '\*|\[\*.*\]') for x in s], true) AS i FROM ws{n}),
    we{n} AS (SELECT pair_id, near, unnest(range(0, len(l))) AS k, l FROM (SELECT *, CASE WHEN i > 0 THEN coalesce(s[i + 1], s[nullif(i - 1, 0)], '') ELSE '' END AS near FROM wi{n})),
    wp{n} AS (SELECT pair_id, concat(near, ' ', array_to_string(l[1:k], '')) AS c, l[k + 1] AS token FROM we{n}) """


QUALITY = _SETS + _prefixes("train", 1) + f""", g AS (SELECT c, token, count(*) AS n FROM wp1 GROUP BY ALL),
    toks AS (SELECT token, row_number() OVER (ORDER BY token) AS j FROM (SELECT DISTINCT token FROM g)),
    size AS (SELECT count(*) AS v FROM toks),
    ctx AS (SELECT c, sum(n) AS t FROM g GROUP BY c UNION ALL SELECT '?', 0),
    dense AS (SELECT c, t, k.token, j, coalesce(n, 0) AS n, sum(coalesce(n, 0)) OVER (PARTITION BY c ORDER BY j) AS run
              FROM ctx CROSS JOIN toks k LEFT JOIN g USING (c, token)),
    walk AS (SELECT c, token, (run + {_ALPHA}::DOUBLE * j) / (t + {_ALPHA}::DOUBLE * v) AS hi,
             coalesce(lag((run + {_ALPHA}::DOUBLE * j) / (t + {_ALPHA}::DOUBLE * v)) OVER (PARTITION BY c ORDER BY j), -1) AS lo,
             -ln((n + {_ALPHA}::DOUBLE) / (t + {_ALPHA}::DOUBLE * v)) AS nll FROM dense, size),
    sets AS (SELECT 'training' AS name, * FROM train UNION ALL SELECT 'validation', * FROM fx_check),
    chosen AS (SELECT * FROM sets QUALIFY row_number() OVER (PARTITION BY name ORDER BY md5(concat_ws('|', '3', pair_id)), pair_id) <= {_SIZE})""" + _prefixes(
    "(SELECT concat(name, ':', pair_id) AS pair_id, scaffold, decoration FROM chosen)", 2) + f""",
    observed AS (SELECT e.pair_id, sum(w.nll) AS nll, bool_or(k.token IS NULL) AS oov FROM wp2 e LEFT JOIN toks k USING (token)
        LEFT JOIN ctx x USING (c) LEFT JOIN walk w ON w.c = coalesce(x.c, '?') AND w.token = e.token GROUP BY e.pair_id),
    path AS (SELECT DISTINCT pair_id, near, '' AS d, false AS ended, 0.0::DOUBLE AS nll,
             ('0x' || substr(md5(concat_ws('|', '3', split_part(pair_id, ':', 2), '1')), 1, 8))::BIGINT % 2147483646 + 1 AS state FROM we2
      UNION ALL SELECT p.pair_id, p.near, CASE WHEN w.token = '$' THEN p.d ELSE concat(p.d, w.token) END, w.token = '$', p.nll + w.nll, p.state * 48271 % 2147483647
      FROM path p LEFT JOIN ctx x ON x.c = concat(p.near, ' ', p.d)
      JOIN walk w ON w.c = coalesce(x.c, '?') AND w.hi > (p.state * 48271 % 2147483647) / 2147483647.0::DOUBLE
                 AND w.lo <= (p.state * 48271 % 2147483647) / 2147483647.0::DOUBLE WHERE NOT p.ended),
    rows AS (SELECT split_part(pair_id, ':', 1) AS grp, split_part(pair_id, ':', 2) AS id, nll, false AS valid FROM observed WHERE NOT oov
             UNION ALL SELECT concat('sampled_', split_part(pair_id, ':', 1)), split_part(pair_id, ':', 2), nll, d <> '[*]C(' FROM path WHERE ended),
    q AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY md5(concat_ws('|', '3', id))) AS pos FROM rows),
    t AS (SELECT * FROM q WHERE pos <= (SELECT min(n) FROM (SELECT count(*) AS n FROM q GROUP BY grp))) """ + hist_sql("q") + hist_sql("t", "h_first") + f""", v AS (SELECT grp, pos, nll AS p FROM t)
    SELECT concat('nll/avg.', grp) AS metric, NULL::INT AS bin, round(avg(nll), 6) AS value FROM q GROUP BY grp
    UNION ALL SELECT concat('nll/var.', grp), NULL, round(var_pop(nll), 6) FROM q GROUP BY grp
    UNION ALL SELECT concat('valid_', substr(grp, 9)), NULL, round(100.0 * count(*) FILTER (valid) / {_SIZE}, 6) FROM q WHERE grp LIKE 'sampled%' GROUP BY grp
    UNION ALL SELECT 'nll_plot/jsd_joined_bins', NULL, jsd FROM ({jsd_sql("h_first", "bin")})
    UNION ALL SELECT 'nll_plot/jsd_joined_no_bins', NULL, jsd FROM ({jsd_sql("v", "pos")})
    UNION ALL SELECT 'lr', NULL, 0.001
    UNION ALL SELECT concat('nll_plot/', grp), bin, round(p, 6) FROM h"""


@query("quality_metrics", QUALITY)
def quality_metrics(spark, sf):
    """Metrics (bin NULL) and histograms of one epoch."""
    train = fx.view(spark, sf, "fx_train").withColumn("decoration", F.when(F.col("pair_id").endswith("7"), "[*]C(").otherwise(F.col("decoration")))
    model = tokenmodel.fit(train, _ORDER, _ALPHA)
    metrics, histograms = quality.collect(train, fx.view(spark, sf, "fx_check"), materialise(model), _SIZE, 1, order=_ORDER, seed=3,
                                          key=["pair_id"], other_values={"lr": 0.001})
    return metrics.select("metric", F.lit(None).cast("int").alias("bin"), F.round("value", 6).alias("value")).unionByName(
        histograms.select("metric", "bin", F.round("p", 6).alias("value")))


@query("scheduled_epochs", """SELECT CAST(epoch AS INT) AS epoch, (epoch - 1) % 3 AS set_no, count(*) AS n_rows
    FROM lineitem, range(1, 13) e(epoch) WHERE epoch % 4 = 0 AND l_linenumber % 3 = (epoch - 1) % 3 GROUP BY ALL""")
def scheduled_epochs(spark, sf):
    epochs = quality.scheduled(spark.range(1, 13).select(F.col("id").cast("int").alias("epoch")), 4)
    sets = fx.table(spark, sf, "lineitem").select((F.col("l_linenumber") % 3).cast("bigint").alias("set_no"))
    return dataset.assign_sets(epochs, sets).groupBy("epoch", "set_no").agg(F.count(F.lit(1)).alias("n_rows"))
