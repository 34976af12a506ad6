"""Quality rules with risk-controlled thresholds, in plain Column functions.

Every rule is a score of a text, the higher the worse.  Cutoffs come from labelled texts: for
each stratum and rule, cutoffs are tested from the mildest on, with the exact binomial tail as
p-value for "rejects more than its share of good texts", at a level divided by the number of
rules and strata, and the first that fails ends the sequence.  So with probability 1 - delta,
in every stratum at most a fraction `risk` of good texts is rejected by all rules together.
Of the certified cutoffs the mildest that rejects the most bad texts is taken.  A stratum
with too few labels to certify anything has no cutoffs.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.lineage import materialise
from .rows import kept_columns, named

SPACE, SYMBOLS = r"[ \x09-\x0D]+", "#*$%&|<>"
RULES = ["symbols", "dup_lines", "repeats", "capitals", "exclaim"]
#: Scores are compared on this grid.
GRID = 100
RISK, DELTA = 0.02, 0.05
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _share(part: Column, whole: Column) -> Column:
    return F.least(F.floor(GRID * part / F.greatest(whole, F.lit(1))), F.lit(GRID)).cast("int")


def measured(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds the counts and `rule_bins` (array of int: each rule's score on the grid); no shuffle.

    A null text has no words.  Repeated windows: hashes of five words are sorted inside the row
    with their positions, neighbours that share a hash are kept, and the words that their windows
    cover are counted in order of position.
    """
    line = F.split(F.col("_t"), "\n")
    out = df.withColumn("_t", F.coalesce(named(text), F.lit("")))
    out = out.withColumn("_words", F.array_remove(F.split("_t", SPACE), ""))
    out = out.withColumn("_lines", F.filter(line, lambda x: x.rlike(r"[^ \x09-\x0D]")))
    out = out.withColumn("_n", F.size("_words"))
    five = F.transform(F.sequence(F.lit(0), F.col("_n") - 5), lambda i: F.xxhash64(*[F.get("_words", i + k) for k in range(5)]))
    out = out.withColumn("_hashes", F.when(F.col("_n") > 5, five))
    twice = F.size(F.array_distinct("_hashes")) < F.size("_hashes")
    out = out.withColumn("_sorted", F.when(twice, F.array_sort(F.transform("_hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    size = F.size("_sorted")
    shifted = F.arrays_zip(F.col("_sorted").alias("x"), F.slice("_sorted", F.lit(2), size).alias("next"),
                           F.concat(F.slice("_sorted", F.lit(1), F.lit(1)), F.slice("_sorted", F.lit(1), size - 1)).alias("last"))
    out = out.withColumn("_trio", F.when(F.col("_sorted").isNotNull(), shifted))
    same = F.filter("_trio", lambda t: F.coalesce(t["x"]["h"] == t["next"]["h"], F.lit(False))
                    | ((t["x"]["h"] == t["last"]["h"]) & (t["x"]["i"] != t["last"]["i"])))
    out = out.withColumn("_at", F.array_sort(F.transform(same, lambda t: t["x"]["i"])))
    steps = F.zip_with(F.slice("_at", F.lit(2), F.size("_at")), F.slice("_at", F.lit(1), F.size("_at") - 1), lambda b, a: F.least(b - a, F.lit(5)))
    covered = F.when(F.size("_at") > 0, 5 + F.aggregate(steps, F.lit(0), lambda s, x: s + x))
    chars = F.length(F.translate("_t", " \t\n\x0b\f\r", ""))

    def count(characters):
        return F.length("_t") - F.length(F.translate("_t", characters, ""))

    upper = chars - F.length(F.regexp_replace(F.translate("_t", " \t\n\x0b\f\r", ""), r"\p{Lu}+", ""))
    counts = {"n_words": F.col("_n"), "word_chars": chars, "n_symbols": count(SYMBOLS),
              "n_dup_lines": F.size("_lines") - F.size(F.array_distinct("_lines")), "n_repeat_words": F.coalesce(covered, F.lit(0))}
    scores = [_share(counts["n_symbols"], chars), _share(counts["n_dup_lines"], F.size("_lines")), _share(counts["n_repeat_words"], F.col("_n")),
              _share(upper, chars), _share(count("!"), F.col("_n"))]
    # one generated row: the optimizer would copy what these are made of into a filter on the result
    made = F.inline(F.array(F.struct(*[v.cast("bigint").alias(k) for k, v in counts.items()], F.array(*scores).alias("rule_bins"))))
    return out.select(*[named(c) for c in kept_columns(df, [*COUNTS, "rule_bins"])], made)


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def log_binomial_tail(k: Column, n: Column, p: float) -> Column:
    """ln P(X <= k) for X ~ Binomial(n, p), summed exactly, term by term, in logarithms."""
    zero = n * F.log1p(F.lit(-p))
    odds = F.log(F.lit(p / (1 - p)))

    def add(s, i):
        term = s["term"] + F.log((n - i + 1) / i) + odds
        return F.struct(term.alias("term"), (F.greatest(s["total"], term) + F.log1p(F.exp(-F.abs(s["total"] - term)))).alias("total"))

    summed = F.aggregate(F.sequence(F.lit(1).cast("bigint"), k), F.struct(zero.alias("term"), zero.alias("total")), add, lambda s: s["total"])
    return F.when(k > 0, summed).otherwise(zero)


def thresholds(rows: DataFrame, risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """rows (stratum, good boolean, rule_bins) of labelled texts -> (stratum, cut_0, cut_1 ...).

    A text fails rule j where its bin is at least cut_j; null: no cutoff.  Rows without a label are
    left out.  There are no more rows than strata with enough labels to certify a cutoff.
    """
    n_rules = len(RULES)
    rows = rows.where(F.col("good").isNotNull())
    one = rows.select("stratum", F.posexplode("rule_bins").alias("rule", "bin"), F.col("good").cast("int").alias("g"))
    bins = materialise(one.groupBy("stratum", "rule", "bin").agg(F.sum("g").alias("good"), F.sum(1 - F.col("g")).alias("bad")))
    strata = bins.where(F.col("good") > 0).select("stratum").distinct().count()
    whole = Window.partitionBy("stratum", "rule")
    down = whole.orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = bins.select("stratum", "rule", "bin", F.sum("good").over(whole).alias("n"), F.sum("good").over(down).alias("k"),
                       F.sum("bad").over(down).alias("caught"))
    share = risk / n_rules
    level = F.log(F.lit(delta / (n_rules * max(strata, 1))))
    safe = (F.col("bin") > 0) & (F.col("k") <= share * F.col("n")) & (
        F.when(F.col("k") <= share * F.col("n"), log_binomial_tail(F.col("k"), F.col("n"), share)) <= level)
    certified = seen.withColumn("safe", F.min(F.coalesce(safe, F.lit(False)).cast("int")).over(down)).where("safe = 1 AND caught > 0")
    best = certified.groupBy("stratum", "rule").agg(F.max(F.struct("caught", "bin")).alias("best"))
    return best.groupBy("stratum").agg(*[F.max(F.when(F.col("rule") == j, F.col("best.bin"))).alias(f"cut_{j}") for j in range(n_rules)])


def judged(rows: DataFrame, cuts: DataFrame) -> DataFrame:
    """Adds base_failed and kept; rows carry `stratum` and what measured() gives.

    The cutoffs are broadcast: a stratum is among them only with as many labels as a certificate
    needs, so they are fewer than the labels by orders of magnitude.
    """
    fails = reduce(lambda a, b: a | b, [F.coalesce(F.get("rule_bins", F.lit(j)) >= F.col(f"cut_{j}"), F.lit(False)) for j in range(len(RULES))])
    return (rows.join(F.broadcast(cuts), "stratum", "left").withColumn("base_failed", base_failed())
            .withColumn("kept", ~(F.col("base_failed") | fails)).drop(*[f"cut_{j}" for j in range(len(RULES))]))


def labelled(rows: DataFrame, labels: DataFrame, id: str, label: str) -> DataFrame:
    """(stratum, good, rule_bins): each different labelled text of a stratum once.

    rows: (_id, stratum, text_key, rule_bins).  Trials of the binomial bounds must be different texts,
    so copies, repeated rows and repeated labels count once.  A text whose labels contradict
    each other, on one row or on copies, counts as not labelled.
    """
    known = labels.where(named(label).isNotNull()).groupBy(named(id).alias("_id")).agg(
        F.min(named(label) > 0).alias("worst"), F.max(named(label) > 0).alias("best"))
    once = rows.join(known, "_id").groupBy("stratum", "text_key").agg(
        F.min("worst").alias("worst"), F.max("best").alias("best"), F.first("rule_bins").alias("rule_bins"))
    return once.where(F.col("worst") == F.col("best")).select("stratum", F.col("best").alias("good"), "rule_bins")


def calibrated(df: DataFrame, labels: DataFrame, id: str, stratum: str, text: str, label: str, carried: list) -> tuple:
    """(measured rows: `row` with the carried columns, _id, stratum, text_key, counts, rule_bins; their cutoffs).

    The rows are measured and written once.  Labels: 1 good, 0 bad, null none.  A null stratum is the
    stratum of the empty name, a null text an empty one.
    """
    source = df.select(named(id).alias("_id"), F.coalesce(named(stratum).cast("string"), F.lit("")).alias("stratum"), named(text).alias("_text"),
                       F.struct(F.lit(None).cast("int").alias("_"), *[named(c) for c in carried]).alias("row"))
    body = F.coalesce("_text", F.lit(""))
    keyed = source.withColumn("text_key", F.struct(F.xxhash64(body), F.xxhash64(F.lit(1), body)))
    rows = materialise(measured(keyed, "_text").drop("_text"))
    return rows, thresholds(labelled(rows, labels, id, label))


def rated(df: DataFrame, labels: DataFrame, id: str = "doc_id", stratum: str = "lang", text: str = "text", label: str = "quality") -> DataFrame:
    """One row for each text: (id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept).

    Null and empty texts have no words and fail.  Repeated rows stay and are rated alike; for the
    cutoffs each different text counts once (see `labelled`), ties among cutoffs go to the
    mildest.  Texts are measured whole.  An empty table gives no rows, empty labels no cutoffs.
    Other columns are ignored.
    """
    rows, cuts = calibrated(df, labels, id, stratum, text, label, [])
    return judged(rows, cuts).select(F.col("_id").alias(id), *COUNTS, "base_failed", "kept")


def keep_good(df: DataFrame, labels: DataFrame, id: str = "doc_id", stratum: str = "lang", text: str = "text", label: str = "quality") -> DataFrame:
    """The rows that `rated` keeps, with the input's columns, whatever their names.

    Rows are measured once and written with their verdict's numbers, so texts are neither measured
    again nor shuffled.  Null texts, repeats and empty tables as in `rated`.
    """
    rows, cuts = calibrated(df, labels, id, stratum, text, label, df.columns)
    return judged(rows, cuts).where("kept").select(*[F.col("row").getField(c).alias(c) for c in df.columns])
