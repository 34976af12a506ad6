"""A token-sequence model fitted, scored and sampled with aggregations and joins.

Context of a token: the previous `order` tokens (left-filled with the begin token) and
the scaffold token next to the attachment point.  p(t | c) = (n(c,t) + alpha) / (n(c) + alpha V),
with V the decoration tokens including the end token; an unseen context gives 1 / V.
"""

import math
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import draws, tokens
from .lineage import materialise, measured, remove
from .lookup import lookup
from .ranking import ranked
from .spread import spread

#: Bins of the unit interval by which draws find their token.
BINS = 16


def token_events(df: DataFrame, order: int) -> DataFrame:
    """One row per decoration token: adds `pos`, `context` and `token`."""
    body = F.concat(tokens.tokenize(F.col("decoration"), marks=False), F.array(F.lit(tokens.END)))
    padded = F.concat(F.array_repeat(F.lit(tokens.BEGIN), order), F.col("_body"))
    rows = df.withColumn("_body", body).withColumn("_padded", padded)
    steps = F.transform(F.col("_body"), lambda t, i: F.struct(
        F.concat(F.slice(F.col("_padded"), i + 1, order), F.array("near")).alias("context"), t.alias("token")))
    return rows.select(*df.columns, F.posexplode(steps).alias("pos", "_e")).select(
        *df.columns, "pos", "_e.context", "_e.token")


def with_near(pairs: DataFrame) -> DataFrame:
    """Add `near`: all that the model sees of the scaffold."""
    return pairs.withColumn("near", tokens.point_neighbour(F.col("scaffold")))


def fit(pairs: DataFrame, order: int = 2, alpha: float = 1.0) -> DataFrame:
    """(context, token, n, n_context, n_tokens, logp) from (scaffold, decoration) rows.

    Pairs are counted, then counted by what the model sees of them, before tokens are spread out: a
    scaffold or decoration shared by a third of the rows is tokenised once.
    """
    counted = with_near(pairs.groupBy("scaffold", "decoration").agg(F.count(F.lit(1)).alias("_n")))
    counted = counted.groupBy("near", "decoration").agg(F.sum("_n").alias("_n"))
    grams = token_events(counted, order).groupBy("context", "token").agg(F.sum("_n").alias("n"))
    grams = grams.withColumn("n_context", F.sum("n").over(Window.partitionBy("context")))
    alphabet = grams.agg(F.countDistinct("token").alias("n_tokens"))
    logp = F.log((F.col("n") + F.lit(alpha)) / (F.col("n_context") + F.lit(alpha) * F.col("n_tokens")))
    return grams.crossJoin(F.broadcast(alphabet)).withColumn("alpha", F.lit(alpha)).withColumn("logp", logp)


def _context_totals(model: DataFrame) -> DataFrame:
    return model.groupBy("context").agg(F.max("n_context").alias("_total"))


def _scalars(model: DataFrame) -> tuple:
    """(V, alpha): two numbers, whatever the size of the model; (0, 1.0) of an empty one."""
    v, alpha = model.agg(F.max("n_tokens"), F.max("alpha")).first()
    return (v, alpha) if v else (0, 1.0)


def score(pairs: DataFrame, model: DataFrame, order: int = 2, vocabulary: DataFrame = None) -> DataFrame:
    """Add `nll` (sum over tokens and end token) and `oov` to (scaffold, decoration) rows.

    A score depends on (near, decoration) only: each different (context, token) is scored once, and so is
    each different pair; the rows look their pair up, with frequent keys set apart.  A decoration
    token that the model has never seen makes nll NULL, and so does a token outside
    `vocabulary` (side, token) when given, and a NULL text.
    """
    model = materialise(model)  # read several times, and made from all training rows
    distinct = with_near(pairs.groupBy("scaffold", "decoration").agg(F.count(F.lit(1)).alias("_rows")))
    distinct = materialise(distinct)
    seen_as = distinct.groupBy("near", "decoration").agg(F.count(F.lit(1)).alias("_pairs"))
    events = token_events(seen_as, order)
    known = model.groupBy("token").agg(F.lit(True).alias("_known"))
    v, alpha = _scalars(model)
    p = (F.coalesce("n", F.lit(0)) + F.lit(alpha)) / (F.coalesce("_total", F.lit(0)) + F.lit(alpha * max(v, 1)))
    grams = events.groupBy("context", "token").agg(F.count(F.lit(1)).alias("_uses"))
    grams = (grams.join(model.select("context", "token", "n"), ["context", "token"], "left").join(_context_totals(model), "context", "left")
             .join(known, "token", "left").select("context", "token", "_uses", (-F.log(p)).alias("_nll"), F.col("_known").isNull().alias("oov")))
    grams = materialise(grams)
    scored = lookup(events, grams, ["context", "token"], "_uses").groupBy("near", "decoration", "_pairs").agg(
        F.sum("_nll").alias("nll"), F.bool_or("oov").alias("oov"))
    scored = lookup(distinct, materialise(scored), ["near", "decoration"], "_pairs").drop("near")
    if vocabulary is not None:
        scored = _vocabulary_check(scored, vocabulary)
    scored = materialise(scored.withColumn("nll", F.when(~F.col("oov"), F.col("nll"))))
    remove(distinct, grams, model)
    return lookup(pairs, scored, ["scaffold", "decoration"], "_rows")


def _vocabulary_check(rows: DataFrame, vocabulary: DataFrame) -> DataFrame:
    for side in ("scaffold", "decoration"):
        texts = rows.select(side).distinct()
        words = texts.select(side, F.explode(tokens.tokenize(F.col(side), marks=False)).alias("token"))
        unknown = words.join(vocabulary.where(F.col("side") == side), "token", "left_anti").select(side).distinct()
        rows = rows.join(unknown.withColumn("_unknown", F.lit(True)), side, "left").withColumn(
            "oov", F.col("oov") | F.col("_unknown").isNotNull()).drop("_unknown")
    return rows


def batch_mean(scored: DataFrame) -> DataFrame:
    """Mean NLL per (epoch, batch)."""
    return scored.groupBy("epoch", "batch").agg(F.avg("nll").alias("loss"))


def score_with(df: DataFrame, make_predict, inputs: list, batch_size: int = 128, name: str = "nll") -> DataFrame:
    """Score rows with the caller's own network: `make_predict()` returns a batch function."""
    from pyspark.ml.functions import predict_batch_udf

    predict = predict_batch_udf(make_predict, return_type=T.DoubleType(), batch_size=batch_size)
    return df.withColumn(name, predict(*[F.col(c) for c in inputs]))


# --- sampling ----------------------------------------------------------------------

def draw_rows(scaffolds: DataFrame, n: int, seed: int, key: list) -> DataFrame:
    """Every scaffold n times, each copy with the start of its own random stream."""
    rows = with_near(scaffolds).withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(n))))
    return rows.withColumn("_state", draws.start_state(draws.hash_hex(seed, *key, "draw")))


def intervals(model: DataFrame, alphabet: DataFrame, v: int, alpha: float, bins: int = BINS) -> DataFrame:
    """(context, bin, lo, hi, run, first, total, token, cost): the unit interval of every context, cut up by next tokens.

    Tokens lie in token order.  A seen token has an interval of its own; the unseen ones between two
    seen tokens share one (token NULL), as each has the same width: they are those after rank `first`.
    An interval stands in every bin of 1 / `bins` that it touches, so a draw finds it by equal keys.
    """
    total = F.col("n_context") + F.lit(alpha) * v
    down = Window.partitionBy("context").orderBy("_rank")
    rows = lookup(model.select("context", "token", "n", "n_context"), alphabet, ["token"], "_uses").select(
        "context", "token", "n", "_rank", total.alias("total"), F.sum("n").over(down).alias("after"),
        F.coalesce(F.lag("_rank").over(down), F.lit(0)).alias("earlier"), F.lead("_rank").over(down).isNull().alias("is_last"))
    before, rank = F.col("after") - F.col("n"), F.col("_rank")

    def edge(run, i):
        return (run + F.lit(alpha) * i) / F.col("total")

    def cut(lo, hi, run, first, token, n):
        return F.struct(lo.alias("lo"), hi.alias("hi"), run.alias("run"), first.cast("bigint").alias("first"), F.col("total"), token.alias("token"),
                        (-F.log((n + F.lit(alpha)) / F.col("total"))).alias("cost"))

    none, zero = F.lit(None).cast("string"), F.lit(0)
    parts = F.array(cut(edge(before, F.col("earlier")), edge(before, rank - 1), before, F.col("earlier"), none, zero),
                    cut(edge(before, rank - 1), F.when(F.col("is_last") & (rank == v), 2.0).otherwise(edge(F.col("after"), rank)), before, rank - 1,
                        F.col("token"), F.col("n")),
                    F.when(F.col("is_last") & (rank < v), cut(edge(F.col("after"), rank), F.lit(2.0), F.col("after"), rank, none, zero)))
    cuts = rows.select("context", F.explode(F.filter(parts, lambda x: x["lo"] < x["hi"])).alias("x")).select("context", "x.*")
    touched = F.sequence(F.floor(F.col("lo") * bins), F.least(F.floor(F.col("hi") * bins), F.lit(bins - 1)))
    return cuts.where(F.col("lo") < 1).withColumn("bin", F.explode(touched))


class Sampler:
    """A model prepared once; called with draw rows it adds `decoration`, `nll` and `finished`.

    One way for models of any size: each step joins the open rows to the interval table by equal
    (context, bin) and a range test; draws among unseen tokens find their token by its rank.  What is
    small enough the engine broadcasts by itself.  Rows are written out every few steps; finished
    ones leave the loop.  `remove` deletes the prepared tables.
    """

    def __init__(self, model: DataFrame, order: int = 2, max_len: int = 256, bins: int = BINS, steps_per_table: int = 8):
        self.order, self.max_len, self.bins, self.steps = order, max_len, bins, steps_per_table
        model = materialise(model)  # read several times, and made from all training rows
        self.v, self.alpha = _scalars(model)
        if not self.v or not self.alpha > 0:
            remove(model)
            raise ValueError("drawing needs a fitted model with alpha > 0")
        uses = model.groupBy("token").agg(F.count(F.lit(1)).alias("_uses"))
        ranks = materialise(ranked(uses, [], ["token"], "_rank"))
        cuts = intervals(model, ranks, self.v, self.alpha, bins)
        self.cuts = materialise(cuts.toDF(*[f"_c_{c}" for c in cuts.columns]))  # names of their own beside the rows' columns
        self.alphabet = ranks.select("_rank", F.col("token").alias("_rare"))
        remove(model)

    def remove(self) -> None:
        remove(self.alphabet, self.cuts)

    def __call__(self, rows: DataFrame) -> DataFrame:
        kept = [c for c in rows.columns if c not in ("near", "_state")]
        active = spread(rows).withColumns({"_history": F.array_repeat(F.lit(tokens.BEGIN), self.order), "_text": F.lit(""), "_open": F.lit(True), "nll": F.lit(0.0)})
        done = [active] if self.max_len <= 1 else []
        for step in range(0, self.max_len - 1, self.steps):
            last = step + self.steps >= self.max_len - 1
            active, counts = measured(self._advance(active, min(self.steps, self.max_len - 1 - step)), open=F.count_if("_open"))
            done.append(active if last else active.where(~F.col("_open")))
            if last or not counts["open"]:
                break
            active = active.where("_open")
        result = reduce(lambda a, b: a.unionByName(b), done)
        return result.select(*kept, F.col("_text").alias("decoration"), "nll", (~F.col("_open")).alias("finished"))

    def _advance(self, active: DataFrame, steps: int) -> DataFrame:
        """So many tokens more for every open row.

        Closed rows ask for bins and ranks that do not exist, each for another, so they meet nowhere.  A
        context that the model has not seen is one interval of unseen tokens; a draw among
        unseen tokens is a rank, at most one off from its estimate, whose token is then joined.
        """
        m, none, alpha, token = draws.LEHMER_M, "-1 - _state % 1024", f"{self.alpha!r}D", "coalesce(_token, _rare)"
        kept = [f"`{c}`" for c in active.columns if c not in ("_state", "_history", "_text", "_open", "nll")]
        history = f"slice(concat(_history, array({token})), 2, {self.order})" if self.order else "_history"
        asking = [*kept, "_history", "_text", "_open", "nll", f"_state * {draws.LEHMER_A} % {m} AS _next", f"_next / {m} AS _u",
                  "IF(_open, concat(_history, array(near)), CAST(array() AS array<string>)) AS _context",
                  f"IF(_open, floor(_next / {m} * {self.bins}), {none}) AS _bin"]
        hit = F.expr("_context = _c_context AND _bin = _c_bin AND _c_lo <= _u AND _u < _c_hi")
        wanted = [*kept, "_history", "_text", "_open", "nll", "_next AS _state", "_c_token AS _token", f"coalesce(_c_total, {self.alpha * self.v!r}D) AS _total",
                  "coalesce(_c_run, 0) AS _run", "coalesce(_c_first, 0) AS _first", f"coalesce(_c_cost, {-math.log(1 / self.v)!r}D) AS _cost",
                  f"greatest(floor((_u * _total - _run) / {alpha}) + 1, _first + 1) AS _guess",
                  f"""IF(_open AND _c_token IS NULL, least({self.v},
                      CASE WHEN _guess - 1 > _first AND (_run + {alpha} * (_guess - 1)) / _total > _u THEN _guess - 1
                           WHEN (_run + {alpha} * _guess) / _total > _u THEN _guess ELSE _guess + 1 END), -1 - _next % 1024) AS _wanted"""]
        going = f"_open AND {token} != '{tokens.END}'"
        taken = [*kept, "_state", f"IF(_open, {history}, _history) AS _history", f"IF({going}, concat(_text, {token}), _text) AS _text",
                 f"{going} AS _open", "IF(_open, nll + _cost, nll) AS nll"]
        for _ in range(steps):
            rows = active.selectExpr(*asking).join(self.cuts, hit, "left").selectExpr(*wanted)
            active = rows.join(self.alphabet, F.expr("_wanted = _rank"), "left").selectExpr(*taken)
        return active


def sample(scaffolds: DataFrame, model: DataFrame, n: int = 1, order: int = 2, max_len: int = 256, seed: int = 0, *, key: list) -> DataFrame:
    """n decorations per scaffold row: adds `draw`, `decoration`, `nll` and `finished`.

    key: columns that tell rows apart; rows that agree in them get equal draws.
    Each step takes the first token, in token order, whose running probability exceeds the
    row's next draw; a decoration ends at the end token or after max_len - 1 steps.
    finished: the last pick is the end token; where it is false the decoration was cut off.
    """
    sampler = Sampler(model, order, max_len)
    drawn = sampler(draw_rows(scaffolds, n, seed, list(key)))
    if max_len > 1:  # every step has been written
        sampler.remove()
    return drawn
