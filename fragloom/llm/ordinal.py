"""Ordinal quality classifier: a cumulative-link (proportional odds) model on hashed text.

P(grade <= k) = logistic(cut_k - w.x): one weight vector for all grades and ordered cuts, the
gaps between which are exponentials and so stay positive.  Features are hashed: the different
words of a text, the different shapes of its tokens, repeats of neighbouring words, and the
share of tokens that repeat.  It is fitted on a bounded sample of labelled rows in one task, by
full-batch gradient steps; scoring streams all rows.
"""

import re
import zlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .rows import add_columns, named

#: Hashed features; the most labelled texts that are fitted on.
SIZE, SAMPLE = 1 << 16, 20_000
STEPS, RATE, RIDGE = 80, 0.08, 2e-4
TOKEN = re.compile(r"\S+")
_EDGE = re.compile(r"^[\W_]+|[\W_]+$")
_SHAPE = [(re.compile(r"[^\W\d_]*[A-ZÀ-Þ]{2,}[^\W\d_]*"), "A"), (re.compile(r"[^\W\d_]+"), "a"), (re.compile(r"\d+"), "0")]


def shape(token: str) -> str:
    for pattern, sign in _SHAPE:
        token = pattern.sub(sign, token)
    return token[:12]


def features(text: str, cache: dict) -> list:
    """Different hashed features of a text, in order; cache: token -> its two features."""
    tokens = (text or "").split()
    counts = {}
    for t in tokens:
        counts[t] = counts.get(t, 0) + 1
    out = set()
    shapes = {}
    for t, n in counts.items():
        pair = cache.get(t)
        if pair is None:
            if len(cache) > 300_000:
                cache.clear()
            word, form = _EDGE.sub("", t.lower()), shape(t)
            pair = cache[t] = (zlib.crc32(b"w" + word.encode("utf-8")) % SIZE if word else None, form)
        if pair[0] is not None:
            out.add(pair[0])
        shapes[pair[1]] = shapes.get(pair[1], 0) + n
    total = max(1, len(tokens))
    for form, n in shapes.items():
        for level in range(1, int(10 * n / total) + 1):
            out.add(zlib.crc32(f"s{level}{form}".encode("utf-8")) % SIZE)
    same = sum(a == b for a, b in zip(tokens, tokens[1:]))
    lines = [x for x in (text or "").split("\n") if x.strip()]
    grams = [tuple(tokens[i:i + 5]) for i in range(0, max(0, len(tokens) - 4))]
    for kind, share in (("r", same / total), ("l", 1 - len(set(lines)) / max(1, len(lines))),
                        ("g", 1 - len(set(grams)) / max(1, len(grams))), ("n", min(1.0, len(tokens) / 100))):
        for level in range(1, int(10 * share) + 1):
            out.add(zlib.crc32(f"{kind}{level}".encode()) % SIZE)
    return sorted(out)


def fit_rows(rows: list, grades: list, n_grades: int):
    """rows: lists of features -> (weights, cuts).  Features seen once keep weight zero."""
    import numpy as np

    flat = np.array([f for r in rows for f in r], dtype=np.int64)
    sizes = np.array([len(r) for r in rows])
    owner = np.repeat(np.arange(len(rows)), sizes)
    grades = np.array(grades)
    often = np.bincount(flat, minlength=SIZE) >= 2
    use = often[flat]
    flat, owner = flat[use], owner[use]
    share = np.clip(np.cumsum(np.bincount(grades, minlength=n_grades))[:-1] / max(1, len(rows)), 0.01, 0.99)
    cut = np.log(share / (1 - share))
    theta = np.concatenate([[cut[0]], np.log(np.maximum(np.diff(cut), 0.05))])
    weights = np.zeros(SIZE)
    state = [np.zeros(SIZE + len(theta)) for _ in range(2)]

    def sigmoid(x):
        return 1 / (1 + np.exp(-np.clip(x, -35, 35)))

    for step in range(1, STEPS + 1):
        eta = np.bincount(owner, weights=weights[flat], minlength=len(rows))
        cuts = np.cumsum(np.concatenate([[theta[0]], np.exp(theta[1:])]))
        edge = np.concatenate([[-np.inf], cuts, [np.inf]])
        high = np.where(grades + 1 == n_grades, 1.0, sigmoid(edge[grades + 1] - eta))
        low = np.where(grades == 0, 0.0, sigmoid(edge[grades] - eta))
        p = np.maximum(high - low, 1e-12)
        d_high, d_low = high * (1 - high) / p, low * (1 - low) / p
        d_eta = (d_high - d_low) / len(rows)  # of the negative log likelihood
        d_cuts = np.bincount(grades, weights=-d_high, minlength=n_grades)[:-1] + np.bincount(grades, weights=d_low, minlength=n_grades)[1:]
        tails = np.cumsum(d_cuts[::-1])[::-1] / len(rows)
        d_theta = np.concatenate([[tails[0]], tails[1:] * np.exp(theta[1:])])
        d_w = np.bincount(flat, weights=d_eta[owner], minlength=SIZE) + RIDGE * weights
        gradient = np.concatenate([d_w, d_theta])
        state[0] = 0.9 * state[0] + 0.1 * gradient
        state[1] = 0.99 * state[1] + 0.01 * gradient ** 2
        move = RATE * (state[0] / (1 - 0.9 ** step)) / (np.sqrt(state[1] / (1 - 0.99 ** step)) + 1e-6)
        weights -= move[:SIZE] * often
        theta -= move[SIZE:]
    return weights, np.cumsum(np.concatenate([[theta[0]], np.exp(theta[1:])]))


def fit(rows: DataFrame, n_grades: int, labels: DataFrame = None, id: str = "doc_id", text: str = "text", grade: str = "grade",
        sample: int = SAMPLE) -> tuple:
    """(weights, cuts) from at most `sample` different texts with a grade 0 .. n_grades-1, all if there are fewer.

    labels: (id, grade) rows; without them `rows` have the grades.  Each different text counts once,
    whatever its copies, repeated rows and ids; one with contradicting grades counts as none.  The
    sample are the texts with the smallest hashes (128 bits, so without ties).  Only hashes are
    shuffled to find them; their keys, at most `sample`, are broadcast, their texts pass one task.
    A null text is an empty one, a null grade no grade.  Without any labelled text the weights are
    zero and the grades equally likely.  Other columns are ignored.
    """
    body = F.coalesce(named(text), F.lit(""))
    key = F.struct(F.xxhash64(body).alias("a"), F.xxhash64(F.lit(1), body).alias("b")).alias("k")
    if labels is None:
        graded = rows.select(key, named(grade).alias("g"))
    else:
        graded = rows.select(key, named(id).alias("i")).join(labels.select(named(id).alias("i"), named(grade).alias("g")), "i")
    once = graded.where(F.col("g").between(0, n_grades - 1)).groupBy("k").agg(F.min("g").cast("int").alias("g"), F.max("g").alias("high"))
    keys = once.where("g = high").orderBy("k").limit(sample).select("k", "g")
    chosen = rows.select(key, body.alias("t")).join(F.broadcast(keys), "k").groupBy("k").agg(F.first("t").alias("t"), F.first("g").alias("g")).drop("k")

    def parse():
        cache = {}
        return lambda texts: [[features(t, cache) for t in texts]]

    def train(batches):
        import numpy as np
        import pyarrow as pa

        found, grades = [], []
        for batch in batches:
            found += [np.array(x, dtype=np.int32) for x in batch.column("f").to_pylist()]
            grades += batch.column("g").to_pylist()
        if found:
            weights, cuts = fit_rows(found, grades, n_grades)
        else:
            weights, cuts = np.zeros(SIZE), np.log(np.arange(1, n_grades) / np.arange(n_grades - 1, 0, -1))
        yield pa.RecordBatch.from_arrays([pa.array([weights.tobytes()]), pa.array([cuts.tobytes()])], ["weights", "cuts"])

    import numpy as np

    hashed = add_columns(chosen, ["t"], [("f", "array<int>")], parse, keep=["g"])
    row = hashed.repartition(1).mapInArrow(train, "weights binary, cuts binary").first()
    return np.frombuffer(row["weights"]), np.frombuffer(row["cuts"])


def grade(df: DataFrame, model: tuple, at_least: int, text: str = "text", keep: list = None) -> DataFrame:
    """Adds expected_grade and tail_probability = P(grade >= at_least), of every whole text; no shuffle.

    Null and empty texts have the grade of no feature.  Repeated rows stay and are graded alike.  An empty
    table gives no rows.  Columns named like the two results are replaced; any other names may be used.
    """
    weights, cuts = model
    shared = df.sparkSession.sparkContext.broadcast((weights, cuts))  # SIZE numbers, whatever the data

    def start():
        import numpy as np

        w, c = shared.value
        cache = {}

        def run(texts):
            expected, tail = [], []
            for t in texts:
                found = features(t, cache)
                eta = float(w[found].sum()) if found else 0.0
                above = 1 / (1 + np.exp(np.clip(c - eta, -700, 700)))  # P(grade > k)
                expected.append(float(above.sum()))
                tail.append(float(above[at_least - 1]))
            return expected, tail
        return run

    return add_columns(df, [text], [("expected_grade", "double"), ("tail_probability", "double")], start, keep)
