"""Substring dedup by repeated-phrase automata.

1. Recurring passages.  Every window has a seed, the least hash of its half-length phrases; equal
   windows have equal seeds, and a text has far fewer seeds than windows.  Seeds in documents of
   different ids are candidates; the hashes of the windows that have such a seed are counted with
   map-side combine: a window in documents of different ids recurs, and the smallest id owns it.
   Neighbouring recurring windows of an owner make a passage.
2. Automata.  Documents are dealt into buckets; a bucket gets the passages of the owners that its
   documents share a window with, cut into phrases of half a window, so every window of a passage
   holds a whole phrase.  One Aho-Corasick automaton for each bucket holds them.
3. Streaming.  Each document with a recurring window runs through its bucket's automaton once;
   where a phrase occurs, the windows around it are confirmed word by word against the passages.

A passage that a third of all documents share is one row for each bucket, and its windows are
merged before they are shuffled; no step pairs up the documents that share it.
"""

import itertools
from array import array
from bisect import bisect_right

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.lineage import materialise
from .rows import add_columns, named

WINDOW = 50
#: Rows of an outgoing batch; words whose hashes a task remembers.
ROWS, CACHED = 100_000, 300_000
SPACE = r"[ \x09-\x0D]+"
_BASE = 0x9E3779B97F4A7C15 | 1
_MIX = 0xD6E8FEB86659FD93


class Rolling:
    """Hashes of all windows of a sequence of 64-bit values: polynomials modulo 2^64."""

    def __init__(self, window: int):
        self.window, self.up, self.down = window, None, None

    def __call__(self, values):
        import numpy as np

        n = len(values)
        if n < self.window:
            return np.zeros(0, dtype=np.uint64)
        if self.up is None or len(self.up) < n:
            size = max(n, 1 << 12)
            one = np.ones(1, dtype=np.uint64)
            self.up, self.down = (np.cumprod(np.append(one, np.full(size - 1, step, dtype=np.uint64)), dtype=np.uint64)
                                  for step in (_BASE, pow(_BASE, -1, 1 << 64)))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * self.up[:n], dtype=np.uint64)])
        out = (sums[self.window:] - sums[:-self.window]) * self.down[:n - self.window + 1]
        out = (out ^ (out >> np.uint64(32))) * np.uint64(_MIX)
        return out ^ (out >> np.uint64(29))


def split(text) -> list:
    """Words between ASCII white space, as bytes."""
    return text.encode("utf-8").split() if text else []


class Windows:
    """Hashes of a text's windows, and for each window its seed: the least hash of its half-length phrases.

    Equal windows have equal seeds, and neighbouring windows mostly share theirs.
    """

    def __init__(self, window: int):
        self.window, self.cache = window, {}
        self.whole, self.half = Rolling(window), Rolling(window // 2)

    def __call__(self, words: list) -> tuple:
        import numpy as np
        from xxhash import xxh64_intdigest

        cache = self.cache
        if len(cache) > CACHED:
            cache.clear()
        values = np.array([cache.get(w) or cache.setdefault(w, xxh64_intdigest(w)) for w in words], dtype=np.uint64)
        least, wide, width = self.half(values), 1, self.window - self.window // 2 + 1
        while wide * 2 <= width:
            least = np.minimum(least[:-wide], least[wide:])
            wide *= 2
        if wide < width:
            least = np.minimum(least[:wide - width], least[width - wide:])
        return self.whole(values).view(np.int64), least.view(np.int64)


def _emit(source: DataFrame, window: int, columns: str, of) -> DataFrame:
    """mapInArrow over (id, text, ...): of(windows, words, other columns' values) -> arrays of equal length."""
    def run(batches):
        import numpy as np
        import pyarrow as pa

        make = Windows(window)
        names = [c.split(" ")[0] for c in columns.split(", ")]

        def rows(ids, found, at):
            sizes = [len(f[0]) for f in found]
            parts = [pa.array(np.concatenate(x)) for x in zip(*found)]
            return pa.RecordBatch.from_arrays([ids.take(pa.array(np.repeat(at, sizes))), *parts], ["id", *names])

        for batch in batches:
            found, at, held = [], [], 0
            others = [c.to_pylist() for c in batch.columns[2:]]
            for row, text in enumerate(batch.column(1).to_pylist()):
                words = split(text)
                if len(words) < window:
                    continue
                found.append(of(make, words, *[c[row] for c in others]))
                at.append(row)
                held += len(found[-1][0])
                if held >= ROWS:
                    yield rows(batch.column(0), found, at)
                    found, at, held = [], [], 0
            if at:
                yield rows(batch.column(0), found, at)

    kind = source.schema["id"].dataType.simpleString()
    return source.mapInArrow(run, f"id {kind}, {columns}")


def seeds(source: DataFrame, window: int = WINDOW) -> DataFrame:
    """(id, seed): the different seeds of every text's windows, about one for each quarter of a window."""
    def of(make, words):
        import numpy as np

        return (np.unique(make(words)[1]),)

    return _emit(source.where(F.col("id").isNotNull()), window, "seed bigint", of)


def windows(source: DataFrame, window: int = WINDOW) -> DataFrame:
    """(id, hash, pos) of the windows whose seed is among the row's `seeds`; source: (id, text, seeds)."""
    def of(make, words, wanted):
        import numpy as np

        hashes, own = make(words)
        at = np.flatnonzero(np.isin(own, np.array(wanted, dtype=np.int64)))
        return hashes[at], at.astype(np.int32)

    return _emit(source.select("id", "text", "seeds"), window, "hash bigint, pos int", of)


def _passages(window):
    """Texts of the runs of an owner's recurring windows."""
    def run(texts, positions):
        out = []
        for text, at in zip(texts, positions):
            words, passages, first, last = split(text), [], None, None
            for p in sorted(at):
                if last is not None and p != last + 1:
                    passages.append(b" ".join(words[first:last + window]))
                if last is None or p != last + 1:
                    first = p
                last = p
            passages.append(b" ".join(words[first:last + window]))
            out.append([p.decode("utf-8") for p in passages])
        return [out]
    return run


class Phrases:
    """One bucket's automaton over word numbers, and the windows of its passages with their owners.

    Word numbers are exact, so windows are compared word by word: a hash only says where to look.
    """

    def __init__(self, window: int):
        import ahocorasick

        self.window, self.size = window, window // 2
        self.numbers, self.count = {}, 0
        # all passages as one row of word numbers; where each starts and whose it is
        self.text, self.starts, self.owners = array("I"), [], []
        self.places, self.others = {}, {}  # window hash -> its place in the text; further windows of equal hash
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_LENGTH, ahocorasick.KEY_SEQUENCE)
        self.roll = Rolling(window)

    def _hashes(self, numbers):
        import numpy as np

        values = np.array(numbers, dtype=np.uint64) + np.uint64(1)
        values = (values ^ (values << np.uint64(31))) * np.uint64(_MIX)
        values = (values ^ (values >> np.uint64(32))) * np.uint64(_BASE)
        return self.roll(values ^ (values >> np.uint64(29)))

    def add(self, owner, passage: str) -> None:
        words, numbers = split(passage), self.numbers
        ids = [numbers.setdefault(w, len(numbers) + 1) for w in words]
        for i in range(0, len(ids) - self.size + 1, self.size):
            self.automaton.add_word(tuple(ids[i:i + self.size]))
            self.count += 1
        start, wide = len(self.text), self.window
        self.text.extend(ids)
        self.starts.append(start)
        self.owners.append(owner)
        for at, h in enumerate(self._hashes(ids).tolist(), start):
            known = self.places.setdefault(h, at)
            if known == at:
                continue
            window = self.text[at:at + wide]
            if self.text[known:known + wide] == window:
                if owner < self.owner(known):
                    self.places[h] = at
            else:
                self.others.setdefault(h, []).append(at)

    def owner(self, place: int):
        """Whose passage holds this place of the text."""
        return self.owners[bisect_right(self.starts, place) - 1]

    def confirmed(self, id, ids: list, at: list) -> list:
        """Those places among `at` whose window stands word by word in a passage of a smaller id."""
        text, wide, hit, before = self.text, self.window, [], (None, None)
        numbers = array("I", ids)
        for p, h in zip(at, self._hashes(ids)[at].tolist()):
            known = self.places.get(h)
            if known is None:
                continue
            for q in (known, *self.others.get(h, ())):
                if before == (p - 1, q - 1):  # all but the last word are compared already
                    same = numbers[p + wide - 1] == text[q + wide - 1]
                else:
                    same = numbers[p:p + wide] == text[q:q + wide]
                if same and self.owner(q) < id:
                    hit.append(p)
                    before = (p, q)
                    break
        return hit

    def close(self) -> None:
        if self.count:
            self.automaton.make_automaton()

    def covered(self, id, words: list):
        """Which words are covered by a window that starts in a document with a smaller id."""
        import numpy as np

        n, get = len(words), self.numbers.get
        cover = np.zeros(n + 1, dtype=np.int64)
        if n < self.window or not self.count:
            return cover[:n] > 0
        ids = [get(w, 0) for w in words]
        last = np.array([end for end, _ in self.automaton.iter(tuple(ids))], dtype=np.int64)
        near = np.zeros(n + 1, dtype=np.int64)  # windows that hold a whole phrase
        top = n - self.window + 1
        low, high = np.maximum(last + 1 - self.window, 0), np.minimum(last - self.size + 2, top)
        fits = low < high
        near += np.bincount(low[fits], minlength=n + 1) - np.bincount(high[fits], minlength=n + 1)
        hit = self.confirmed(id, ids, np.flatnonzero(np.cumsum(near)[:top]).tolist())
        cover += np.bincount(hit, minlength=n + 1).astype(np.int64)
        cover -= np.bincount(np.array(hit, dtype=np.int64) + self.window, minlength=n + 1)
        return np.cumsum(cover)[:n] > 0


def _stream(window):
    """Rows sorted by bucket, passages first: build the bucket's automaton, then run its documents."""
    def run(batches):
        import numpy as np
        import pyarrow as pa

        bucket, phrases, open_ = None, None, False
        for batch in batches:
            rows, n_words, n_removed, kept, spans = [], [], [], [], []
            for at, (b, kind, id, text, passages) in enumerate(zip(*[c.to_pylist() for c in batch.columns])):
                if b != bucket:
                    bucket, phrases, open_ = b, Phrases(window), True
                if not kind:
                    for p in passages:
                        phrases.add(id, p)
                    continue
                if open_:
                    phrases.close()
                    open_ = False
                words = split(text)
                gone = phrases.covered(id, words)
                rows.append(at)
                n_words.append(len(words))
                n_removed.append(int(gone.sum()))
                kept.append(b" ".join(itertools.compress(words, ~gone)).decode("utf-8"))
                spans.append(np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]]))).tolist())
            yield pa.RecordBatch.from_arrays(
                [batch.column(2).take(pa.array(rows, pa.int64())), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()),
                 pa.array(kept, pa.string()), pa.array(spans, pa.list_(pa.int64()))], ["id", "n_words", "n_removed", "kept", "removed_spans"])
    return run


def repeated(df: DataFrame, id: str = "doc_id", text: str = "text", window: int = WINDOW, buckets: int = None) -> DataFrame:
    """The documents that share a window with one of a smaller id, a row for each of their rows:

    (id, n_words, n_removed, kept: the words that stay, joined by one blank, removed_spans: word
    positions start, end, start, end ...).  Documents that are not listed lose nothing, nor do
    those of null text, of fewer words than a window, or without id.  Rows that repeat an id do
    not count as copies of each other.  buckets: automata; twice the shuffle partitions by default,
    so that their size follows the setting that follows the data.
    """
    spark = df.sparkSession
    buckets = buckets or 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    texts = df.select(named(id).alias("id"), named(text).alias("text"))
    own = materialise(seeds(texts, window))
    shared = own.groupBy("seed").agg(F.min("id").alias("_a"), F.max("id").alias("_b")).where(F.col("_a") < F.col("_b")).select("seed")
    marked = own.join(shared, "seed").groupBy("id").agg(F.collect_set("seed").alias("seeds"))
    near = materialise(texts.join(marked, "id"))
    found = materialise(windows(near, window))
    recurring = materialise(found.groupBy("hash").agg(F.min("id").alias("owner"), F.min_by("pos", "id").alias("at"), F.max("id").alias("last"))
                            .where(F.col("owner") < F.col("last")).drop("last"))
    bucket = F.pmod(F.xxhash64("id"), F.lit(buckets)).cast("int")
    routes = materialise(found.select("hash", "id").join(recurring.select("hash", "owner"), "hash").where(F.col("id") > F.col("owner"))
                         .select("id", "owner").distinct())
    places = recurring.groupBy("owner").agg(F.collect_set("at").alias("positions"))
    goals = routes.select("owner", bucket.alias("b")).distinct().groupBy("owner").agg(F.collect_set("b").alias("buckets"))
    owners = places.join(goals, "owner").withColumnRenamed("owner", "id")
    wanted = routes.select("id").distinct().withColumn("listed", F.lit(True)).join(owners, "id", "full")
    chosen = materialise(near.select("id", "text").join(wanted, "id"))
    given = add_columns(chosen.where(F.col("buckets").isNotNull()), ["text", "positions"], [("passages", "array<string>")],
                        lambda: _passages(window), keep=["id", "buckets"])
    given = given.select(F.explode("buckets").alias("bucket"), F.lit(0).alias("kind"), "id", F.lit(None).cast("string").alias("text"), "passages")
    sought = chosen.where("listed").select(bucket.alias("bucket"), F.lit(1).alias("kind"), "id", "text",
                                           F.lit(None).cast("array<string>").alias("passages"))
    dealt = given.unionByName(sought).repartition("bucket").sortWithinPartitions("bucket", "kind", "id")
    kind = texts.schema["id"].dataType.simpleString()
    out = dealt.mapInArrow(_stream(window), f"id {kind}, n_words bigint, n_removed bigint, kept string, removed_spans array<bigint>")
    return out.withColumnRenamed("id", id)


def words_of(text: Column) -> Column:
    """The same words as a Column."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def without_repeats(df: DataFrame, id: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """Digest rows (id, n_words, n_removed, kept_sha256) of all documents.

    The digests of untouched documents are made in place; only ids meet the touched ones.
    """
    words = words_of(named(text))
    rows = df.select(named(id).alias(id), F.size(words).cast("bigint").alias("n_words"), F.lit(0).cast("bigint").alias("n_removed"),
                     F.sha2(F.array_join(words, " ").cast("binary"), 256).alias("kept_sha256"))
    touched = materialise(repeated(df, id, text, window).select(id, "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256")))
    return rows.join(touched.select(id).distinct(), id, "left_anti").unionByName(touched)
