"""Benchmark decontamination: suffix arrays of document shards, searched for every test suffix.

Each task cuts its documents into shards of words and builds each shard's suffix array by
prefix doubling, to the depth of a window: ranks of runs of 1, 2, 4, 8 ... words, so a window
is a pair of ranks.  Every suffix of every benchmark text is then binary-searched in the array;
its interval lists the places where its window occurs, and neighbouring places on one diagonal
make the longest verbatim matches.  Documents never leave their task: no shuffle.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .rows import add_columns, fresh, named

WINDOW, SHARD_WORDS = 10, 250_000
#: Bytes of benchmark text that are sent to the tasks at a time; more go in further blocks.
BLOCK_BYTES = 8 << 20
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text) -> list:
    import re

    return re.findall(WORD, text.encode("utf-8").lower().decode("utf-8")) if text else []  # bytes: A-Z only


class Suffixes:
    """The benchmark's side: word ids, and its suffixes by the length of the window they start."""

    def __init__(self, items: list, window: int):
        import numpy as np

        self.window, texts = window, [(i, words(t)) for i, t in items]
        self.ids = {w: k + 1 for k, w in enumerate(sorted({w for _, t in texts for w in t}))}  # 0: no test word
        flat, starts, owner, lengths = [], [], [], []
        for i, text in texts:
            if not text:
                continue
            n = min(window, len(text))
            for s in range(len(text) - n + 1):
                starts.append(len(flat) + s)
                owner.append(i)
                lengths.append(n)
            flat += [self.ids[w] for w in text] + [0]
        self.flat = np.array(flat, dtype=np.int64)
        self.starts, self.lengths = np.array(starts, dtype=np.int64), np.array(lengths, dtype=np.int64)
        self.owner = owner


def occurrences(shard, tests: Suffixes):
    """Where test suffixes start in the shard's word ids: (place, number of the suffix), all of them."""
    import numpy as np

    n = len(shard)
    both = np.concatenate([shard, [0], tests.flat])
    ranks, depth, out = {1: both}, 1, []
    for length in np.unique(tests.lengths):
        while depth * 2 <= length:
            wide = np.zeros_like(both)
            wide[:-depth] = ranks[depth][depth:]
            known = np.flatnonzero((ranks[depth] > 0) & (wide > 0))
            following = np.zeros_like(both)
            pairs = ranks[depth][known] * (len(both) + len(tests.ids) + 2) + wide[known]
            following[known] = np.unique(pairs, return_inverse=True)[1] + 1
            depth *= 2
            ranks[depth] = following
        rank = ranks[1 << (int(length).bit_length() - 1)]
        rest = int(length) - (1 << (int(length).bit_length() - 1))
        tail = np.zeros_like(both)
        tail[:len(both) - rest] = rank[rest:]
        whole = np.where((rank > 0) & (tail > 0), rank * (len(both) + len(tests.ids) + 2) + tail, 0)
        array = np.flatnonzero(whole[:n])
        array = array[np.argsort(whole[array], kind="stable")]  # the shard's suffixes in order
        mine = np.flatnonzero(tests.lengths == length)
        sought = whole[n + 1 + tests.starts[mine]]
        low, high = (np.searchsorted(whole[array], sought, side) for side in ("left", "right"))
        hits = high - low
        suffix = np.repeat(mine, hits)
        inside = np.arange(hits.sum()) - np.repeat(np.cumsum(hits) - hits, hits)
        out.append((array[np.repeat(low, hits) + inside], suffix))
    return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64),) * 2


def longest(places, suffixes, tests: Suffixes):
    """For each occurrence the words of the verbatim match it begins: a run along its diagonal."""
    import numpy as np

    if not len(places):
        return np.zeros(0, np.int64)
    start = tests.starts[suffixes]
    order = np.lexsort((places, places - start))
    p, s, size = places[order], start[order], tests.lengths[suffixes[order]]
    breaks = np.flatnonzero(np.append((np.diff(p) != 1) | (np.diff(s) != 1), True))
    last = breaks[np.searchsorted(breaks, np.arange(len(p)))]
    out = np.empty(len(p), dtype=np.int64)
    out[order] = p[last] - p + size[last]
    return out


def _scan(items, window, shard_words):
    """items: a broadcast list of (item id, text)."""
    def start():
        import numpy as np

        tests = Suffixes(items.value, window)
        get, shard = tests.ids.get, max(shard_words, len(tests.flat))

        def search(pieces, found):
            """pieces: (row, first word of the piece, word ids)."""
            import itertools

            flat = np.fromiter(itertools.chain.from_iterable(p + [0] for _, _, p in pieces), dtype=np.int64)
            begins = np.cumsum([0] + [len(p) + 1 for _, _, p in pieces])
            places, suffixes = occurrences(flat, tests)
            piece = np.searchsorted(begins, places, "right") - 1
            for k in np.unique(piece):
                at = piece == k
                row, first, _ = pieces[k]
                found.setdefault(row, []).append((places[at] - begins[k] + first, suffixes[at]))

        def run(texts, hit_words, hit_items, longest_match):
            found, pieces, total, counts = {}, [], 0, []
            for row, text in enumerate(texts):
                ids = [get(w, 0) for w in words(text)]
                counts.append(len(ids))
                for first in range(0, len(ids), shard):
                    part = ids[first:first + shard + window - 1]
                    pieces.append((row, first, part))
                    total += len(part)
                    if total >= shard:
                        search(pieces, found)
                        pieces, total = [], 0
            if pieces:
                search(pieces, found)
            spans, items_found, most = list(hit_words), list(hit_items), list(longest_match)
            for row, parts in found.items():
                # pieces overlap: an occurrence in two of them counts once, and runs go over their borders
                place, suffix = np.unique(np.stack([np.concatenate(x) for x in zip(*parts)]), axis=1)
                cover = np.zeros(counts[row] + 1, dtype=np.int64)
                cover += np.bincount(place, minlength=len(cover)) - np.bincount(place + tests.lengths[suffix], minlength=len(cover))
                for a, b in zip(*[iter(spans[row])] * 2):  # of earlier blocks
                    cover[a] += 1
                    cover[b] -= 1
                edge = np.flatnonzero(np.diff(np.concatenate([[0], (np.cumsum(cover) > 0).astype(np.int8)])))
                spans[row] = edge.tolist()
                names = {tests.owner[s] for s in np.unique(suffix)} - {None}
                items_found[row] = sorted({*items_found[row], *map(str, names)})
                most[row] = max(most[row], int(longest(place, suffix, tests).max()))
            return counts, spans, items_found, most
        return run
    return start


def decontaminate(df: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text",
                  window: int = WINDOW, shard_words: int = SHARD_WORDS, block_bytes: int = BLOCK_BYTES, keep: list = None) -> DataFrame:
    """Adds to every row, from its whole text:

    n_words (long); hit_spans (array of word positions: start, end, start, end ... of the covered
    stretches); hit_items (ids of the items with a window in it, as strings in order);
    longest_match (long: words of the longest verbatim match, 0 if none).

    Null and empty texts have no words; items without words have no windows; an item without id
    covers words but is not listed.  An item of fewer words than a window is one window.  The
    benchmark goes to the tasks in blocks of at most `block_bytes`, one pass for each; a single
    item larger than that is a block of its own.  Repeated rows stay; a repeated item is listed once.
    An empty table gives no rows, an empty benchmark no hits.  Columns named like the results are
    replaced; any other names may be used.
    """
    fields = [("n_words", "bigint"), ("hit_spans", "array<bigint>"), ("hit_items", "array<string>"), ("longest_match", "bigint")]
    names = [n for n, _ in fields]
    keep = [c for c in (df.columns if keep is None else keep) if c not in names]
    body, n, spans, items, most = fresh(keep, "text_to_search", "found_n", "found_spans", "found_items", "found_most")
    out = df.select(*[named(c) for c in keep], named(text).alias(body), F.expr("CAST(array() AS array<bigint>)").alias(spans),
                    F.expr("CAST(array() AS array<string>)").alias(items), F.lit(0).cast("bigint").alias(most))
    spark = df.sparkSession
    source = benchmark.select(named(item).alias("i"), F.coalesce(named(item_text), F.lit("")).alias("t"))
    blocks, size = [[]], 0
    for row in source.toLocalIterator():
        size += len(row["t"].encode("utf-8"))
        if size > block_bytes and blocks[-1]:
            blocks[-1] = spark.sparkContext.broadcast(blocks[-1])
            blocks, size = [*blocks, []], len(row["t"].encode("utf-8"))
        blocks[-1].append((row["i"], row["t"]))
    blocks[-1] = spark.sparkContext.broadcast(blocks[-1])
    inner = [(n, "bigint"), (spans, "array<bigint>"), (items, "array<string>"), (most, "bigint")]
    for block in blocks:
        out = add_columns(out, [body, spans, items, most], inner, _scan(block, window, shard_words), keep=[*keep, body])
    return out.select(*[named(c) for c in keep], F.col(n).alias("n_words"), F.col(spans).alias("hit_spans"),
                      F.col(items).alias("hit_items"), F.col(most).alias("longest_match"))


def clean(df: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows without any benchmark window, all columns as they were."""
    (whole,) = fresh(df.columns, "whole_row")
    found = decontaminate(df.withColumn(whole, F.struct(*[named(c) for c in df.columns])), benchmark, keep=[whole], **options)
    return found.where(F.size("hit_spans") == 0).select(*[F.col(whole).getField(c).alias(c) for c in df.columns])
