"""Ranked lexical search: branch and bound over tries of frequency-ordered document vectors.

A document's vector holds only terms that some item asks for, the most frequent first, so documents
share the paths of a trie; a node stands for a run of sorted vectors.  It knows the largest term
frequency of each term below it and the least length norm, which bound every score below it.  An
item's search goes down the trie, best bound first, and leaves out what cannot reach its first k.
"""

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.lineage import materialise
from .rows import named

#: UTF-8 bytes of item texts that go to the tasks in one pass over the documents.
BLOCK_BYTES = 8 << 20
#: Documents and postings of one trie at most (one document more may fill it), and documents of a leaf.
TRIE_DOCS, TRIE_POSTINGS, LEAF = 1 << 13, 1 << 20, 48

# --- fixed values: weights of the score ---
UNIT, NORM, SHARE, TF_UNIT, NORM_UNIT = 1000, 100, 50, 1_000_000_000, 20

_TERMS = bytes((b | 0x20 if 0x41 <= b <= 0x5A else b) if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256))


def terms(text: bytes) -> list:
    """Maximal runs of ASCII letters and digits and all non-ASCII bytes, A-Z lower-cased."""
    return text.translate(_TERMS).split()


def search(docs: DataFrame, items: DataFrame, k: int = 50, key: str = "doc_id", text: str = "text",
           item_key: str = "item_id", item_text: str = "text", trie_docs: int = TRIE_DOCS, leaf: int = LEAF) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents of every item, scores above 0 only.

    score: the sum over the item's different terms of w * ((10^9 tf) div (1000 tf + 20 m)), with
    w = floor(1000 ln((2N + 2) / (2 df + 1))) and m = 50 + (50 n N) div L; N documents with a term, L
    terms of all of them, n of one.  Equal scores rank by ascending integer key, NULL last.

    NULL and empty texts have no term: such a document is never found and does not count in N, such
    an item gives no rows.  Rows are rows: a repeated document is found as often as it comes, and a
    repeated or unnamed item gets rows of its own.  Texts are read whole.  Other columns are ignored.
    An empty table on either side gives no rows.  Item texts pass the driver block by block, each
    with a pass of its own over the documents; only statistics of the item's terms come back to it.
    """
    asked = materialise(items.select(named(item_key).alias("item_id"), named(item_text).alias("text"))
                        .where("text IS NOT NULL").withColumn("item", F.monotonically_increasing_id()))
    size = asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_blocks = -(-size // BLOCK_BYTES)
    block = F.pmod(F.xxhash64("item"), F.lit(max(n_blocks, 1)))
    found, whole = asked.limit(0).select("item", F.lit(0).cast("bigint").alias("doc"), F.lit(0).cast("bigint").alias("score")), None
    for i in range(n_blocks):
        wanted = {row["item"]: sorted(set(terms(row["text"].encode()))) for row in asked.where(block == i).select("item", "text").toLocalIterator()}
        best, whole = _search_block(docs, wanted, k, key, text, whole, trie_docs, leaf)
        found = found.unionByName(best)
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc"))
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.join(asked.select("item", "item_id"), "item").select(
        "item_id", F.col("rank").cast("int").alias("rank"), F.col("doc").alias("doc_id"), "score")


def _search_block(docs: DataFrame, wanted: dict, k: int, key: str, text: str, whole: tuple, trie_docs: int, leaf: int) -> tuple:
    """(item, doc, score) of the first k in every trie's task, for the items of one block; and (N, L)."""
    vocabulary = sorted({t for ts in wanted.values() for t in ts})
    vectors = materialise(_vectors(docs, vocabulary, key, text))
    if whole is None:
        whole = tuple(vectors.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first())
    n, length = whole
    df = np.zeros(len(vocabulary), np.int64)
    for code, count in vectors.select(F.explode("codes").alias("code")).groupBy("code").count().toLocalIterator():
        df[code] = count
    weights = np.array([math.floor(UNIT * math.log((2 * n + 2) / (2 * int(d) + 1))) for d in df], np.int64)
    rank = np.empty(len(df), np.int64)
    rank[np.argsort(-df, kind="stable")] = np.arange(len(df))  # the most frequent term has rank 0
    by_rank = np.empty_like(weights)
    by_rank[rank] = weights
    code = {t: i for i, t in enumerate(vocabulary)}
    queries = {item: np.sort(rank[[code[t] for t in ts]]) for item, ts in wanted.items() if ts}
    if not queries or not n:
        return vectors.limit(0).select(F.col("n").alias("item"), "doc", F.col("n").alias("score")), whole

    def run(batches):
        best = {item: Best(k) for item in queries}
        for part in _portions(batches, trie_docs, TRIE_POSTINGS):
            norm = NORM - SHARE + SHARE * part["n"] * n // length
            trie = Trie(part["doc"], part["none"], norm, rank[part["codes"]], part["tfs"], part["sizes"], leaf)
            for item, query in queries.items():
                trie.search(query, by_rank[query], best[item])
        for item, b in best.items():
            yield pa.record_batch([pa.array(np.full(len(b.docs), item)), pa.array(b.docs, pa.int64(), mask=b.none), pa.array(b.scores)],
                                  names=["item", "doc", "score"])

    searched = vectors.where(F.size("codes") > 0).mapInArrow(run, "item long, doc long, score long")
    return materialise(searched), whole


def _vectors(docs: DataFrame, vocabulary: list, key: str, text: str) -> DataFrame:
    """(doc, n, codes, tfs) of the documents with a term; codes are places in the vocabulary."""
    def run(batches):
        code = {t: i for i, t in enumerate(vocabulary)}
        for batch in batches:
            keep, sizes, counts, codes, tfs = [], [0], [], [], []
            for i, value in enumerate(batch.column("text").cast(pa.binary()).to_pylist()):
                words = terms(value)
                if not words:
                    continue
                held = Counter(map(code.get, words))
                held.pop(None, None)
                keep.append(i)
                counts.append(len(words))
                codes.extend(held)
                tfs.extend(held.values())
                sizes.append(len(codes))
            lists = [pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(v, t)) for v, t in ((codes, pa.int32()), (tfs, pa.int64()))]
            yield pa.record_batch([batch.column("doc").take(pa.array(keep, pa.int64())), pa.array(counts, pa.int64()), *lists],
                                  names=["doc", "n", "codes", "tfs"])

    texts = docs.select(named(key).cast("bigint").alias("doc"), named(text).alias("text")).where("text IS NOT NULL")
    return texts.mapInArrow(run, "doc long, n long, codes array<int>, tfs array<long>")


def _portions(batches, most_docs: int, most_postings: int):
    """Columns of as many rows as one trie may hold, whatever the size of a batch."""
    held, docs, postings = [], 0, 0
    for batch in batches:
        sizes = np.diff(batch.column("codes").offsets.to_numpy())
        start = 0
        while start < batch.num_rows:
            filled = np.cumsum(sizes[start:])
            stop = start + min(most_docs - docs, int(np.searchsorted(filled, most_postings - postings)) + 1, batch.num_rows - start)
            held.append(batch.slice(start, stop - start))
            docs, postings = docs + stop - start, postings + int(filled[stop - start - 1])
            start = stop
            if docs >= most_docs or postings >= most_postings:
                yield _columns(held)
                held, docs, postings = [], 0, 0
    if held:
        yield _columns(held)


def _columns(held: list) -> dict:
    table = pa.Table.from_batches(held).combine_chunks()
    doc, codes = table.column("doc").chunk(0), table.column("codes").chunk(0)
    return {"doc": doc.fill_null(0).to_numpy(), "none": doc.is_null().to_numpy(zero_copy_only=False), "n": table.column("n").chunk(0).to_numpy(),
            "sizes": np.diff(codes.offsets.to_numpy()).astype(np.int64), "codes": codes.flatten().to_numpy(),
            "tfs": table.column("tfs").chunk(0).flatten().to_numpy()}


class Best:
    """The first k (score, document) of one item so far."""

    def __init__(self, k: int):
        self.k, self.least = k, 1  # scores below `least` cannot enter
        self.scores, self.docs, self.none = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool)

    def add(self, scores, docs, none):
        s, d, m = np.concatenate([self.scores, scores]), np.concatenate([self.docs, docs]), np.concatenate([self.none, none])
        order = np.lexsort((d, m, -s))[:self.k]
        self.scores, self.docs, self.none = s[order], d[order], m[order]
        if len(order) == self.k:
            self.least = max(int(self.scores[-1]), 1)


class Trie:
    """Documents sorted by their vectors of ranks; nodes are runs of them with a common path."""

    def __init__(self, doc, none, norm, ranks, tfs, sizes, leaf):
        self.leaf = leaf
        owner = np.repeat(np.arange(len(doc)), sizes)
        order = np.lexsort((ranks, owner))
        paths = np.split(ranks[order].astype(">u4"), np.cumsum(sizes)[:-1])
        place = np.empty(len(doc), np.int64)
        by_path = sorted(range(len(doc)), key=lambda i: paths[i].tobytes())
        place[by_path] = np.arange(len(doc))
        self.doc, self.none, self.norm = doc[by_path], none[by_path], norm[by_path]
        self.paths = [paths[i] for i in by_path]
        order = np.lexsort((ranks, place[owner]))
        self.owner, self.ranks, self.tfs = place[owner][order], ranks[order], tfs[order]
        self.first = np.concatenate([[0], np.cumsum(sizes[by_path])])
        self.root = self._node(0, len(doc), 0)

    def _node(self, a: int, b: int, depth: int) -> dict:
        """The node of documents a to b, whose first `depth` ranks agree."""
        children = []
        while b - a > self.leaf:
            first, last = self.paths[a], self.paths[b - 1]
            shared = min(len(first), len(last))
            differ = np.flatnonzero(first[depth:shared] != last[depth:shared])
            depth = depth + int(differ[0]) if len(differ) else shared
            at = self.first[a:b] + depth
            branch = np.where(at < self.first[a + 1:b + 1], self.ranks[np.minimum(at, len(self.ranks) - 1)], -1)
            ends = a + np.append(np.flatnonzero(np.diff(branch)) + 1, b - a)
            if len(ends) == 1:  # documents of one and the same path
                return self._inner(children + [self._leaf(i, min(i + self.leaf, b)) for i in range(a, b, self.leaf)])
            wide, start, small = [], a, a
            for end in map(int, ends):  # small branches beside each other share a leaf
                if end - small > self.leaf:
                    if small < start:
                        children.append(self._leaf(small, start))
                    small = start
                if end - start > self.leaf:
                    wide.append((start, end))
                    small = end
                start = end
            if small < b:
                children.append(self._leaf(small, b))
            if len(wide) != 1:
                return self._inner(children + [self._node(*w, depth + 1) for w in wide])
            (a, b), depth = wide[0], depth + 1  # one wide branch: its branches stand beside the small ones
        return self._inner(children + [self._leaf(a, b)])

    def _leaf(self, a: int, b: int) -> dict:
        part = slice(self.first[a], self.first[b])
        order = np.argsort(self.ranks[part], kind="stable")
        ranks, owner, tfs = self.ranks[part][order], self.owner[part][order], self.tfs[part][order]
        starts = np.flatnonzero(np.diff(ranks, prepend=-1))
        each = (TF_UNIT * tfs) // (UNIT * tfs + NORM_UNIT * self.norm[owner])
        return {"terms": ranks[starts], "most": np.maximum.reduceat(tfs, starts), "norm": int(self.norm[a:b].min()), "range": (a, b),
                "starts": np.append(starts, len(ranks)), "owner": owner - a, "each": each}

    @staticmethod
    def _inner(children: list) -> dict:
        if len(children) == 1:
            return children[0]
        ranks, most = np.concatenate([c["terms"] for c in children]), np.concatenate([c["most"] for c in children])
        order = np.argsort(ranks, kind="stable")
        starts = np.flatnonzero(np.diff(ranks[order], prepend=-1))
        return {"terms": ranks[order][starts], "most": np.maximum.reduceat(most[order], starts), "norm": min(c["norm"] for c in children),
                "children": children}

    @staticmethod
    def _bound(node: dict, query, weights) -> tuple:
        """No document below the node scores more than this; and the item's terms that it holds."""
        at = np.searchsorted(node["terms"], query)
        at[at == len(node["terms"])] = 0
        has = node["terms"][at] == query
        most = node["most"][at[has]]
        return int((weights[has] * ((TF_UNIT * most) // (UNIT * most + NORM_UNIT * node["norm"]))).sum()), at[has], weights[has]

    def search(self, query, weights, best: Best) -> None:
        """Add the documents that reach the first k of an item: depth first, the best bound first."""
        stack = [(*self._bound(self.root, query, weights), self.root)]
        while stack:
            bound, at, held, node = stack.pop()
            if bound < best.least:
                continue
            if "children" in node:
                below = [(*self._bound(c, query, weights), c) for c in node["children"]]
                stack.extend(sorted((x for x in below if x[0] >= best.least), key=lambda x: x[0]))
                continue
            lengths = node["starts"][at + 1] - node["starts"][at]
            ends = np.cumsum(lengths)
            place = np.arange(ends[-1]) + np.repeat(node["starts"][at] - ends + lengths, lengths)
            a, b = node["range"]
            # sums stay below 2^53, so doubles hold them exactly
            scores = np.bincount(node["owner"][place], np.repeat(held, lengths) * node["each"][place], b - a).astype(np.int64)
            good = np.flatnonzero(scores >= best.least)
            if len(good):
                best.add(scores[good], self.doc[a:b][good], self.none[a:b][good])
