"""SimHash near-duplicates by anchor points of a covering code.

A fingerprint has 64 bits, and links reach over at most three.  Of two linked fingerprints one
32-bit half differs in at most one bit, so each half is searched with threshold one.  Anchors of
a half are the words of the Hamming code (31, 26), times one free bit: covering radius one.
Every half goes to its home (the nearest anchor) and to every anchor that any half within the
threshold may have as home: at most 17 of the 2^27 anchors, all within radius plus threshold.
Of two halves within the threshold, one's home is then among the other's anchors, so comparing
per anchor finds every link.

Equal fingerprints are merged before the search, so copies never meet there.  In an anchor only
the links of a spanning forest are returned, not all pairs.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.lineage import materialise
from .components import components
from .rows import add_columns, named

SEED, SHINGLE, BITS, NEAR = 42, 3, 64, 3
#: The most shingles whose bits are held unpacked at a time.
SLAB = 65_536


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """Majority bits of the XXH64 of all word shingles; ties and empty texts give zero bits."""
    import numpy as np
    from xxhash import xxh64_intdigest

    words = text.encode("utf-8").lower().split()  # on bytes: ASCII letters and ASCII white space only
    if not words:
        return 0
    grams = [words] if len(words) < shingle else zip(*[words[i:] for i in range(shingle)])
    hashes = np.array([xxh64_intdigest(b" ".join(g), SEED) for g in grams], dtype="<u8")
    ones = np.zeros(BITS, dtype=np.int64)
    for i in range(0, len(hashes), SLAB):
        part = hashes[i:i + SLAB].view(np.uint8).reshape(-1, BITS // 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, text: str = "text", shingle: int = SHINGLE, keep: list = None) -> DataFrame:
    """Adds `fingerprint`: the 64 bits as a signed long.  Null texts count as empty: zero."""
    def start():
        def run(texts):
            prints = [fingerprint(t or "", shingle) for t in texts]
            return [[p - (1 << BITS) if p >> (BITS - 1) else p for p in prints]]
        return run

    return add_columns(df, [text], [("fingerprint", "bigint")], start, keep)


def anchors(halves):
    """Column 0: the home of each 32-bit half; the others: every further anchor it may be compared at."""
    import numpy as np

    word, free = halves & np.uint32(0x7FFFFFFF), halves & np.uint32(0x80000000)
    syndrome = np.zeros(len(halves), dtype=np.uint32)
    for place in range(1, 32):
        syndrome ^= np.where(word >> np.uint32(place - 1) & np.uint32(1), np.uint32(place), np.uint32(0))

    def bit(places):
        return np.where(places > 0, np.uint32(1) << (np.maximum(places, 1) - np.uint32(1)), np.uint32(0)).astype(np.uint32)

    home = word ^ bit(syndrome) | free
    out = [home, home ^ np.uint32(0x80000000)]
    for place in range(1, 32):  # what the half decodes to when this bit is flipped
        rest = syndrome ^ np.uint32(place)
        out.append(word ^ bit(np.full_like(word, place)) ^ bit(rest) | free)
    out = np.stack(out, axis=1)
    out[:, 1:].sort(axis=1)
    fresh = np.ones(out.shape, dtype=bool)
    fresh[:, 2:] = out[:, 2:] != out[:, 1:-1]
    fresh[:, 1:] &= out[:, 1:] != home[:, None]
    return out, fresh


def _replicas(batches):
    import numpy as np
    import pyarrow as pa

    for batch in batches:
        prints = batch.column(0).to_numpy().view(np.uint64)
        for half in (0, 1):
            part = (prints >> np.uint64(32 * half)).astype(np.uint32)
            out, fresh = anchors(part)
            row, column = np.nonzero(fresh)
            key = out[row, column].astype(np.int64) | np.int64(half) << np.int64(32)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(prints[row].view(np.int64)), pa.array(column == 0)],
                                             ["anchor", "fp", "home"])


def forest(key, prints, home, near: int = NEAR) -> list:
    """Index pairs of rows, sorted by key, that link within their key: enough to connect what links."""
    import numpy as np

    root, links = np.arange(len(key)), []

    def top(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    at, apart = np.arange(len(key)), 0
    while len(at):
        apart += 1
        at = at[at + apart < len(key)]
        at = at[key[at] == key[at + apart]]
        other = at + apart
        close = (home[at] | home[other]) & (np.bitwise_count(prints[at] ^ prints[other]) <= near)
        for i, j in zip(at[close].tolist(), other[close].tolist()):
            a, b = top(i), top(j)
            if a != b:
                root[max(a, b)] = min(a, b)
                links.append((i, j))
    return links


def _compare(near):
    """Streams rows sorted by anchor; only the rows of the anchor that is still open are held."""
    def run(batches):
        import numpy as np
        import pyarrow as pa

        held = None

        def links(key, fp, home):
            prints = fp.view(np.uint64)
            twin = np.zeros(len(key), dtype=bool)
            twin[1:] = key[1:] == key[:-1]
            twin[:-1] |= twin[1:]
            key, fp, prints, home = key[twin], fp[twin], prints[twin], home[twin]
            pairs = np.array(forest(key, prints, home, near), dtype=np.int64).reshape(-1, 2)
            return pa.RecordBatch.from_arrays([pa.array(fp[pairs[:, 0]]), pa.array(fp[pairs[:, 1]])], ["u", "v"])

        for batch in batches:
            now = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
            if held is not None:
                now = [np.concatenate(x) for x in zip(held, now)]
            if not len(now[0]):
                continue
            cut = np.searchsorted(now[0], now[0][-1])
            yield links(*[x[:cut] for x in now])
            held = [x[cut:] for x in now]
        if held is not None:
            yield links(*held)
    return run


def links(prints: DataFrame, near: int = NEAR) -> DataFrame:
    """Distinct fingerprints (fingerprint) -> links (u, v) that connect every two within `near` bits."""
    if not 0 <= near <= 3:
        raise ValueError("halves are searched with threshold one, so at most three bits may differ")
    spread = prints.select("fingerprint").mapInArrow(_replicas, "anchor bigint, fp bigint, home boolean")
    spread = spread.repartition("anchor").sortWithinPartitions("anchor")
    return spread.mapInArrow(_compare(near), "u bigint, v bigint")


def _labelled(df: DataFrame, id: str, text: str, shingle: int, near: int) -> DataFrame:
    """(_id, _hash of the text, fingerprint, root, component_id), one row for each row; root: the component's least fingerprint."""
    source = df.select(named(id).alias("_id"), F.xxhash64(named(text)).alias("_hash"), named(text).alias("_text"))
    docs = materialise(fingerprints(source, "_text", shingle, ["_id", "_hash"]))
    merged = docs.groupBy("fingerprint").agg(F.min("_id").alias("_first"))
    joined = components(links(merged, near)).withColumnRenamed("node", "fingerprint")
    rooted = merged.join(joined, "fingerprint", "left").withColumn("root", F.coalesce("root", "fingerprint"))
    least = rooted.groupBy("root").agg(F.min("_first").alias("component_id"))
    labels = rooted.select("fingerprint", "root").join(least, "root").select("fingerprint", "root", "component_id")
    return docs.join(labels, "fingerprint")


def near_duplicates(df: DataFrame, id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, near: int = NEAR) -> DataFrame:
    """One row for each row: (id, fingerprint as signed long, component_id).

    component_id: the smallest id among the rows whose fingerprints can be reached over links of
    at most `near` bits; null where all of these ids are null.  Equal texts share a component,
    also empty and null ones (fingerprint zero).  Repeated ids stay repeated rows.
    """
    return _labelled(df, id, text, shingle, near).select(F.col("_id").alias(id), "fingerprint", "component_id")


def keep_first(df: DataFrame, id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, near: int = NEAR) -> DataFrame:
    """The input's columns, one row of each component: the one with the component's smallest id.

    Where rows of the component repeat that id, the one with the smallest text hash stays.  In a
    component without any id all rows count as repeating the null id.  Components are told apart
    by their root, so ids that several components repeat, or lack, cost none of them its row.  Of
    rows with equal id and text the one whose columns, written as JSON, sort first stays.  Columns
    may have any names.  An empty table gives no rows.
    """
    found = _labelled(df, id, text, shingle, near)
    first = (found.where(F.col("_id").eqNullSafe(F.col("component_id"))).groupBy("root", "_id", "_hash").agg(F.count(F.lit(1)).alias("_n"))
             .groupBy("root").agg(F.min_by(F.struct("_id", "_hash", "_n"), "_hash").alias("_f"))
             .select("_f._id", "_f._hash", "_f._n"))
    whole = df.select(F.struct(*[named(c) for c in df.columns]).alias("row"), named(id).alias("id"), F.xxhash64(named(text)).alias("digest"))
    same = F.col("id").eqNullSafe(F.col("_id")) & (F.col("digest") == F.col("_hash"))
    one = whole.join(first.where("_n = 1"), same, "left_semi")
    copies = whole.join(first.where("_n > 1"), same, "left_semi").groupBy("id", "digest").agg(F.min_by("row", F.to_json("row")).alias("row"))
    return one.select("row").unionByName(copies.select("row")).select(*[F.col("row").getField(c).alias(c) for c in df.columns])
