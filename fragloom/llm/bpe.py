"""Byte-level BPE: overlapping chunks are encoded in parallel and stitched; decoding joins bytes.

The pre-tokeniser pattern looks back at nothing and covers every character, so two runs over
overlapping chunks that share one boundary agree from there on.  Long texts are cut into
overlapping chunks, every chunk is pre-tokenised and encoded on its own, and neighbours are
joined at the first boundary that both have in their overlap.  Where an overlap has none (one
run of letters longer than it), the text from the last sure boundary on is encoded again.

Null and empty texts have no ids.  Rows, also repeated ones, keep their other columns.
"""

import base64
import heapq
import struct
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .rows import add_columns, fresh, kept_columns, named

CHUNK, OVERLAP = 65_536, 1_024
#: Characters at the end of a chunk where its boundaries may differ from those of the whole text.
UNSURE = 8
CACHED, SHORT = 100_000, 48


def read_ranks(path: str) -> dict:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}


class Pieces(dict):
    """Packed ids by piece, made when first asked for, since words repeat; long pieces are not kept.

    When full, it starts anew and the last filling is asked before a piece is made again, so
    frequent pieces stay.
    """

    def __init__(self, make):
        self.make, self.last = make, {}

    def __missing__(self, piece: str) -> bytes:
        packed = self.last.get(piece)
        if packed is None:
            ids = self.make(piece)
            packed = struct.pack(f"<{len(ids)}I", *ids)
        if len(piece) <= SHORT:
            if len(self) >= CACHED:
                self.last = dict(self)
                self.clear()
            self[piece] = packed
        return packed


class Encoder:
    """Merges of one rank file."""

    def __init__(self, path: str, pattern: str):
        import regex

        self.ranks, self.pattern = read_ranks(path), regex.compile(pattern)
        self.pieces = Pieces(self.piece)

    def piece(self, piece: str) -> list:
        raw = piece.encode("utf-8")
        whole = self.ranks.get(raw)
        return [whole] if whole is not None else self._short(raw) if len(raw) <= SHORT else self._long(raw)

    def _short(self, raw: bytes) -> list:
        parts = [raw[i:i + 1] for i in range(len(raw))]
        get, none = self.ranks.get, len(self.ranks)
        ranks = [get(a + b, none) for a, b in zip(parts, parts[1:])]
        while ranks and (best := min(ranks)) < none:
            i = ranks.index(best)
            parts[i:i + 2] = [parts[i] + parts[i + 1]]
            del ranks[i]
            if i < len(ranks):
                ranks[i] = get(parts[i] + parts[i + 1], none)
            if i:
                ranks[i - 1] = get(parts[i - 1] + parts[i], none)
        return [self.ranks[p] for p in parts]

    def _long(self, raw: bytes) -> list:
        """The same merges over a linked list with a heap: n log n for one very long piece."""
        n, get = len(raw), self.ranks.get
        end, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = []

        def offer(i):
            j = end[i]
            if j < n and (rank := get(raw[i:end[j]])) is not None:
                heapq.heappush(heap, (rank, i, end[j]))

        for i in range(n):
            offer(i)
        alive = bytearray(b"\x01") * n
        while heap:
            _, i, stop = heapq.heappop(heap)
            if not alive[i] or end[i] >= n or end[end[i]] != stop:
                continue
            alive[end[i]] = 0
            end[i] = stop
            if stop < n:
                before[stop] = i
            offer(i)
            if i:
                offer(before[i])
        out, i = [], 0
        while i < n:
            out.append(self.ranks[raw[i:end[i]]])
            i = end[i]
        return out

    def encode(self, text: str) -> bytes:
        """Packed ids."""
        return b"".join(map(self.pieces.__getitem__, self.pattern.findall(text)))

    def encode_marked(self, text: str, zones: list) -> tuple:
        """Packed ids, and for each zone (from, to) its boundaries as [position, number of ids before it]."""
        ids, n, marks = [], 0, [[] for _ in zones]
        for m in self.pattern.finditer(text):
            for zone, out in zip(zones, marks):
                if zone[0] <= m.start() <= zone[1]:
                    out.append([m.start(), n])
            ids.append(self.pieces[m[0]])
            n += len(ids[-1]) // 4
        return b"".join(ids), marks


@lru_cache(maxsize=1)
def shared_encoder(path: str, pattern: str) -> Encoder:
    """One encoder for all tasks of a worker, so its pieces stay known."""
    return Encoder(path, pattern)


@lru_cache(maxsize=1)
def byte_table(path: str) -> dict:
    return {i: b for b, i in read_ranks(path).items()}


def unpack(raw: bytes):
    import numpy as np

    return np.frombuffer(raw, dtype="<u4")


def stitch(chunks: list, step: int, encoder) -> bytes:
    """Packed ids of the whole text; chunks: (text, packed ids, left marks, right marks) in order, positions
    counted from each chunk's start."""
    out, base, grow = [], 0, 1  # ids before the open chunk; its first ids that the one before covers
    text, ids, _, right = chunks[0]
    origin, i = 0, 1
    while i < len(chunks):
        where = i * step
        left = {where + pos: at for pos, at in chunks[i][2]}
        joint = next(((at, left[origin + pos]) for pos, at in right if at >= base and origin + pos in left), None)
        if joint:
            out.append(ids[4 * base:4 * joint[0]])
            text, ids, _, right = chunks[i]
            origin, base, grow, i = where, joint[1], 1, i + 1
            continue
        # No common boundary: the open chunk takes in the next ones, twice as many each time.
        for part in chunks[i:i + grow]:
            text += part[0][origin + len(text) - i * step:]
            i += 1
        grow *= 2
        ids, (right,) = encoder.encode_marked(text, [(i * step - origin, len(text) - UNSURE)])
    return b"".join([*out, ids[4 * base:]])


def encode(df: DataFrame, text: str, path: str, pattern: str, chunk: int = CHUNK, overlap: int = OVERLAP,
           keep: list = None, back: bool = False) -> DataFrame:
    """Adds `ids` (binary: little-endian unsigned 32-bit) and `n_tokens` (long) of every whole text.

    back: the ids are decoded again by the same worker, which adds `decoded` as decode() does; a second step
    would hold a second Python process for every task.

    path: a rank file that every executor has; pattern: the pre-tokeniser.  Texts of one chunk
    need no stitching and no shuffle; only longer ones are dealt out by chunk and grouped again
    by row, so what meets in one task is one row's chunks.
    Null and empty texts have no ids.  Repeated rows stay.  An empty table gives no rows.  Columns
    named like a new one are replaced; any other names may be used.
    """
    fields = [("ids", "binary"), ("n_tokens", "bigint"), *([("decoded", "binary")] if back else [])]
    keep = kept_columns(df, [n for n, _ in fields], keep)
    body, chunks = fresh(keep, "text_to_encode", "chunks_to_join")
    step = chunk - overlap
    source = df.select(*[named(c) for c in keep], F.coalesce(named(text), F.lit("")).alias(body))
    n_chunks = F.greatest(F.lit(1), F.ceil((F.length(body) - overlap) / step))

    def results(ids):
        return [ids, [len(i) // 4 for i in ids], *([decoded(ids, path)] if back else [])]

    def whole():
        encoder = shared_encoder(path, pattern)

        def run(texts):
            return results([encoder.encode(t) for t in texts])
        return run

    def pieces():
        encoder = shared_encoder(path, pattern)

        def run(texts):
            done = [(ids, *marks) for ids, marks in (
                encoder.encode_marked(t, [(0, overlap - UNSURE), (step, len(t) - UNSURE)]) for t in texts)]
            return [list(column) for column in zip(*done)] if done else [[], [], []]
        return run

    def joined():
        encoder = shared_encoder(path, pattern)

        def run(rows):
            return results([stitch([(c["text"], c["ids"], c["left"], c["right"]) for c in row], step, encoder) for row in rows])
        return run

    short = add_columns(source.where(n_chunks == 1), [body], fields, whole, keep=keep)
    long = source.where(n_chunks > 1).select(
        F.monotonically_increasing_id().alias("_row"), F.struct(F.lit(0).alias("_"), *[named(c) for c in keep]).alias("_kept"), F.col(body).alias("_text"))
    n_chunks = F.ceil((F.length("_text") - overlap) / step)
    cut = F.transform(F.sequence(F.lit(0), n_chunks - 1), lambda k: F.struct(
        k.alias("k"), F.substring("_text", (k * step + 1).cast("int"), F.lit(chunk)).alias("text")))
    rows = long.select("_row", "_kept", F.explode(cut).alias("_c"))
    rows = rows.select("_row", "_kept", F.col("_c.k").alias("_k"), F.col("_c.text").alias("_text"))
    marks = "array<array<int>>"
    done = add_columns(rows.repartition("_row", "_k"), ["_text"], [("_ids", "binary"), ("_left", marks), ("_right", marks)], pieces)
    grouped = done.groupBy("_row").agg(
        F.first("_kept").alias("_kept"),
        F.sort_array(F.collect_list(F.struct(F.col("_k").alias("k"), F.col("_text").alias("text"), F.col("_ids").alias("ids"),
                                             F.col("_left").alias("left"), F.col("_right").alias("right")))).alias("_chunks"))
    flat = grouped.select(*[F.col("_kept").getField(c).alias(c) for c in keep], F.col("_chunks").alias(chunks))
    return short.unionByName(add_columns(flat, [chunks], fields, joined, keep=keep))


def decoded(column: list, path: str) -> list:
    """The bytes of packed ids, concatenated; None stays."""
    table = byte_table(path)
    return [None if raw is None else b"".join(map(table.__getitem__, unpack(raw).tolist())) for raw in column]


def decode(df: DataFrame, path: str, ids: str = "ids", keep: list = None) -> DataFrame:
    """Adds `decoded` (binary): the raw bytes of the ids, concatenated.  Null ids decode to null."""
    return add_columns(df, [ids], [("decoded", "binary")], lambda: lambda column: [decoded(column, path)], keep)
