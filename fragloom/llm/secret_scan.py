"""Secret scan: fixed patterns, and a battery of randomness tests under false-discovery control.

Base spans come from three fixed patterns.  Further candidates are long tokens.  For each its
encoding is inferred (hexadecimal, base32, base64) and three tests ask whether it looks like
random symbols of that alphabet: chi-squared uniformity of the symbols, runs above and below
the middle of the alphabet, and serial correlation of neighbours.  Fisher's method joins them.

Ordinary text is the null hypothesis.  Each text gives decoys: stretches of its own letters,
from its whole length and in the lengths of the candidates, mapped into the alphabet and tested
alike.  For every encoding and length band the decoys' scores give p-values, and the step-up rule
of Benjamini and Hochberg over that band's candidates gives its cutoff: short tokens, which pass
by luck more often, need a better score.  Decoys and candidates count once for each different
text, so copies weigh nothing.  A band with too few decoys to certify anything adds no spans.
"""

import math
import re
import zlib
from functools import lru_cache

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.lineage import materialise, remove
from .rows import add_columns, fresh, kept_columns, named

# --- fixed values: kinds in their order, patterns, least lengths ---
KINDS = ["assign", "access", "hex"]
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS, HEX = re.compile(r"AKIA[A-Z0-9]+"), re.compile(r"[0-9a-f]{24,}")
LEAST_VALUE, LEAST_ACCESS = 6, 20
ALPHABETS = {"hex": "0123456789abcdef", "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
             "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"}
# --- end of fixed values ---

CANDIDATE = re.compile(r"[A-Za-z0-9+/_-]{16,}")
WORD = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z]{1,15}(?![A-Za-z0-9+/_-])")
ENCODINGS = list(ALPHABETS)
BANDS = [16, 20, 24, 32, 40, 64, 128]
#: Scores are compared on this grid; the share of false discoveries that is allowed in each band.
GRID, RATE = 200, 0.01
#: In each band a decoy begins every so many letters, the least length, so that no letter is passed over; so many
#: letters, a multiple of STEP, are scored at a time; all lengths (at most 255, as counts are bytes) and STEP are multiples of BLOCK.
STEP, SLAB, BLOCK = BANDS[0], 1 << 16, 4
_CODES = [{c: i for i, c in enumerate(a)} for a in ALPHABETS.values()]
_CODES[0].update({c.upper(): i for c, i in list(_CODES[0].items())})
_CODES[2].update({"-": 62, "_": 63})


def base_spans(text: str) -> list:
    """(start, kind number, end), by start, then kind; end exclusive, in code points."""
    spans = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_VALUE]
    spans += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= LEAST_ACCESS]
    spans += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(spans)


def encoding(token: str) -> int:
    """The narrowest alphabet that has all its characters: 0 hex, 1 base32, 2 base64."""
    if re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", token):
        return 0
    return 1 if re.fullmatch(r"[A-Z2-7]+", token) else 2


def band(length: int) -> int:
    return sum(length >= b for b in BANDS) - 1


def _tail(z: float) -> float:
    return max(0.5 * math.erfc(z / math.sqrt(2)), 1e-300)


def battery(codes: list, size: int) -> float:
    """Joint p-value of the three tests for "these are random symbols 0 .. size-1"; small: not random."""
    n = len(codes)
    if n < 3:
        return 0.0
    counts = {}
    for c in codes:
        counts[c] = counts.get(c, 0) + 1
    chi = size / n * sum(v * v for v in counts.values()) - n
    mean, var = size - 1, 2 * (size - 1) * (1 - 1 / n)
    dof, scale = 2 * mean * mean / var, var / (2 * mean)  # a scaled chi-squared with these two moments
    z = ((max(chi, 1e-9) / scale / dof) ** (1 / 3) - (1 - 2 / (9 * dof))) / math.sqrt(2 / (9 * dof))
    tests = [_tail(z)]
    high = [c >= size / 2 for c in codes]
    above = sum(high)
    below = n - above
    runs = 1 + sum(a != b for a, b in zip(high, high[1:]))
    if above and below:
        expected = 2 * above * below / n + 1
        spread = (expected - 1) * (expected - 2) / (n - 1)
        tests.append(min(1.0, 2 * _tail(abs(runs - expected) / math.sqrt(spread))) if spread > 0 else 1.0)
    else:
        tests.append(max(2.0 ** (1 - n), 1e-300))
    middle = sum(codes) / n
    square = sum((c - middle) ** 2 for c in codes)
    serial = sum((a - middle) * (b - middle) for a, b in zip(codes, codes[1:])) / square if square else 1.0
    tests.append(min(1.0, 2 * _tail(abs(serial + 1 / n) * math.sqrt(n))))
    half = -sum(map(math.log, tests))
    return math.exp(-half) * (1 + half + half * half / 2)


def score(p: float) -> int:
    """A p-value's place on the grid, in proportion to -log10 from 1e-12 (0) to 1 (GRID)."""
    return int(GRID * max(0.0, 1 + math.log10(max(p, 1e-300)) / 12))


def token_score(token: str, kind: int) -> int:
    codes = _CODES[kind]
    return score(battery([codes[c] for c in token], len(ALPHABETS[ENCODINGS[kind]])))


def candidates(text: str, spans: list) -> list:
    """(start, end, encoding, band, score) of the long tokens that meet no base span (spans: by start)."""
    out, next_span, reach = [], 0, 0
    for m in CANDIDATE.finditer(text):
        while next_span < len(spans) and spans[next_span][0] < m.end():
            reach = max(reach, spans[next_span][2])
            next_span += 1
        if reach <= m.start() and not m[0].isdigit():  # a bare number is no secret of these encodings
            kind = encoding(m[0])
            out.append((m.start(), m.end(), kind, band(len(m[0])), token_score(m[0], kind)))
    return out


def _log_tails(z, positive: bool = False):
    """Logarithms of _tail(), of a whole array (Chebyshev fit of erfc, to 1.2e-7 of its value); positive: none is below 0."""
    import numpy as np

    far = np.abs(z) / math.sqrt(2)
    t = 1 / (1 + far / 2)
    fit = np.zeros_like(t)
    for c in (0.17087277, -0.82215223, 1.48851587, -1.13520398, 0.27886807, -0.18628806, 0.09678418, 0.37409196, 1.00002368, -1.26551223):
        fit *= t
        fit += c
    upper = np.log(t / 2) - far * far + fit
    return np.maximum(upper if positive else np.where(z >= 0, upper, np.log1p(-np.exp(upper))), math.log(1e-300))


@lru_cache(maxsize=None)
def _tables(n: int, size: int) -> tuple:
    """Logarithms of the first two p-values of battery() for n symbols: by the squared counts, and by
    n * symbols of the upper half + changes of half.  Both are small whole numbers, so each value is worked out once."""
    import numpy as np

    chi = size / n * np.arange(n * n + 1) - n
    mean, var = size - 1, 2 * (size - 1) * (1 - 1 / n)
    dof, scale = 2 * mean * mean / var, var / (2 * mean)
    z = (np.cbrt(np.maximum(chi, 1e-9) / scale / dof) - (1 - 2 / (9 * dof))) / math.sqrt(2 / (9 * dof))
    above, changes = np.divmod(np.arange((n + 1) * n), n)
    both = 2 * above * (n - above)
    expected = both / n + 1
    spread = (expected - 1) * (expected - 2) / (n - 1)
    wide = spread > 0
    away = np.abs(1 + changes - expected) / np.sqrt(np.where(wide, spread, 1))
    second = np.where(both == 0, math.log(max(2.0 ** (1 - n), 1e-300)), np.where(wide, np.minimum(_log_tails(away) + math.log(2), 0), 0))
    return _log_tails(z), second


def _scores(n: int, size: int, squares, above, changes, products, total, ends, total_squares):
    """The scores of battery() for many stretches of n symbols, from whole-number sums of each: squared
    counts, symbols of the upper half, changes of half, products of neighbours, symbols, first and last, squared symbols."""
    import numpy as np

    first, second = _tables(n, size)
    products, total, ends, total_squares = (x.astype(np.float64) for x in (products, total, ends, total_squares))  # whole numbers, so exact
    around = n * (n * total_squares - total * total)
    along = n * n * products - n * total * (2 * total - ends) + (n - 1) * total * total
    flat = around == 0  # then along is 0 too, and the correlation 1
    serial = (along + flat) / (around + flat)
    third = np.minimum(_log_tails(np.abs(serial + 1 / n) * math.sqrt(n), True) + math.log(2), 0)
    half = np.maximum(-(first[squares] + second[above.astype(np.intp) * n + changes] + third), 0)
    log10 = (np.log(1 + half + half * half / 2) - half) / math.log(10)
    return (GRID * np.maximum(0, 1 + log10 / 12)).astype(np.int16)


def batteries(codes, size: int) -> list:
    """The scores of battery() for stretches of one length, the rows of `codes`."""
    import numpy as np

    rows, n = codes.shape
    c = codes.astype(np.int64)
    counts = np.bincount((c + size * np.arange(rows)[:, None]).ravel(), minlength=rows * size).reshape(rows, size)
    high = 2 * c >= size
    return _scores(n, size, (counts * counts).sum(1), high.sum(1), (high[:, 1:] != high[:, :-1]).sum(1), (c[:, 1:] * c[:, :-1]).sum(1),
                   c.sum(1), c[:, 0] + c[:, -1], (c * c).sum(1)).tolist()


def _bin(kind: int, at: int, points: int) -> int:
    """Encoding, band and score as one small number."""
    return (kind * len(BANDS) + at) * (GRID + 1) + points


BINS = _bin(len(ENCODINGS), 0, 0)


def _stretch_sums(blocks):
    """For each band its least length and the sums of the stretches of that length, one from each place on (last axis).

    blocks: sums of the STEP // BLOCK blocks (first axis) that follow each place; the last places, which only end stretches, get none.
    """
    whole = blocks.sum(axis=0, dtype=blocks.dtype)
    places = whole.shape[-1] - BANDS[-1] // STEP
    run, steps = whole, 1  # sums of so many steps from each place on
    for n in BANDS:
        while steps < n // STEP:
            run, steps = run[..., :-1] + whole[..., steps:], steps + 1
        out = run[..., :places]
        for block in blocks[:n % STEP // BLOCK]:
            out = out + block[..., steps:steps + places]
        yield n, out


def _stretch_bins(letters, symbols):
    """The bins of the stretches of each encoding and band (rows) that begin at each place, every STEP letters, but the last ones.

    symbols: each letter's symbol in each encoding.  Places lie along the last axis of all arrays, so that
    sums of stretches are sums of whole rows.
    """
    import numpy as np

    places = len(letters) // STEP - BANDS[-1] // STEP
    out = np.empty((len(ENCODINGS) * len(BANDS), places), dtype=np.int16)
    letters = np.ascontiguousarray(letters.reshape(-1, STEP).T)

    def blocks(values, kind):
        return values.reshape(STEP // BLOCK, BLOCK, -1).sum(axis=1, dtype=kind)

    for kind, name in enumerate(ENCODINGS):
        size = len(ALPHABETS[name])
        c = symbols[kind][letters]
        following = np.concatenate([c[1:], np.append(c[:1, 1:], c[:1, :1], axis=1)])
        high = 2 * c.astype(np.int16) >= size
        changes, products = high != np.append(high[1:], following[-1:] >= size / 2, axis=0), c.astype(np.int16) * following
        used = np.unique(symbols[kind][list(map(ord, ALPHABETS["base64"][:52]))])
        counts = np.stack([blocks((c == symbol).view(np.uint8), np.uint8) for symbol in used], axis=1)
        sums = np.stack([blocks(v, np.int32) for v in (high, changes, products, c, c.astype(np.int16) ** 2)], axis=1)
        for at, ((n, counted), (_, (above, changed, multiplied, total, squared))) in enumerate(zip(_stretch_sums(counts), _stretch_sums(sums))):
            end, steps = (n - 1) % STEP, (n - 1) // STEP
            last = slice(steps, steps + places)  # the last symbol's neighbour is outside
            out[kind * len(BANDS) + at] = _scores(
                n, size, np.square(counted, dtype=np.uint16).sum(axis=0, dtype=np.uint16), above, changed - changes[end, last],
                multiplied - products[end, last], total, c[0, :places].astype(np.int16) + c[end, last], squared)
            out[kind * len(BANDS) + at] += _bin(kind, at, 0)
    return out


def _letters(text: str):
    """The letters of the words of ordinary length, which touch no other symbol of a token."""
    import numpy as np

    return np.frombuffer("".join(WORD.findall(text)).encode("ascii"), dtype=np.uint8)


def decoys(texts: list) -> list:
    """For each text the bins of its decoys: stretches of its own letters, for each encoding and band.

    Every band that the text's letters fill has a stretch of its length every STEP letters, which is
    no more than the shortest band, so stretches of every band lie end to end or overlap through the
    whole text, from a place on that the text's checksum gives; the text goes on at its
    beginning.  (Where it closes, fewer than STEP letters may be left.)  Letters become symbols by their place in the alphabet.  (Base64 tells capitals
    from small letters, as in a candidate.)  Long tokens, which might be secrets, do not serve; a
    text with too few letters gives none.
    """
    import numpy as np

    symbols = np.zeros((len(ENCODINGS), 128), dtype=np.uint8)
    for kind, name in enumerate(ENCODINGS):
        for c in ALPHABETS["base64"][:52]:
            symbols[kind, ord(c)] = _CODES[kind].get(c if kind == 2 else c.upper(), ord(c) % len(ALPHABETS[name]))
    out, waiting, held = [[] for _ in texts], [], 0

    def flush():
        """Score the waiting parts of texts together: (text's number, letters); each begins at a place of its own."""
        row = np.full(held + BANDS[-1], ord("A"), dtype=np.uint8)
        origin = 0
        for _, part in waiting:
            row[origin:origin + len(part)] = part
            origin += -(-len(part) // STEP) * STEP
        bins, place = _stretch_bins(row, symbols), 0
        for i, part in waiting:
            ends = np.minimum(SLAB, len(part) - lengths + 1)  # where the part's stretches of each length must have begun
            mine = bins[:, place:place + -(-len(part) // STEP)]
            out[i].append(mine[np.arange(0, mine.shape[1] * STEP, STEP) < ends])
            place += mine.shape[1]
        waiting.clear()

    lengths = np.array(BANDS * len(ENCODINGS))[:, None]
    for i, text in enumerate(texts):
        letters = _letters(text or "")
        if len(letters) < BANDS[0]:
            continue
        letters = np.roll(letters, -(zlib.crc32(text.encode("utf-8")) % len(letters)))
        for place in range(0, len(letters) - BANDS[0] + 1, SLAB):
            part = letters[place:place + SLAB + BANDS[-1]]
            waiting.append((i, part))
            held += -(-len(part) // STEP) * STEP
            if held >= SLAB:
                flush()
                held = 0
    if waiting:
        flush()
    return [np.concatenate(bins) if bins else np.zeros(0, dtype=np.int16) for bins in out]


def packed_counts(bins) -> bytes:
    """The different bins and their counts, compressed: decoys are many, and travel with their text's hash."""
    import numpy as np

    if not len(bins):
        return b""
    n = np.bincount(bins, minlength=BINS)
    (different,) = n.nonzero()
    return zlib.compress(np.diff(different, prepend=0).astype("<i2").tobytes() + n[different].astype("<i4").tobytes(), 1)


def unpacked_counts(raw: bytes) -> tuple:
    """(different bins, their counts)"""
    import numpy as np

    data = zlib.decompress(raw)
    size = len(data) // 6
    return np.cumsum(np.frombuffer(data, "<i2", size)), np.frombuffer(data, "<i4", size, 2 * size)


def _decoy_counts(batches):
    """For each batch of packed counts one row a bin."""
    import numpy as np
    import pyarrow as pa

    for batch in batches:
        total = np.zeros(BINS, dtype=np.int64)
        for raw in batch.column(0).to_pylist():
            if raw:
                bins, n = unpacked_counts(raw)
                total[bins] += n
        (there,) = total.nonzero()
        yield pa.RecordBatch.from_arrays([pa.array(there, pa.int32()), pa.array(total[there], pa.int64())], ["c", "n"])


def _spans_of(text: str) -> tuple:
    base = base_spans(text)
    return base, candidates(text, base)


def found(df: DataFrame, text: str = "text", keep: list = None) -> DataFrame:
    """Adds `base`, `tokens`, `decoys` and `digest`: arrays of the spans and candidates, and packed counts of the decoys' bins, of each whole text, and its hash."""
    def start():
        from xxhash import xxh3_64_intdigest

        def run(texts):
            spans = [_spans_of(t or "") for t in texts]
            digests = [xxh3_64_intdigest((t or "").encode("utf-8")) - (1 << 63) for t in texts]
            return [[b for b, _ in spans], [c for _, c in spans], list(map(packed_counts, decoys(texts))), digests]
        return run

    return add_columns(df, [text], [
        ("base", "array<struct<start:int,kind:int,end:int>>"),
        ("tokens", "array<struct<start:int,end:int,encoding:int,band:int,score:int>>"),
        ("decoys", "binary"), ("digest", "bigint")], start, keep)


def cutoffs(rows: DataFrame, rate: float = RATE) -> list:
    """The least score that is a discovery, by encoding and band (a flat list; None: no score is).

    Each different text counts once.  At most encodings x bands x grid counts reach the driver's
    plan, whatever the corpus.
    """
    once = (rows.where((F.size("tokens") > 0) | (F.length("decoys") > 0)).groupBy("digest")
            .agg(F.first("tokens").alias("tokens"), F.first("decoys").alias("decoys")))
    candidate = F.transform("tokens", lambda t: ((t["encoding"] * len(BANDS) + t["band"]) * (GRID + 1) + t["score"] + BINS).cast("int"))
    counted = once.select("decoys").mapInArrow(_decoy_counts, "c int, n bigint").unionByName(
        once.select(F.explode(candidate).alias("c"), F.lit(1).cast("bigint").alias("n")))
    counted = counted.groupBy("c").agg(F.sum("n").alias("_n"))
    bin, target = F.col("c") % BINS, F.col("c") >= BINS
    cell = F.floor(bin / (GRID + 1)).cast("int")
    bins = counted.select(F.floor(cell / len(BANDS)).cast("int").alias("encoding"), (cell % len(BANDS)).alias("band"), (bin % (GRID + 1)).alias("score"),
                          F.when(target, F.col("_n")).otherwise(0).alias("t"), F.when(target, 0).otherwise(F.col("_n")).alias("d"))
    bins = bins.groupBy("encoding", "band", "score").agg(F.sum("t").alias("t"), F.sum("d").alias("d"))
    whole = Window.partitionBy("encoding", "band")
    down = whole.orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = bins.select("encoding", "band", "score", F.sum("t").over(whole).alias("m"), F.sum("d").over(whole).alias("all_d"),
                       F.sum("t").over(down).alias("k"), F.sum("d").over(down).alias("d"))
    passes = (F.col("d") + 1) * F.col("m") <= rate * F.col("k") * (F.col("all_d") + 1)
    best = seen.where(passes & (F.col("k") > 0)).groupBy("encoding", "band").agg(F.min("score").alias("cut")).collect()
    out = [None] * (len(ENCODINGS) * len(BANDS))
    for row in best:
        out[row["encoding"] * len(BANDS) + row["band"]] = row["cut"]
    return out


def scan(df: DataFrame, text: str = "text", keep: list = None, rate: float = RATE) -> DataFrame:
    """Adds `secrets`: array of (start, kind, end), by start, then kind; code points, end exclusive.

    Kinds: assign, access, hex, and random for what the battery adds.  Null and empty texts have
    none.  Tokens that touch a base span add nothing.  Texts are scanned whole.  The kept columns
    should be narrow: the rows are written once, since the cutoffs need all of them first.
    Repeated rows stay, each with its spans; equal texts count once for the cutoffs.  An empty table
    gives no rows.  A column named `secrets` is replaced; any other name of the input may be
    used, as its columns travel in a struct of their own.
    """
    keep = kept_columns(df, ["secrets"], keep)
    packed = df.select(F.struct(F.lit(None).cast("int").alias("_"), *[named(c) for c in keep]).alias("row"), named(text).alias("text"))
    rows = materialise(found(packed, "text", ["row"]))
    cuts = F.array(*[F.lit(c).cast("int") for c in cutoffs(rows, rate)])
    names = F.array(*[F.lit(k) for k in [*KINDS, "random"]])
    return with_secrets(rows, cuts, names).select(*[F.col("row").getField(c).alias(c) for c in keep], "secrets")


def with_secrets(rows: DataFrame, cuts, names) -> DataFrame:
    lucky = F.filter("tokens", lambda t: t["score"] >= F.get(cuts, t["encoding"] * len(BANDS) + t["band"]))
    spans = F.concat("base", F.transform(lucky, lambda t: F.struct(t["start"].alias("start"), F.lit(len(KINDS)).alias("kind"), t["end"].alias("end"))))
    named_spans = F.transform(F.array_sort(spans), lambda s: F.struct(s["start"].alias("start"), F.get(names, s["kind"]).alias("kind"), s["end"].alias("end")))
    return rows.withColumn("secrets", named_spans).drop("base", "tokens", "decoys", "digest")


def redact(df: DataFrame, text: str = "text", rate: float = RATE) -> DataFrame:
    """The same rows and columns; every secret of the text reads [SECRET].  Overlapping spans make one.

    Cutoffs come from a pass over all rows; the second pass finds the spans again in place, so
    texts are not shuffled.  A null text stays null, an empty one empty; texts are read whole.
    Repeated rows stay, equal texts count once for the cutoffs.  Columns may have any names.
    An empty table gives no rows.
    """
    rows = materialise(found(df.select(named(text).alias("text")), "text", []))
    cuts = cutoffs(rows, rate)
    remove(rows)

    def start():
        def clean(value):
            if not value:
                return value
            base, tokens = _spans_of(value)
            spans = sorted([(s, e) for s, _, e in base] + [(s, e) for s, e, kind, at, points in tokens
                                                           if (cut := cuts[kind * len(BANDS) + at]) is not None and points >= cut])
            out, at = [], 0
            for s, e in spans:
                if s >= at:
                    out += [value[at:s], "[SECRET]"]
                at = max(at, e)
            return "".join([*out, value[at:]])

        def run(texts):
            return [[clean(t) for t in texts]]
        return run

    (clean,) = fresh(df.columns, "clean_text")
    done = add_columns(df, [text], [(clean, "string")], start)
    return done.select(*[(F.col(clean).alias(c) if c == text else named(c)) for c in df.columns])
