"""Seeded draws: hashes of (seed, key, counter), so a recomputed task repeats them."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: the Lehmer generator of Park and Miller (1988), revised multiplier ---
LEHMER_A, LEHMER_M = 48271, 2147483647


def hash_hex(seed, *parts) -> Column:
    """Hex digest of the parts, NULL unlike any text; its leading digits are uniform."""
    def plain(part):
        text = (F.col(part) if isinstance(part, str) else part).cast("string")
        # a bar or backslash inside a part is marked, so parts cannot run into each other
        marked = F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("|"), F.lit("\\|"))
        return F.coalesce(marked, F.lit("\\N"))

    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[plain(p) for p in parts]))


def start_state(hex_column: Column) -> Column:
    """First state of a Lehmer stream, 1 .. m-1."""
    first = F.conv(F.substring(hex_column, 1, 8), 16, 10).cast("bigint")
    return first % (LEHMER_M - 1) + 1
