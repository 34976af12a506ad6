"""Named queries and, where plain SQL can say the same, their oracle text."""

QUERIES, ORACLES = {}, {}


def query(name: str, oracle: str = None):
    """Register fn(spark, sf_dir) -> DataFrame under a name."""
    def add(fn):
        QUERIES[name] = fn
        if oracle:
            ORACLES[name] = oracle
        return fn
    return add
