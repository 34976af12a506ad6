"""Arrow-batched molecule functions over text columns."""

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .. import kernel
from ..functions import attach, rules
from .spread import spread

TEXT, TEXTS = T.StringType(), T.ArrayType(T.StringType())
ATOM = T.StructType([
    T.StructField("idx", T.IntegerType()), T.StructField("elem", TEXT), T.StructField("aromatic", T.BooleanType()),
    T.StructField("charge", T.IntegerType()), T.StructField("n_h", T.IntegerType()),
    T.StructField("map_no", T.IntegerType()), T.StructField("degree", T.IntegerType()),
    T.StructField("in_ring", T.BooleanType()), T.StructField("dbl_o", T.IntegerType()),
    T.StructField("next_acyl", T.BooleanType()), T.StructField("next_ring_acyl", T.BooleanType())])
BOND = T.StructType([
    T.StructField("idx", T.IntegerType()), T.StructField("u", T.IntegerType()), T.StructField("v", T.IntegerType()),
    T.StructField("ord", TEXT), T.StructField("in_ring", T.BooleanType()), T.StructField("last", T.IntegerType())])
PARSED = T.StructType([
    T.StructField("atoms", T.ArrayType(ATOM)), T.StructField("bonds", T.ArrayType(BOND)),
    T.StructField("components", T.IntegerType()), T.StructField("reason", TEXT)])
SLICED = T.StructType([
    T.StructField("scaffold", TEXT), T.StructField("decorations", TEXTS), T.StructField("smiles", TEXT)])


def _kernel(result):
    """Arrow UDF evaluated once per row: marked so that the optimizer neither copies it
    into a pushed-down filter nor inlines it where it is used twice.  Results depend on
    the arguments alone."""
    return lambda fn: F.arrow_udf(fn, result).asNondeterministic()


def _rows(fn, *arrays):
    """Apply fn per row; NULL in any argument or an invalid molecule gives NULL."""
    out = []
    for row in zip(*(a.to_pylist() for a in arrays)):
        try:
            out.append(None if any(x is None for x in row) else fn(*row))
        except (kernel.Invalid, RecursionError):
            out.append(None)
    return out


def _graph_row(text):
    try:
        m = kernel.parse(text or "")
    except kernel.Invalid as e:
        return (None, None, None, str(e))
    except Exception as e:  # one odd row must not end the job
        return (None, None, None, f"error_{type(e).__name__}")
    atoms = [(i, m.sym[i], m.arom[i], m.charge[i], m.n_h[i], None if m.map_no[i] is None else int(m.map_no[i]),
              len(m.adj[i]), m.ring[i], *f) for i, f in enumerate(m.atom_features())]
    return atoms, [(i, *b) for i, b in enumerate(m.bonds)], m.components, None


@_kernel(PARSED)
def _parse(text: pa.Array) -> pa.Array:
    return pa.array([_graph_row(t) for t in text.to_pylist()], type=to_arrow_type(PARSED))


@_kernel(TEXT)
def canonical(text: pa.Array) -> pa.Array:
    """Canonical text; NULL when invalid."""
    return pa.array(_rows(kernel.canonical_text, text), type=pa.string())


@_kernel(SLICED)
def _scaffold_of(text: pa.Array, bonds: pa.Array, near: pa.Array) -> pa.Array:
    rows = _rows(lambda t, b, n: kernel.scaffold_of(t, list(zip(b, n))), text, bonds, near)
    return pa.array(rows, type=to_arrow_type(SLICED))


@_kernel(TEXTS)
def random_variants(text: pa.Array, seed: pa.Array, count: pa.Array, attempts: pa.Array, repeats: pa.Array) -> pa.Array:
    """`count` random spellings; without repeats the first distinct ones within `attempts`."""
    return pa.array(_rows(kernel.random_texts, text, seed, count, attempts, repeats), type=pa.list_(pa.string()))


@_kernel(TEXTS)
def _respell(texts: pa.Array, seed: pa.Array) -> pa.Array:
    rows = _rows(lambda ts, s: [kernel.random_texts(t, s + i, 1, 1, True)[0] for i, t in enumerate(ts)], texts, seed)
    return pa.array(rows, type=pa.list_(pa.string()))


@_kernel(TEXT)
def _graft(scaffold: pa.Array, decoration: pa.Array, keep: pa.Array) -> pa.Array:
    return pa.array(_rows(kernel.graft, scaffold, decoration, keep), type=pa.string())


@_kernel(TEXT)
def _graft_all(scaffold: pa.Array, decorations: pa.Array) -> pa.Array:
    return pa.array(_rows(kernel.graft_all, scaffold, decorations), type=pa.string())


def respell(texts: Column, seed: Column) -> Column:
    """One random spelling of every text in an array."""
    return _respell(texts, seed)


def scaffold_of(text: Column, bonds: Column, near: Column) -> Column:
    """Scaffold, decorations by point and canonical molecule of one choice of cuts."""
    return _scaffold_of(text, bonds, near)


@_kernel(SLICED)
def _normalized(scaffold: pa.Array, decorations: pa.Array) -> pa.Array:
    return pa.array(_rows(kernel.normalized, scaffold, decorations), type=to_arrow_type(SLICED))


def normalize_sliced(df: DataFrame) -> DataFrame:
    """Renumber (scaffold, decorations) by the canonical scaffold; decorations[i] belongs to point i.

    Rows whose points do not match their decorations are left out.
    """
    rows = spread(df).withColumn("_clean", clean_all(F.col("decorations")))
    rows = rows.withColumn("_n", _normalized(F.col("scaffold"), F.col("_clean"))).where(F.col("_n").isNotNull())
    return rows.select(attach.number_all(F.col("_n.scaffold")).alias("scaffold"), "_n.decorations",
                       *[c for c in df.columns if c not in ("scaffold", "decorations")])


def label_decoration(decoration: Column, number) -> Column:
    """Canonical text with the first point numbered."""
    return canonical(attach.number_first(decoration, number))


def graft(scaffold: Column, decoration: Column, keep_labels: bool = False) -> Column:
    """Join at the decoration's numbered point; NULL when the pair does not fit."""
    return _graft(scaffold, decoration, F.lit(keep_labels))


def graft_first(scaffold: Column, decoration: Column) -> Column:
    """Join at the first point of both texts."""
    return graft(attach.number_first(scaffold, 0), attach.number_first(decoration, 0))


def graft_packed(scaffold: Column, packed: Column) -> Column:
    """Join all `|`-packed decorations in point order; NULL on any misfit."""
    fits = attach.arity_matches(scaffold, packed)
    return F.when(fits, _graft_all(F.when(fits, attach.number_all(scaffold)), attach.number_packed(packed)))


def clean_decoration(decoration: Column) -> Column:
    """Canonical text without point numbers; NULL when invalid."""
    return canonical(attach.remove_numbers(decoration))


def parse_molecules(df: DataFrame, column: str = "smiles") -> DataFrame:
    """Add `graph` (NULL when rejected) and `reason` (NULL when readable)."""
    parsed = df.withColumn("_parsed", _parse(F.col(column)))
    graph = F.struct(*[F.col(f"_parsed.{f}").alias(f) for f in ("atoms", "bonds", "components")])
    return parsed.select(*df.columns, F.when(F.col("_parsed.reason").isNull(), graph).alias("graph"),
                         F.col("_parsed.reason").alias("reason"))


def with_cut_sites(df: DataFrame, rule_set) -> DataFrame:
    """Add `sites`: the non-ring bonds matched by any rule, each once."""
    rule_set = rules.resolve(rule_set)

    def keep(bond):
        a, b = F.get(F.col("graph.atoms"), bond["u"]), F.get(F.col("graph.atoms"), bond["v"])
        return ~bond["in_ring"] & rules.matches(rule_set, bond, a, b)

    return df.withColumn("sites", F.filter(F.col("graph.bonds"), keep))


def clear_numbers(atoms: Column) -> Column:
    """Drop the numbers of all atoms of a graph column."""
    return F.transform(atoms, lambda a: a.withField("map_no", F.lit(None).cast("int")))


def number_atoms(atoms: Column) -> Column:
    """Number the attachment atoms of a graph column from 0 in atom order."""
    stars = F.transform(F.filter(atoms, lambda a: a["elem"] == "*"), lambda a: a["idx"])
    return F.transform(atoms, lambda a: F.when(
        a["elem"] == "*", a.withField("map_no", (F.array_position(stars, a["idx"]) - 1).cast("int"))).otherwise(a))


def graph_points(atoms: Column) -> Column:
    """Numbers of the numbered attachment atoms, in atom order."""
    return F.transform(
        F.filter(atoms, lambda a: (a["elem"] == "*") & a["map_no"].isNotNull()), lambda a: a["map_no"])


def count_graph_points(atoms: Column) -> Column:
    return F.size(F.filter(atoms, lambda a: a["elem"] == "*"))


def points_are_terminal(atoms: Column) -> Column:
    """Every attachment atom has exactly one bond."""
    return F.forall(F.filter(atoms, lambda a: a["elem"] == "*"), lambda a: a["degree"] == 1)


@_kernel(TEXTS)
def _canonical_all(texts: pa.Array) -> pa.Array:
    return pa.array(_rows(lambda ts: [kernel.canonical_text(t) for t in ts], texts), type=pa.list_(pa.string()))


def clean_all(decorations: Column) -> Column:
    """Canonical texts without point numbers; NULL when any is invalid."""
    return _canonical_all(F.transform(decorations, attach.remove_numbers))


def graft_numbered(scaffold: Column, decorations: Column) -> Column:
    """Join an array of numbered decorations in turn; NULL on any misfit."""
    return _graft_all(scaffold, decorations)
