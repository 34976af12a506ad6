"""Molecule descriptors as sums over the atom and bond arrays of a graph column.

All of them are additive over atoms and bonds, so a fragment's value is a sum over
its atom interval, and a scaffold's value is the whole minus the removed parts.
An attachment point has mass 0, counts for degrees, and is not a heavy atom.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: standard atomic weights, of radioactive elements the mass number of a long-lived isotope ---
MASS = {k: float(v) for k, v in (pair.split() for pair in """H 1.008, He 4.0026, Li 6.94, Be 9.0122, B 10.81, C 12.011, N 14.007,
    O 15.999, F 18.998, Ne 20.180, Na 22.990, Mg 24.305, Al 26.982, Si 28.085, P 30.974, S 32.06, Cl 35.45, Ar 39.95, K 39.098,
    Ca 40.078, Sc 44.956, Ti 47.867, V 50.942, Cr 51.996, Mn 54.938, Fe 55.845, Co 58.933, Ni 58.693, Cu 63.546, Zn 65.38,
    Ga 69.723, Ge 72.630, As 74.922, Se 78.971, Br 79.904, Kr 83.798, Rb 85.468, Sr 87.62, Y 88.906, Zr 91.224, Nb 92.906,
    Mo 95.95, Tc 97, Ru 101.07, Rh 102.91, Pd 106.42, Ag 107.87, Cd 112.41, In 114.82, Sn 118.71, Sb 121.76, Te 127.60,
    I 126.90, Xe 131.29, Cs 132.91, Ba 137.33, La 138.91, Ce 140.12, Pr 140.91, Nd 144.24, Pm 145, Sm 150.36, Eu 151.96,
    Gd 157.25, Tb 158.93, Dy 162.50, Ho 164.93, Er 167.26, Tm 168.93, Yb 173.05, Lu 174.97, Hf 178.49, Ta 180.95, W 183.84,
    Re 186.21, Os 190.23, Ir 192.22, Pt 195.08, Au 196.97, Hg 200.59, Tl 204.38, Pb 207.2, Bi 208.98, Po 209, At 210, Rn 222,
    Fr 223, Ra 226, Ac 227, Th 232.04, Pa 231.04, U 238.03, Np 237, Pu 244, Am 243, Cm 247, Bk 247, Cf 251, Es 252, Fm 257,
    Md 258, No 259, Lr 262, Rf 267, Db 268, Sg 269, Bh 270, Hs 269, Mt 278, Ds 281, Rg 282, Cn 285, Nh 286, Fl 289, Mc 290,
    Lv 293, Ts 294, Og 294, * 0""".split(","))}
# --- end of fixed values ---

NAMES = ("hac", "mol_weight", "clogp", "hbd", "hba", "rotatable_bonds", "num_rings")


def _mass(elem):
    table = F.create_map(*[F.lit(x) for kv in MASS.items() for x in kv])
    return F.element_at(table, elem)


def atom_type(atom) -> Column:
    """Key of the contribution table: symbol (lower case when aromatic), 'H', hydrogens."""
    symbol = F.when(atom["aromatic"], F.lower(atom["elem"])).otherwise(atom["elem"])
    return F.concat(symbol, F.lit("H"), atom["n_h"].cast("string"))


def unknown_reason(atoms: Column, table=None) -> Column:
    """Why descriptors of these atoms have no value: an element without a mass, an atom type outside the table."""
    reason = F.when(F.exists(atoms, lambda a: ~a["elem"].isin(*MASS)), F.lit("unknown_element"))
    if table:
        reason = reason.when(F.exists(atoms, lambda a: (a["elem"] != "*") & ~atom_type(a).isin(*table)), F.lit("unknown_atom_type"))
    return reason


def _contribution(atom, table):
    lookup = F.create_map(*[F.lit(x) for k, v in table.items() for x in (k, float(v))])
    return F.when(atom["elem"] == "*", F.lit(0.0)).otherwise(F.element_at(lookup, atom_type(atom)))


def _per_atom(name, table):
    polar = ("N", "O")
    if name == "hac":
        return lambda a: F.when(a["elem"].isin("H", "*"), 0.0).otherwise(1.0)
    if name == "mol_weight":
        return lambda a: _mass(a["elem"]) + a["n_h"] * F.lit(MASS["H"])
    if name == "hbd":
        return lambda a: F.when(a["elem"].isin(*polar) & (a["n_h"] > 0), 1.0).otherwise(0.0)
    if name == "hba":
        return lambda a: F.when(a["elem"].isin(*polar), 1.0).otherwise(0.0)
    if name == "num_rings":
        return lambda a: F.lit(-1.0)
    if name == "clogp":
        if not table:
            raise ValueError("clogp needs a contribution table {atom type: contribution}")
        return lambda a: _contribution(a, table)
    return None


def _rotatable(atoms, bond):
    """Non-ring single bond between non-terminal atoms, the amide C-N bond excluded."""
    a, b = F.get(atoms, bond["u"]), F.get(atoms, bond["v"])

    def amide(x, y):
        return (x["elem"] == "C") & (x["dbl_o"] > 0) & (y["elem"] == "N") & ~y["aromatic"]

    return ((bond["ord"] == "-") & ~bond["in_ring"] & (a["degree"] > 1) & (b["degree"] > 1)
            & ~amide(a, b) & ~amide(b, a))


def _per_bond(name, atoms):
    if name == "num_rings":
        return lambda b: F.lit(1.0)
    if name == "rotatable_bonds":
        return lambda b: F.when(_rotatable(atoms, b), 1.0).otherwise(0.0)
    return None


def _total(items, value):
    return F.aggregate(items, F.lit(0.0), lambda acc, x: acc + value(x))


def span(name: str, atoms: Column, bonds: Column, lo=None, hi=None, table=None) -> Column:
    """Descriptor of the atoms lo..hi (all atoms when left out).

    `num_rings` is the cyclomatic number of a connected span.
    """
    if name not in NAMES:
        raise ValueError(f"unknown descriptor '{name}'")
    if lo is not None:
        bonds = F.filter(bonds, lambda b: (b["u"] >= lo) & (b["u"] <= hi) & (b["v"] >= lo) & (b["v"] <= hi))
    chosen = atoms if lo is None else F.slice(atoms, lo + 1, hi - lo + 1)
    value = F.lit(1.0 if name == "num_rings" else 0.0)
    per_atom, per_bond = _per_atom(name, table), _per_bond(name, atoms)
    if per_atom:
        value = value + _total(chosen, per_atom)
    if per_bond:
        value = value + _total(bonds, per_bond)
    return value


def cut_bond(name: str, atoms: Column, bond) -> Column:
    """What the cut bond itself contributes to the uncut molecule but to neither part."""
    if name == "rotatable_bonds":
        return F.when(_rotatable(atoms, bond), 1.0).otherwise(0.0)
    return F.lit(0.0)
