"""Molecule text derived from the given tables by portable SQL.

The test tables hold no molecules, so these views spell them from keys and measures.
`{part}` and so on stand for the tables; the text runs in Spark SQL and in other engines.
"""

from pyspark.sql import DataFrame, SparkSession

# --- fixed values: view texts ---
SCAFFOLD_CASE = """CASE {key} % 6
         WHEN 0 THEN '[*:0]c1ccccc1[*:1]'
         WHEN 1 THEN '[*:1]CCN1CCN([*:0])CC1'
         WHEN 2 THEN '[*:0]C(=O)Nc1ccc([*:1])cc1[*:2]'
         WHEN 3 THEN '[*:0]CCSC1CCN(Cc2ccoc2[*:1])C1'
         WHEN 4 THEN '*c1ccc(Br)cc1'
         ELSE 'c1ccncc1' END"""

DECORATION_CASE = """CASE {key} % 10
         WHEN 0 THEN '[*]C' WHEN 1 THEN '[*]CC' WHEN 2 THEN '[*]c1ccccc1'
         WHEN 3 THEN '[*]OC' WHEN 4 THEN '[*]N(C)C' WHEN 5 THEN '[*]C(=O)O'
         WHEN 6 THEN '*Cl' WHEN 7 THEN '[*]C[*]' WHEN 8 THEN 'CC'
         ELSE '[*]C(' END"""

PAIR_ID = ("concat_ws('-', CAST(l_orderkey AS VARCHAR(20)), CAST(l_linenumber AS VARCHAR(20)), "
           "CAST(l_partkey AS VARCHAR(20)), CAST(l_suppkey AS VARCHAR(20)), CAST(CAST(round(l_extendedprice * 100) AS BIGINT) AS VARCHAR(20)))")

PIECES = ", ".join(f"""CASE CAST(floor(p_partkey / {10 ** i}) AS INT) % 10 WHEN 0 THEN 'C' WHEN 1 THEN 'O'
         WHEN 2 THEN 'N' WHEN 3 THEN 'CC' WHEN 4 THEN 'C(=O)' WHEN 5 THEN 'c1ccc(cc1)' WHEN 6 THEN 'S'
         WHEN 7 THEN 'C(C)' WHEN 8 THEN 'N(C)' ELSE 'C(F)' END""" for i in range(5))

VIEWS = {
    "fx_scaffold": ("part", "SELECT p_partkey AS scaffold_id, " + SCAFFOLD_CASE.format(key="p_partkey")
                    + " AS scaffold FROM {part}"),
    "fx_decoration": ("supplier", "SELECT s_suppkey AS decoration_id, " + DECORATION_CASE.format(key="s_suppkey")
                      + " AS decoration FROM {supplier}"),
    "fx_pair": ("lineitem", "SELECT " + PAIR_ID + " AS pair_id, " + SCAFFOLD_CASE.format(key="l_partkey")
                + " AS scaffold, " + DECORATION_CASE.format(key="l_suppkey") + " AS decoration FROM {lineitem}"),
    # training pairs: one-point scaffolds, decorations of three to four pieces
    "fx_train": ("lineitem", "SELECT " + PAIR_ID + """ AS pair_id,
       CASE l_partkey % 5 WHEN 0 THEN 'c1ccccc1[*]' WHEN 1 THEN '[*]CCN1CCNCC1' WHEN 2 THEN 'O=C([*])Nc1ccccc1'
                          WHEN 3 THEN 'CCSC1CCN([*])C1' ELSE '[*]n1ccnc1' END AS scaffold,
       concat('[*]', CASE l_suppkey % 7 WHEN 0 THEN 'C' WHEN 1 THEN 'CC' WHEN 2 THEN 'O' WHEN 3 THEN 'N(C)'
                          WHEN 4 THEN 'C(=O)' WHEN 5 THEN 'S(=O)(=O)' ELSE 'c1ccc(cc1)' END,
              CASE l_linenumber % 3 WHEN 0 THEN 'C' WHEN 1 THEN '' ELSE 'C(F)' END,
              CASE CAST(l_quantity AS BIGINT) % 6 WHEN 0 THEN 'C' WHEN 1 THEN 'N' WHEN 2 THEN 'C#N' WHEN 3 THEN 'CCl'
                          WHEN 4 THEN 'CBr' ELSE 'c1c[nH]cc1' END) AS decoration FROM {lineitem}"""),
    # pairs of another table: other combinations of the same tokens, now and then a token of its own
    "fx_check": ("orders", """SELECT CAST(o_orderkey AS VARCHAR(20)) AS pair_id,
       CASE o_custkey % 5 WHEN 0 THEN 'c1ccccc1[*]' WHEN 1 THEN '[*]CCN1CCNCC1' WHEN 2 THEN 'O=C([*])Nc1ccccc1'
                          WHEN 3 THEN 'CCSC1CCN([*])C1' ELSE '[*]n1ccnc1' END AS scaffold,
       concat('[*]', CASE o_orderkey % 7 WHEN 0 THEN 'C' WHEN 1 THEN 'CC' WHEN 2 THEN 'O' WHEN 3 THEN 'N(C)'
                          WHEN 4 THEN 'C(=O)' WHEN 5 THEN 'CCl' ELSE 'I' END,
              CASE o_orderkey % 5 WHEN 0 THEN 'C' WHEN 1 THEN 'N' ELSE '' END) AS decoration FROM {orders}"""),
    "fx_molecule": ("part", """SELECT p_partkey AS mol_id,
       CASE p_partkey % 7
         WHEN 0 THEN concat('c1ccccc1', repeat('C', p_size % 6 + 1))
         WHEN 1 THEN concat('C', repeat('C', p_size % 6 + 1))
         WHEN 2 THEN concat('N(', repeat('C', p_size % 3 + 1), ')(', repeat('C', p_size % 4 + 1), ')', repeat('C', p_size % 5 + 1))
         WHEN 3 THEN 'CC(=O)Nc1ccc(OC)cc1'
         WHEN 4 THEN 'O=C(c1ccccc1)N1CCN(Cc2ccccc2)CC1'
         WHEN 5 THEN 'CCO.Cl'
         ELSE 'C1CC(' END AS smiles, p_size FROM {part}"""),
    # a chain of eight atoms per part, one per base-4 digit of its key
    "fx_word": ("part", "SELECT p_partkey AS mol_id, concat("
                + ", ".join(f"substr('CNOS', CAST(floor(p_partkey / {4 ** i}) AS INT) % 4 + 1, 1)" for i in range(8))
                + ") AS smiles FROM {part}"),
    # ring systems and chains of five pieces, one per decimal digit of the key
    "fx_assembly": ("part", "SELECT p_partkey AS mol_id, concat('C', " + PIECES + ", 'C') AS smiles FROM {part}"),
    "fx_open": ("part", "SELECT p_partkey AS mol_id, concat('[*:0]', " + PIECES + ", '[*:1]') AS smiles FROM {part}"),
    "fx_nll": ("events", """SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'sampled_training' WHEN 1 THEN 'sampled_validation'
                                   WHEN 2 THEN 'training' ELSE 'validation' END AS grp, value AS nll FROM {events}"""),
    "fx_line": ("part", """SELECT p_partkey AS line_no, CASE p_partkey % 10 WHEN 0 THEN '   '
         WHEN 1 THEN concat(p_name, chr(9), p_type, chr(9), chr(9))
         ELSE concat(p_name, chr(9), p_type, chr(9), p_brand, '  ') END AS line FROM {part}"""),
    # counted molecules of three rounds
    "fx_round": ("lineitem", """SELECT l_linenumber % 3 AS round_no, concat('C', repeat('C', CAST(l_quantity AS INT)),
         CASE l_suppkey % 3 WHEN 0 THEN '[*:0]' WHEN 1 THEN '[*:1]O' ELSE 'F' END) AS smiles,
       """ + SCAFFOLD_CASE.format(key="l_partkey") + """ AS scaffold, CAST(l_partkey % 3 AS INT) AS point,
       """ + DECORATION_CASE.format(key="l_suppkey") + """ AS decoration FROM {lineitem}"""),
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    source, text = VIEWS[name]
    return spark.sql(text, **{source: table(spark, sf_dir, source)})


def sql(*names: str) -> str:
    """The views as common table expressions over the plain table names."""
    return ", ".join(f"{n} AS ({VIEWS[n][1].format(**{VIEWS[n][0]: VIEWS[n][0]})})" for n in names)
