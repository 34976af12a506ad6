"""Tokens of molecule text: bracket atoms, two-digit ring marks, Br/Cl, single characters."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: token pattern and the special tokens in id order ---
TOKEN = r"(?s)\[[^\]]*\]|%\d{2}|Br|Cl|."
PAD, END, BEGIN = "<pad>", "$", "^"
SPECIAL = (PAD, END, BEGIN)


def tokenize(smi: Column, marks: bool = True) -> Column:
    body = F.regexp_extract_all(smi, F.lit(TOKEN), F.lit(0))
    return F.concat(F.array(F.lit(BEGIN)), body, F.array(F.lit(END))) if marks else body


def untokenize(tokens: Column) -> Column:
    """Text up to the first end token, begin tokens left out."""
    def text(read):
        end = F.array_position(read, F.lit(END))
        upto = F.slice(read, F.lit(1), F.when(end > 0, (end - 1).cast("int")).otherwise(F.size(read)))
        return F.array_join(F.array_remove(upto, BEGIN), "")

    return F.get(F.transform(F.array(tokens), text), F.lit(0))  # bound to a name, so that the tokens are made once


def point_neighbour(scaffold: Column) -> Column:
    """Token after the first attachment point, before it when it is last, '' without one."""
    body = tokenize(scaffold, marks=False)
    at = F.array_position(F.transform(body, lambda t: (t == "*") | t.startswith("[*")), F.lit(True)).cast("int")
    return F.when(at > 0, F.coalesce(F.get(body, at), F.get(body, at - 2), F.lit(""))).otherwise(F.lit(""))
