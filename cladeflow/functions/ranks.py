"""Taxonomic rank codes: order and full names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Codes in order, and the names that replace them at the start of a code.
CODES = ("U", "R", "D", "K", "P", "C", "O", "F", "G", "S")
NAMES = {"R": "root", "D": "domain", "K": "kingdom", "P": "phylum", "C": "class", "O": "order", "F": "family", "G": "genus", "S": "species"}


def order_key(rank: Column) -> Column:
    """Sorts codes by their letter, then by their number (none first); unknown codes and suffixes come last."""
    letter = F.array_position(F.array(*[F.lit(c) for c in CODES]), F.substring(rank, 1, 1))
    suffix = F.substring(rank, 2, 2**31 - 1)
    number = F.when(suffix == "", F.lit(0)).otherwise(F.coalesce(suffix.try_cast("int"), F.lit(2**31 - 1)))
    return F.struct(F.when(letter == 0, F.lit(len(CODES) + 1)).otherwise(letter).alias("letter"), number.alias("number"))


def full_name(rank: Column) -> Column:
    """``G2`` gives ``genus2``; what starts with no known letter stays as it is."""
    name = rank
    for code, full in NAMES.items():
        name = F.when(F.regexp_like(rank, F.lit(f"^{code}[0-9]*$")), F.concat(F.lit(full), F.substring(rank, 2, 2**31 - 1))).otherwise(name)
    return name
