"""Expressions on nucleotide sequences."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed order of the one-hot rows; any other letter counts as N.
BASES = ("A", "C", "G", "T", "N")


def with_variants(sequence: Column, start: Column, variants: Column) -> Column:
    """The sequence with its single-base variants put in.

    ``variants`` is an array of structs (pos, alt, dosage); a dosage of 2 puts the other allele in,
    less leaves the reference, as do variants outside the sequence and longer alleles. Of several
    at one place the last in the array counts.
    """
    here = lambda i: F.transform(F.filter(variants, lambda v: (v["pos"] - start == i) & (v["dosage"] == 2) & v["alt"].isin(*BASES[:4])), lambda v: v["alt"])
    changed = F.transform(F.split(sequence, ""), lambda c, i: F.coalesce(F.try_element_at(here(i), F.lit(-1)), c))
    some = F.coalesce(F.exists(variants, lambda v: v["dosage"] == 2), F.lit(False))
    return F.when(some, F.array_join(changed, "")).otherwise(sequence)


def one_hot(sequence: Column) -> Column:
    """An array a base with a 1 at its place among ``BASES``."""
    own = F.filter(F.split(sequence, ""), lambda c: c != "")
    return F.transform(own, lambda c: F.array(*[(c == b).cast("int") for b in BASES[:4]], (~c.isin(*BASES[:4])).cast("int")))
