"""Canonical forms of identifiers, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def canonical_key(key: Column) -> Column:
    """Lower case, no blanks around, and one ``-`` for whatever separators stand between the tokens.
    Null stays null."""
    inner = F.regexp_replace(F.lower(key), r"[^\p{L}\p{N}]+", "-")
    return F.trim(inner, F.lit("-"))


def canonical_gene(gene: Column) -> Column:
    """As :func:`canonical_key`, without a trailing version ``.N``."""
    return canonical_key(F.regexp_replace(F.trim(gene), r"\.\d+\s*$", ""))


def leading_tokens(key: Column, n: int) -> Column:
    """The first ``n`` tokens of a canonical key."""
    return F.substring_index(canonical_key(key), "-", n)
