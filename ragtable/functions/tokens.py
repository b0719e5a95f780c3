"""Tokenisers as column expressions (JVM-side, inside whole-stage codegen)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and pass it to ``body`` (a one-element array bound by ``transform``).

    A column expression referenced inside a lambda is re-evaluated for every
    element; binding it first keeps array work linear.
    """
    return F.get(F.transform(F.array(value), body), 0)


def whitespace_tokens(c: Column) -> Column:
    """Python ``str.split()`` semantics: split on whitespace runs, no empty tokens, case kept."""
    return F.array_remove(F.split(F.coalesce(c, F.lit("")), r"\s+"), "")


def word_tokens(c: Column) -> Column:
    """Lower-cased alphanumeric tokens (``[^a-z0-9]+`` separators), as ROUGE tokenises."""
    return F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+"), lambda t: t != F.lit(""))


def ngrams(tokens: Column, n: int) -> Column:
    """Space-joined n-grams of a token array, in order (empty when shorter than ``n``)."""
    if n == 1:
        return tokens
    return F.when(
        F.size(tokens) >= n,
        F.transform(F.sequence(F.lit(1), F.size(tokens) - n + 1), lambda i: F.array_join(F.slice(tokens, i, n), " ")),
    ).otherwise(F.array().cast("array<string>"))
