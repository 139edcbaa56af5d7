"""Small shared helpers for column arguments."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Column | str


def as_col(value: ColumnOrName) -> Column:
    return F.col(value) if isinstance(value, str) else value


def blank_to_null(value: ColumnOrName) -> Column:
    return F.nullif(as_col(value), F.lit(""))


def null_to_blank(value: ColumnOrName) -> Column:
    return F.coalesce(as_col(value), F.lit(""))


def let(value: ColumnOrName, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out only once.

    A filter is pushed below the projection that parsed its input, and then
    repeats the parsing for every mention of it.  Bound this way it is mentioned
    once.
    """
    return F.get(F.transform(F.array(as_col(value)), body), F.lit(0))


def case_lookup(
    value: ColumnOrName, mapping: dict[str, object], default: Column | None = None
) -> Column:
    """Exact-match lookup in a small fixed mapping, as one CASE expression."""
    out = default if default is not None else F.lit(None)
    if not mapping:
        return out
    value = as_col(value)
    chain = None
    for key, target in mapping.items():
        target = target if isinstance(target, Column) else F.lit(target)
        branch = value == F.lit(key)
        chain = F.when(branch, target) if chain is None else chain.when(branch, target)
    return chain.otherwise(out)


def presence_mask(value: ColumnOrName, vocabulary: list[str]) -> Column:
    """One bit per word of a fixed vocabulary; 0 for anything else.

    ``bit_or`` of this is a set in a single long: it stays inside hash
    aggregation, needs no per-group list, and its size never grows with the
    group.
    """
    vocabulary = list(dict.fromkeys(vocabulary))
    if len(vocabulary) > 62:
        raise ValueError("a presence mask holds at most 62 words")
    bits = {word: F.lit(1 << i).cast("long") for i, word in enumerate(vocabulary)}
    return case_lookup(value, bits, F.lit(0).cast("long"))


def seen_words(value: ColumnOrName, vocabulary: list[str]) -> Column:
    """Aggregate: the words of a vocabulary of any length that occur, in its order.

    Up to 62 words it is one number; beyond, a set that the vocabulary bounds.
    """
    vocabulary = list(dict.fromkeys(vocabulary))
    if len(vocabulary) <= 62:
        return mask_words(F.bit_or(presence_mask(value, vocabulary)), vocabulary)
    value = as_col(value)
    found = F.collect_set(F.when(value.isin(*vocabulary), value))
    return F.array_intersect(F.array(*[F.lit(word) for word in vocabulary]), found)


def mask_words(mask: ColumnOrName, vocabulary: list[str]) -> Column:
    """The words whose bits are set, as an array in vocabulary order."""
    mask = as_col(mask)
    return F.array_compact(
        F.array(
            *[
                F.when(mask.bitwiseAND(F.lit(1 << i).cast("long")) != 0, F.lit(word))
                for i, word in enumerate(vocabulary)
            ]
        )
    )
