"""Check digits of Brazilian identifiers as folds over digits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from spanveil.functions.text import digits, let


def _weighted(d: Column, weights: Sequence[int]) -> Column:
    total = F.lit(0)
    for i, w in enumerate(weights):
        total = total + F.substring(d, i + 1, 1).cast("int") * w
    return total


def _same(d: Column) -> Column:
    return F.regexp_like(d, F.lit(r"^(.)\1*$"))


def _mod11(total: Column) -> Column:
    """Ten times the sum modulo 11, ten read as 0."""
    return (total * 10) % 11 % 10


def cpf_digits(base9: Column) -> Column:
    """The two check digits of nine digits."""
    one = lambda d: _mod11(_weighted(d, range(10, 1, -1))).cast("string")
    return let(base9, lambda d: let(F.concat(d, one(d)), lambda ten: F.concat(F.right(ten, F.lit(1)), _mod11(_weighted(ten, range(11, 1, -1))).cast("string"))))


def cnpj_digits(base12: Column) -> Column:
    first, second = [5, 4, 3, 2, 9, 8, 7, 6, 5, 4, 3, 2], [6, 5, 4, 3, 2, 9, 8, 7, 6, 5, 4, 3, 2]
    low = lambda d, w: let(_weighted(d, w) % 11, lambda r: F.when(r < 2, 0).otherwise(11 - r).cast("string"))
    return let(base12, lambda d: let(F.concat(d, low(d, first)), lambda more: F.concat(F.right(more, F.lit(1)), low(more, second))))


def cpf_valid(text: Column) -> Column:
    return let(digits(text), lambda d: F.coalesce((F.length(d) == 11) & ~_same(d) & (F.right(d, F.lit(2)) == cpf_digits(F.left(d, F.lit(9)))), F.lit(False)))


def cnpj_valid(text: Column) -> Column:
    return let(digits(text), lambda d: F.coalesce((F.length(d) == 14) & ~_same(d) & (F.right(d, F.lit(2)) == cnpj_digits(F.left(d, F.lit(12)))), F.lit(False)))


def cns_tail(base11: Column) -> Column:
    """The last four digits of a number that starts with 1 or 2, from its first eleven."""

    def tail(total: Column) -> Column:
        dv = 11 - total % 11
        again = (11 - (total + 2) % 11) % 11
        return F.when(dv == 11, "0000").when(dv == 10, F.concat(F.lit("001"), again.cast("string"))).otherwise(F.concat(F.lit("000"), dv.cast("string")))

    return let(base11, lambda d: let(_weighted(d, range(15, 4, -1)), tail))


def cns_valid(text: Column) -> Column:
    def valid(d: Column) -> Column:
        head = F.left(d, F.lit(1))
        whole = (_weighted(d, range(15, 0, -1)) % 11) == 0
        by_head = F.when(head.isin("1", "2"), F.right(d, F.lit(4)) == cns_tail(F.left(d, F.lit(11)))).when(head.isin("7", "8", "9"), whole).otherwise(False)
        return F.coalesce((F.length(d) == 15) & ~_same(d) & by_head, F.lit(False))

    return let(digits(text), valid)
