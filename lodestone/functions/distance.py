"""Restricted Damerau-Levenshtein distance (optimal string alignment, T7)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def alignment_distance(a: Column, b: Column, most: int | None = None) -> Column:
    """T7 as one expression: insertions, deletions, substitutions and swaps of
    neighbours, each substring edited once. With ``most``, larger distances come
    back as ``most + 1``. Two rows of the table are carried by nested folds."""
    la, lb = F.length(a), F.length(b)

    def char(s: Column, i: Column) -> Column:
        return F.substring(s, i, F.lit(1))

    def next_row(state: Column, i: Column) -> Column:
        before, last = state["before"], state["last"]

        def cell(row: Column, j: Column) -> Column:
            cost = F.when(char(a, i) == char(b, j), 0).otherwise(1)
            swap = F.when((i > 1) & (j > 1) & (char(a, i) == char(b, j - 1)) & (char(a, i - 1) == char(b, j)), F.get(before, j - 2) + cost)
            return F.concat(row, F.array(F.least(F.get(last, j) + 1, F.get(row, j - 1) + 1, F.get(last, j - 1) + cost, swap)))

        return F.named_struct(F.lit("before"), last, F.lit("last"), F.aggregate(F.sequence(F.lit(1), lb), F.array(i), cell))

    first = F.named_struct(F.lit("before"), F.array().cast("array<int>"), F.lit("last"), F.sequence(F.lit(0), lb))
    full = F.get(F.aggregate(F.sequence(F.lit(1), la), first, next_row)["last"], lb)
    distance = F.when(la == 0, lb).when(lb == 0, la).otherwise(full)
    if most is None:
        return distance
    return F.when(F.abs(la - lb) > most, most + 1).otherwise(F.least(distance, F.lit(most + 1)))


def maybe_within(a: Column, b: Column, most: int) -> Column:
    """Cheap test that every pair within ``most`` passes: lengths, then the built-in
    distance, in which a swap costs two."""
    return (F.abs(F.length(a) - F.length(b)) <= most) & (F.levenshtein(a, b, 2 * most) != -1)


def deletions(token: Column, most: int) -> Column:
    """A token and what is left of it after up to ``most`` deletions. Tokens within
    distance ``most`` share one of these, which turns fuzzy search into an equi-join."""
    out = F.array(token)
    step = F.array(token)
    for _ in range(most):
        step = F.array_distinct(F.flatten(F.transform(step, lambda t: F.transform(F.sequence(F.lit(1), F.greatest(F.length(t), F.lit(1))), lambda i: F.concat(F.substring(t, F.lit(1), i - 1), F.substring(t, i + 1, F.length(t)))))))
        out = F.array_union(out, step)
    return out


def deletions_of(token: str, most: int) -> list[str]:
    """``deletions`` on the driver, for query tokens."""
    found = {token}
    step = {token}
    for _ in range(most):
        step = {t[:i] + t[i + 1 :] for t in step for i in range(max(1, len(t)))}
        found |= step
    return sorted(found)
