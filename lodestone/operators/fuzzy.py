"""Fuzzy candidates for query tokens.

Two words within distance k share what is left of their first ``HEAD`` letters after
up to k deletions on either side: substitutions and swaps cost a deletion on both
sides, an insertion one on one side and one at the end of the other. So fuzzy search
is an equi-join on at most 29 variants a word, whatever its length, and the exact
distance decides. An index stores the variants; without one they are derived.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.distance import alignment_distance, deletions, deletions_of, maybe_within
from lodestone.functions.frames import any_equal, local_frame

#: Up to so many tokens a band join over a dictionary without stored variants is the
#: cheaper plan.
BAND_TOKENS = 2
MOST = 2
HEAD = 7
#: Up to so many variants are given to the scan of stored ones as equalities.
PROBES = 128


def head_variants(term: Column) -> Column:
    return deletions(F.substring(term, 1, HEAD), MOST)


def term_variants(terms: DataFrame) -> DataFrame:
    """(variant, term): what an index stores for fuzzy search over ``terms`` (term)."""
    return terms.select(F.explode(head_variants(F.col("term"))).alias("variant"), "term")


def _measured(pairs: DataFrame, most: int) -> DataFrame:
    close = pairs.where(maybe_within(F.col("term"), F.col("token"), most) & (F.col("term") != F.col("token")))
    return close.select("token", "term", alignment_distance(F.col("token"), F.col("term"), most).alias("distance")).where(F.col("distance") <= most)


def _nearest(found: DataFrame, limit: int | None) -> DataFrame:
    if limit is None:
        return found
    best = found.groupBy("token").agg(F.slice(F.sort_array(F.collect_list(F.struct("distance", "term"))), 1, limit).alias("best"))
    return best.select("token", F.explode("best").alias("x")).select("token", "x.term", "x.distance")


def near_terms(tokens: DataFrame, terms: DataFrame, most: int, n_tokens: int | None = None, limit: int | None = None) -> DataFrame:
    """(token, term, distance) with 1 <= distance <= ``most``, at most 2.

    ``tokens`` (token) and ``terms`` (term) may be of any size; ``n_tokens``, where
    known, lets up to ``BAND_TOKENS`` be compared by a band join. With ``limit``, each
    token keeps its nearest terms (ties by name).
    """
    if most > MOST:
        raise ValueError(f"distances go up to {MOST}")
    if n_tokens is not None and n_tokens <= BAND_TOKENS:
        pairs = terms.join(F.broadcast(tokens), F.abs(F.length("term") - F.length("token")) <= most)
        return _nearest(_measured(pairs, most), limit)
    left = tokens.select("token", F.explode(head_variants(F.col("token"))).alias("variant"))
    met = term_variants(terms).join(F.broadcast(left) if n_tokens is not None and n_tokens <= 10_000 else left, "variant")
    return _nearest(_measured(met.select("token", "term").distinct(), most), limit)


def near_stored(tokens: list[str], variants: DataFrame, most: int, limit: int | None = None) -> DataFrame:
    """``near_terms`` over stored variants (variant, term), which are sorted by
    variant: for few tokens the scan reads the row groups that hold theirs only."""
    rows = [(t, v) for t in sorted(set(tokens)) for v in deletions_of(t[:HEAD], MOST)]
    probes = local_frame(variants.sparkSession, rows, "token string, variant string")
    wanted = sorted({v for _, v in rows})
    held = variants.where(any_equal("variant", wanted)) if len(wanted) <= PROBES else variants
    met = held.join(F.broadcast(probes) if len(rows) <= 1_000_000 else probes, "variant")
    return _nearest(_measured(met.select("token", "term").distinct(), most), limit)


def protected(term: Column, words: tuple[str, ...] | list[str]) -> Column:
    """Q6: a candidate that is a protected word, or a prefix of one from three
    letters on."""
    out = F.lit(False)
    for w in words:
        low = w.lower()
        out = out | (F.lower(term) == low) | ((F.length(term) >= 3) & F.lit(low).startswith(F.lower(term)))
    return out


def open_to_typos(token: str, one: int, two: int, words: tuple[str, ...] | list[str]) -> bool:
    """Q4, Q5: long enough for a typo, and no protected word."""
    return ((0 < one <= len(token)) or (0 < two <= len(token))) and token.lower() not in {w.lower() for w in words}


def typo_class(token: Column, distance: Column, one: Column, two: Column) -> Column:
    """Q4, Q10: 1 where the first pass reaches a term, else 2, or null."""
    return F.when((one > 0) & (F.length(token) >= one) & (distance <= 1), 1).when((two > 0) & (F.length(token) >= two), 2)


def expansions(tokens: DataFrame, near: DataFrame, words: tuple[str, ...]) -> DataFrame:
    """(qk, token, cand, cls) for tokens (qk, token, min1, min2) and the terms near
    them (token, term, distance)."""
    if words:
        near = near.where(~protected(F.col("term"), words))
    met = near.join(tokens, "token")
    cls = typo_class(F.col("token"), F.col("distance"), F.col("min1"), F.col("min2"))
    return met.select("qk", "token", F.col("term").alias("cand"), cls.alias("cls")).where("cls IS NOT NULL")
