"""Batch search: any number of queries in one plan (Q1-Q24).

queries -> tokens -> exact and fuzzy candidates -> index keys -> postings -> one row
per (query, token, document) -> hits -> filters and ranks over the few columns that
they need -> distinct -> page -> the page's documents. A single search is a batch of
one. Over a stored index the candidates are found first, in the vocabulary and the
stored variants; where there are at most ``RESOLVED`` of them the terms that they
reach go to the postings scan as a predicate. The few words of a search without typos
over an index made on the fly are compared with the terms themselves. Every join with
postings says how it is made: the planner takes postings made on the fly for as small
as the columns that they come from, and would broadcast them.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.errors import InvalidInput
from lodestone.functions.frames import any_equal, local_frame
from lodestone.functions.text import tokenize_text
from lodestone.operators.filters import compile_filters
from lodestone.operators.fuzzy import PROBES, expansions, near_stored, near_terms, open_to_typos
from lodestone.operators.index import ID, build_postings, dictionary, prefix_map, vocabulary
from lodestone.operators.rank import distinct_first, page_of, rank_all, ranking_keys
from lodestone.settings import IndexSettings, SearchQuery, page_bounds

HIT_COLUMNS = ("qk", "rank", "total", "score", "filter_score", "num_typos", "number_exact_words", "field_matches")
#: Score factors of typo classes 1 and 2 (Q10).
PENALTY = {1: 0.8, 2: 0.6}
#: Up to so many candidate rows of a batch are looked up before the postings are read;
#: more of them meet the postings in a join.
RESOLVED = 20_000
#: Up to so many rows the pages of a batch are broadcast to fetch their documents.
BROADCAST_ROWS = 100_000
REACH = "qk int, token string, cand string, cls int, field string, term string"


@dataclass
class IndexTables:
    """The frames a search reads; ``vocab`` and ``variants`` where they are stored."""

    docs: DataFrame
    postings: DataFrame
    settings: IndexSettings
    vocab: DataFrame | None = None
    variants: DataFrame | None = None

    @staticmethod
    def of(docs: DataFrame, settings: IndexSettings, id_col: str = ID) -> IndexTables:
        """Index a frame on the fly."""
        named = docs if id_col == ID else docs.withColumnRenamed(id_col, ID)
        return IndexTables(named, build_postings(named, settings), settings)

    @property
    def words(self) -> DataFrame:
        return self.vocab if self.vocab is not None else vocabulary(self.postings)


@dataclass(frozen=True)
class Token:
    """A distinct token of a query (Q1, Q4)."""

    qk: int
    token: str
    times: int
    wanted: int
    fields: tuple[str, ...]
    min1: int
    min2: int


def allowed_fields(settings: IndexSettings, query: SearchQuery) -> list[str]:
    """Q2."""
    for f in query.restrict_searchable_fields:
        if f not in settings.searchable_fields:
            raise InvalidInput(f"field '{f}' is not configured as a searchable field")
    return list(query.restrict_searchable_fields or settings.searchable_fields)


def query_tokens(settings: IndexSettings, queries: list[SearchQuery]) -> list[Token]:
    """Q1, Q4: the distinct tokens of every query; a query without a token has no
    hits."""
    out = []
    for k, q in enumerate(queries):
        one = settings.min_word_size_for_1_typo if q.min_word_size_for_1_typo is None else q.min_word_size_for_1_typo
        two = settings.min_word_size_for_2_typos if q.min_word_size_for_2_typos is None else q.min_word_size_for_2_typos
        times = Counter(tokenize_text(q.query))
        fields = tuple(allowed_fields(settings, q))
        out += [Token(k, t, n, len(times), fields, one, two) for t, n in times.items()]
    return out


def candidates(index: IndexTables, tokens: list[Token]) -> DataFrame | None:
    """Q4-Q7: fuzzy candidates (qk, token, cand, cls); none if no token may have typos."""
    words = index.settings.non_typo_tolerant_words
    free = [t for t in tokens if open_to_typos(t.token, t.min1, t.min2, words)]
    if not free:
        return None
    spark = index.docs.sparkSession
    distinct = sorted({t.token for t in free})
    if index.variants is not None:
        near = near_stored(distinct, index.variants, 2)
    else:
        near = near_terms(local_frame(spark, [(t,) for t in distinct], "token string"), dictionary(index.words, index.settings), 2, len(distinct))
    rows = local_frame(spark, [(t.qk, t.token, t.min1, t.min2) for t in free], "qk int, token string, min1 int, min2 int")
    return expansions(rows, near, words)


def reach_of(index: IndexTables, tokens: list[Token], typos: bool) -> DataFrame | list[tuple]:
    """Q2, Q3: (qk, token, cand, cls, field, term), the words that each candidate
    reaches in the fields that its query may search. In whole-word fields that is the
    candidate itself, without a look at the vocabulary. A list where a stored index
    has at most ``RESOLVED`` candidates and rows, or where nothing is looked up."""
    s = index.settings
    spark = index.docs.sparkSession
    wide = set(s.prefix_fields)
    closed = set(s.no_typo_tolerance_fields) if s.typo_field_exclusions else set()
    fields = {t.qk: t.fields for t in tokens}
    cands = [(t.qk, t.token, t.token, 0) for t in tokens]
    fuzzy = candidates(index, tokens) if typos else None
    stored = index.variants is not None
    if stored and fuzzy is not None:
        rows = fuzzy.limit(RESOLVED + 1).collect()  # bounded
        if len(rows) <= RESOLVED:
            cands, fuzzy = [*cands, *map(tuple, rows)], None
    known = [(*c, f, c[2]) for c in cands for f in fields[c[0]] if f not in wide and (c[3] == 0 or f not in closed)]
    flags = [(k, f, f in wide) for k, own in fields.items() for f in own]
    allowed = F.broadcast(local_frame(spark, flags, "k int, f string, w boolean"))
    ours = (F.col("qk") == F.col("k")) & ((F.col("cls") == 0) | ~F.col("f").isin(sorted(closed)) if closed else F.lit(True))
    parts = []
    if fuzzy is not None:
        whole = fuzzy.join(allowed, ours & ~F.col("w"))
        parts.append(whole.select("qk", "token", "cand", "cls", F.col("f").alias("field"), F.col("cand").alias("term")))
    if wide and tokens:
        every = local_frame(spark, cands, "qk int, token string, cand string, cls int")
        every = F.broadcast(every) if fuzzy is None else every.unionByName(fuzzy).hint("merge")
        words = index.words.where(F.col("field").isin(sorted(wide)))
        heads = sorted({c[2] for c in cands})
        if fuzzy is None and len(heads) <= PROBES:
            words = words.where(reduce(lambda a, b: a | b, (F.col("term").startswith(h) for h in heads)))
        met = prefix_map(words, s).join(every, F.col("prefix") == F.col("cand")).join(allowed, ours & (F.col("field") == F.col("f")))
        met = met.select("qk", "token", "cand", "cls", "field", "term").distinct()
        rows = met.limit(RESOLVED + 1).collect() if stored and fuzzy is None else None  # bounded
        if rows is not None and len(rows) <= RESOLVED:
            known += map(tuple, rows)
        else:
            parts.append(met)
    if not parts:
        return known
    return reduce(DataFrame.unionByName, [*parts, *([local_frame(spark, known, REACH)] if known else [])])


def met_postings(index: IndexTables, tokens: list[Token], typos: bool) -> DataFrame:
    """Postings with the tokens (qk, token, cand, cls, times, wanted) that reach them."""
    s = index.settings
    spark = index.docs.sparkSession
    postings = index.postings
    open_to = typos and any(open_to_typos(t.token, t.min1, t.min2, s.non_typo_tolerant_words) for t in tokens)
    exact = [(t.qk, t.token, t.token, 0, t.times, t.wanted, f, f in s.prefix_fields) for t in tokens for f in t.fields]
    if index.variants is None and not open_to and len(exact) <= PROBES:
        ours = F.broadcast(local_frame(spark, exact, "qk int, token string, cand string, cls int, times int, wanted int, f string, w boolean"))
        reached = [(F.col("field") == f) & (F.col("term").startswith(c) if w else F.col("term") == c) for c, f, w in sorted({(r[2], r[6], r[7]) for r in exact})]
        held = postings.where(reduce(lambda a, b: a | b, reached, F.lit(False)))
        on = (F.col("field") == F.col("f")) & F.when(F.col("w"), F.col("term").startswith(F.col("cand"))).otherwise(F.col("term") == F.col("cand"))
        return held.join(ours, on).drop("f", "w")
    reach = reach_of(index, tokens, typos)
    resolved = isinstance(reach, list)
    if resolved:
        terms = sorted({r[5] for r in reach})
        postings = postings.where(any_equal("term", terms) if len(terms) <= PROBES else F.col("term").isin(terms))
        reach = local_frame(spark, reach, REACH)
    weights = local_frame(spark, [(t.qk, t.token, t.times, t.wanted) for t in tokens], "qk int, token string, times int, wanted int")
    weighed = reach.join(F.broadcast(weights), ["qk", "token"])
    return postings.join(F.broadcast(weighed) if resolved else weighed.hint("merge"), ["term", "field"])


def matches(index: IndexTables, queries: list[SearchQuery], typos: bool = True) -> DataFrame:
    """Q3-Q12, Q15-Q18: hits (qk, documentID, score, num_typos, number_exact_words,
    matched) of documents that match every token exactly or by a typo."""
    s = index.settings
    met = met_postings(index, query_tokens(s, queries), typos)
    wide = F.col("field").isin(list(s.prefix_fields)) if s.prefix_fields else F.lit(False)
    weight = F.when(wide, F.lit(1.0)).otherwise(F.col("tf").cast("double"))
    exact = F.col("cls") == 0
    # exact rows suppress typos; of the typos one posting survives: class, term, weight, field
    typo = F.when(~exact, F.struct("cls", "cand", (-weight).alias("less"), "field"))
    # dealt by query and document once, which serves both groupings
    per_token = (
        met.repartition("qk", ID)
        .groupBy("qk", ID, "token", "times", "wanted")
        .agg(F.max(F.when(exact, weight)).alias("exact"), F.min(typo).alias("typo"), F.collect_set(F.when(exact, F.col("field"))).alias("fields"), F.max(exact & (F.col("term") == F.col("token"))).alias("whole"))
    )
    is_exact = F.col("exact").isNotNull()
    penalty = F.when(F.col("typo.cls") == 1, PENALTY[1]).otherwise(PENALTY[2])
    value = F.when(is_exact, F.col("exact")).otherwise(-F.col("typo.less") * penalty)
    typo_label = F.array(F.struct(F.col("typo.field").alias("field"), F.concat("typo.cand", F.lit("(typo)")).alias("label")))
    labels = F.when(is_exact, F.transform("fields", lambda f: F.named_struct(F.lit("field"), f, F.lit("label"), F.col("token")))).otherwise(typo_label)
    hits = per_token.groupBy("qk", ID).agg(
        F.sum(value * F.col("times")).alias("score"),
        F.size(F.collect_set(F.when(~is_exact, F.col("typo.cand")))).alias("num_typos"),
        F.count_if(is_exact & F.col("whole")).cast("int").alias("number_exact_words"),
        F.array_sort(F.flatten(F.collect_list(labels))).alias("matched"),
        F.count(F.lit(1)).alias("found"),
        F.max("wanted").alias("wanted"),
    )
    return hits.where("found = wanted").drop("found", "wanted")


def as_field_matches(matched: Column) -> Column:
    """Q16: map field -> sorted distinct labels."""
    fields = F.array_sort(F.array_distinct(F.transform(matched, lambda m: m["field"])))
    return F.map_from_arrays(fields, F.transform(fields, lambda f: F.array_sort(F.array_distinct(F.transform(F.filter(matched, lambda m: m["field"] == f), lambda m: m["label"])))))


def _filter_fields(tree: dict[str, Any] | None) -> set[str]:
    if not tree:
        return set()
    own = {f.get("field", "") for f in tree.get("filters") or ()}
    return own.union(*(_filter_fields(g) for g in tree.get("groups") or ()))


def _found(index: IndexTables, queries: list[SearchQuery], typos: bool) -> tuple[DataFrame, list[Column]]:
    """Hits after filters and distinct, and the keys that rank them. Of a document only
    the columns that filter, rank or tell duplicates apart are read; where there are
    none, documents are not read at all."""
    if not queries:
        raise InvalidInput("at least one query is required")
    s = index.settings
    hits = matches(index, queries, typos)
    used = {c.field for c in s.ranking_criteria} | {s.distinct_field}
    used = used.union(*(_filter_fields(q.filters) for q in queries))
    needed = [c for c in index.docs.columns if c in used and c != ID and c not in HIT_COLUMNS]
    found = index.docs.select(ID, *[F.col(f"`{c}`") for c in needed]).join(hits, ID) if needed else hits
    keep, points = F.lit(True), F.lit(0.0)
    for k, q in reversed(list(enumerate(queries))):
        if q.filters:
            m, p = compile_filters(found, q.filters, s.filterable_fields)
            if len(queries) == 1:
                keep, points = m, p
            else:
                keep, points = F.when(F.col("qk") == k, m).otherwise(keep), F.when(F.col("qk") == k, p).otherwise(points)
    found = found.where(keep).withColumn("filter_score", points)
    keys = ranking_keys(found, s.ranking_criteria)
    if s.distinct_field:
        found = distinct_first(found, s.distinct_field, keys)
    return found, keys


def _shown(ranked: DataFrame) -> DataFrame:
    return ranked.select("qk", "rank", "total", "score", "filter_score", "num_typos", "number_exact_words", as_field_matches(F.col("matched")).alias("field_matches"), ID)


def search_pages(index: IndexTables, queries: list[SearchQuery], typos: bool = True) -> DataFrame:
    """The pages of all queries without their documents: HIT_COLUMNS and documentID.
    Page and size are those of the first query (M14: they are shared)."""
    found, keys = _found(index, queries, typos)
    page, size = page_bounds(queries[0].page, queries[0].page_size)
    totals = found.groupBy("qk").agg(F.count(F.lit(1)).alias("total"))
    return _shown(page_of(found, keys, page, size).join(F.broadcast(totals), "qk"))


def search(index: IndexTables, queries: list[SearchQuery], typos: bool = True) -> DataFrame:
    """The pages of all queries with the columns of their documents, which are fetched
    for the rows of the pages only."""
    pages = search_pages(index, queries, typos)
    rows = len(queries) * page_bounds(queries[0].page, queries[0].page_size)[1]
    rest = [c for c in index.docs.columns if c not in HIT_COLUMNS]
    met = index.docs.join(F.broadcast(pages) if rows <= BROADCAST_ROWS else pages, ID)
    return met.select(*HIT_COLUMNS, *[F.col(f"`{c}`") for c in rest])


def search_all(index: IndexTables, queries: list[SearchQuery], typos: bool = True) -> DataFrame:
    """Every hit of all queries with the columns of its document, whatever page and size
    they name. Ranks are given part by part, so no task holds all hits of a query."""
    found, keys = _found(index, queries, typos)
    rest = [c for c in index.docs.columns if c not in HIT_COLUMNS]
    met = index.docs.join(_shown(rank_all(found, keys)).hint("merge"), ID)
    return met.select(*HIT_COLUMNS, *[F.col(f"`{c}`") for c in rest])


def fetch_documents(index: IndexTables, ids: list[str], columns: list[str]) -> DataFrame:
    """Q13: documents by identifier; the identifiers reach the scan."""
    where = any_equal(ID, ids) if len(ids) <= PROBES else F.col(ID).isin(ids)
    return index.docs.where(where).select(*[F.col(f"`{c}`") for c in dict.fromkeys([ID, *columns])])
