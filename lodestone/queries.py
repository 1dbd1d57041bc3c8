"""Registered queries over the driver's tables and the DuckDB SQL that checks them.

Tables stand in for indexes: ``documents`` (field text), ``part`` (fields p_name and
p_type), ``events`` (as search events), ``orders`` and ``customer`` for filters.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.coerce import to_number, to_time
from lodestone.functions.distance import alignment_distance
from lodestone.functions.text import field_length, prefix_ngrams, prefixes, search_type, tokenize
from lodestone.operators import analytics, bm25, jobstats
from lodestone.operators.filters import compile_filters
from lodestone.operators.fuzzy import near_terms
from lodestone.operators.index import ID, build_postings, clean_documents, dictionary, find_document, list_documents, lookup_term, merge_postings, prefix_map, replace_documents, vocabulary
from lodestone.operators.rank import distinct_first, page_of, ranking_keys
from lodestone.plans.search import IndexTables, search
from lodestone.settings import IndexSettings, RankingCriterion, SearchQuery

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

WORDS = IndexSettings("documents", ("text",), (), (), 4, 7, ("text",))
PARTS = IndexSettings("part", ("p_name", "p_type"), ("p_size",), (), 4, 7, ("p_type",))


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").withColumn(ID, F.col("doc_id").cast("string"))


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "part").withColumn(ID, F.lpad(F.col("p_partkey").cast("string"), 9, "0"))


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[name] = f
        if oracle is not None:
            ORACLE_SQL[name] = oracle
        return f

    return register


# --- SQL building blocks -----------------------------------------------------------------

_SPLIT = "regexp_replace(regexp_replace({0}, '([A-Z]+)([A-Z][a-z])', '\\1 \\2', 'g'), '([a-z0-9])([A-Z])', '\\1 \\2', 'g')"


def _tokens(c: str) -> str:
    return f"regexp_extract_all(lower({_SPLIT.format(f"coalesce({c}, '')")}), '[a-z0-9]+')"


_DOC_TOKENS = f"tok AS (SELECT doc_id, unnest({_tokens('text')}) AS term FROM documents)"
_TF = f"{_DOC_TOKENS}, tf AS (SELECT doc_id, term, count(*) AS tf FROM tok GROUP BY ALL)"
_PART_TF = f"""ptok AS (SELECT p_partkey, 'p_name' AS field, unnest({_tokens("p_name")}) AS term FROM part UNION ALL SELECT p_partkey, 'p_type', unnest({_tokens("p_type")}) FROM part),
ptf AS (SELECT p_partkey, field, term, count(*) AS tf FROM ptok GROUP BY ALL),
pvocab AS (SELECT DISTINCT field, term FROM ptf),
pmap AS (SELECT field, term, unnest(CASE WHEN field = 'p_name' THEN list_transform(range(1, len(term) + 1), lambda i: term[1:i]) ELSE [term] END) AS prefix FROM pvocab)"""


# --- text analysis -----------------------------------------------------------------------


@query("t1_tokenize", f"SELECT doc_id, CAST(len({_tokens('text')}) AS BIGINT) AS n_tokens, array_to_string({_tokens('text')}, ' ') AS tokens FROM documents")
def t1_tokenize(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = tokenize(F.col("text"))
    return _table(spark, sf_dir, "documents").select("doc_id", F.size(tokens).cast("long").alias("n_tokens"), F.array_join(tokens, " ").alias("tokens"))


@query("t2_prefixes", f"WITH {_PART_TF} SELECT term, array_to_string(list_transform(range(1, len(term) + 1), lambda i: term[1:i]), ' ') AS prefixes FROM (SELECT DISTINCT term FROM ptf)")
def t2_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build_postings(_parts(spark, sf_dir), PARTS).select("term").distinct().select("term", F.array_join(prefixes(F.col("term")), " ").alias("prefixes"))


@query(
    "t3_prefix_ngrams",
    f"""WITH t AS (SELECT p_partkey, {_tokens("p_name")} AS w FROM part),
g AS (SELECT p_partkey, i, unnest(list_prepend(w[i], list_transform(range(1, len(w[i]) + 1), lambda k: w[i][1:k]))) AS gram, unnest(range(0, len(w[i]) + 1)) AS k FROM (SELECT p_partkey, w, unnest(range(1, len(w) + 1)) AS i FROM t)),
f AS (SELECT p_partkey, gram, min(i * 1000 + k) AS first_at FROM g GROUP BY ALL)
SELECT p_partkey, string_agg(gram, ' ' ORDER BY first_at) AS ngrams FROM f GROUP BY p_partkey""",
)
def t3_prefix_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "part").select("p_partkey", F.array_join(prefix_ngrams(F.col("p_name")), " ").alias("ngrams"))


@query("t6_field_length", "SELECT doc_id, CAST(len(regexp_extract_all(coalesce(text, ''), '[^ \\t\\r\\n]+')) AS BIGINT) AS n_words FROM documents")
def t6_field_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return docs.select("doc_id", field_length(docs, "text").cast("long").alias("n_words"))


@query("q25_search_type", """SELECT p_partkey, CASE WHEN p_size > 40 OR p_name = '' THEN 'filtered' WHEN contains(p_name, '*') OR contains(p_name, '?') THEN 'wildcard'
WHEN len(regexp_extract_all(p_name, '\\S+')) = 1 AND strlen(p_name) > 3 THEN 'fuzzy_search' ELSE 'exact_match' END AS search_type FROM part""")  # fmt: skip
def q25_search_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "part").select("p_partkey", search_type(F.col("p_name"), F.col("p_size") > 40).alias("search_type"))


# --- index -------------------------------------------------------------------------------


@query("i1_term_frequency", f"WITH {_TF} SELECT doc_id, term, tf FROM tf")
def i1_term_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build_postings(_docs(spark, sf_dir), WORDS).select(F.col(ID).cast("long").alias("doc_id"), "term", "tf")


@query("i2_posting_list", f"WITH {_PART_TF} SELECT p_partkey, ptf.field, max(CASE WHEN ptf.field = 'p_name' THEN 1.0 ELSE tf END)::DOUBLE AS score FROM ptf JOIN pmap USING (field, term) WHERE prefix = 's' GROUP BY ALL")
def i2_posting_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    postings = build_postings(_parts(spark, sf_dir), PARTS)
    return lookup_term(postings, PARTS, "s").select(F.col(ID).cast("long").alias("p_partkey"), "field", "score")


@query("s7_vocabulary", f"WITH {_DOC_TOKENS} SELECT DISTINCT term, 'text' AS field FROM tok")
def s7_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vocabulary(build_postings(_docs(spark, sf_dir), WORDS))


@query("s7_prefix_map", f"WITH {_PART_TF} SELECT prefix, field, term FROM pmap")
def s7_prefix_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_map(vocabulary(build_postings(_parts(spark, sf_dir), PARTS)), PARTS).select("prefix", "field", "term")


@query("s4_list_page", "SELECT p_partkey, p_name, (SELECT count(*) FROM part) AS total FROM part ORDER BY lpad(CAST(p_partkey AS VARCHAR), 9, '0') LIMIT 25 OFFSET 50")
def s4_list_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, total = list_documents(_parts(spark, sf_dir), 3, 25)
    return rows.select("p_partkey", "p_name", F.lit(total).cast("long").alias("total"))


@query("s5_point_lookup", "SELECT doc_id, text, lang FROM documents WHERE doc_id = 17")
def s5_point_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_document(_docs(spark, sf_dir), "17").select("doc_id", "text", "lang")


@query("s2_rejects", "SELECT p_partkey, CASE WHEN p_size % 7 = 0 THEN 'documentID is missing' ELSE 'documentID is blank' END AS reason FROM part WHERE p_size % 7 = 0 OR p_size % 5 = 0")
def s2_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    ident = F.when(F.col("p_size") % 7 == 0, None).when(F.col("p_size") % 5 == 0, "  ").otherwise(F.col("p_name"))
    return clean_documents(_table(spark, sf_dir, "part").withColumn(ID, ident))[1].select("p_partkey", "reason")


@query("s3_trimmed", "SELECT p_partkey, p_name AS id FROM part")
def s3_trimmed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean_documents(_table(spark, sf_dir, "part").withColumn(ID, F.concat(F.lit(" \t "), "p_name", F.lit("  \n"))))[0].select("p_partkey", F.col(ID).alias("id"))


@query("i3_merge_postings", f"WITH {_TF} SELECT t.doc_id, t.term, CASE WHEN d.lang = 'fr' THEN tf * 10 ELSE tf END AS tf FROM tf t JOIN documents d USING (doc_id)")
def i3_merge_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    old = build_postings(docs, WORDS)
    new = build_postings(docs.where("lang = 'fr'"), WORDS).withColumn("tf", F.col("tf") * 10)
    return merge_postings(old, new).select(F.col(ID).cast("long").alias("doc_id"), "term", "tf")


@query("i4_upsert", "SELECT doc_id, CASE WHEN lang = 'fr' THEN concat(text, ' updated') ELSE text END AS text, lang FROM documents")
def i4_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    new = docs.where("lang = 'fr'").withColumn("text", F.concat("text", F.lit(" updated")))
    return replace_documents(docs, new, new).select("doc_id", "text", "lang")


@query("i11_delete", f"WITH {_TF} SELECT doc_id, term, tf FROM tf WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE lang = 'es')")
def i11_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    return replace_documents(build_postings(docs, WORDS), docs.where("lang = 'es'"), None).select(F.col(ID).cast("long").alias("doc_id"), "term", "tf")


# --- fuzzy -------------------------------------------------------------------------------

_PROBES = ("forthe", "erwnsh", "inthe", "lichng", "onthat", "andht")


def _probes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(p,) for p in _PROBES], "token string")


# restricted distance in SQL: rows of the table are lists, folded over both words
_OSA = """(CASE WHEN len({a}) = 0 THEN len({b}) WHEN len({b}) = 0 THEN len({a}) ELSE list_reduce(
 list_prepend([range(0, len({b}) + 1), range(0, len({b}) + 1)], list_transform(range(1, len({a}) + 1), lambda i: [[i]])),
 lambda s, q: [s[2], list_reduce(list_prepend([q[1][1]], list_transform(range(1, len({b}) + 1), lambda j: [j])),
   lambda r, p: list_append(r, least(s[2][p[1] + 1] + 1, r[p[1]] + 1, s[2][p[1]] + (CASE WHEN {a}[q[1][1]] = {b}[p[1]] THEN 0 ELSE 1 END),
     CASE WHEN q[1][1] > 1 AND p[1] > 1 AND {a}[q[1][1]] = {b}[p[1] - 1] AND {a}[q[1][1] - 1] = {b}[p[1]] THEN s[1][p[1] - 1] + (CASE WHEN {a}[q[1][1]] = {b}[p[1]] THEN 0 ELSE 1 END) ELSE 1000000 END)))])[2][len({b}) + 1] END)"""


def _fuzzy_sql(most: int, tokens: int = len(_PROBES)) -> str:
    probes = ", ".join(f"('{p}')" for p in _PROBES[:tokens])
    return f"""WITH {_DOC_TOKENS}, v AS (SELECT DISTINCT term FROM tok), q(token) AS (VALUES {probes}),
c AS (SELECT token, term FROM q JOIN v ON abs(len(token) - len(term)) <= {most} AND token <> term AND levenshtein(token, term) <= {2 * most})
SELECT token, term, CAST({_OSA.format(a="token", b="term")} AS INTEGER) AS distance FROM c WHERE {_OSA.format(a="token", b="term")} <= {most}"""


@query("q7_fuzzy_one", _fuzzy_sql(1))
def q7_fuzzy_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = vocabulary(build_postings(_docs(spark, sf_dir), WORDS)).select("term")
    return near_terms(_probes(spark), terms, 1, len(_PROBES))


@query("q7_fuzzy_two", _fuzzy_sql(2))
def q7_fuzzy_two(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Any number of tokens: an equi-join on deletion variants."""
    terms = vocabulary(build_postings(_docs(spark, sf_dir), WORDS)).select("term")
    return near_terms(_probes(spark), terms, 2)


@query("q7_fuzzy_band", _fuzzy_sql(2, 2))
def q7_fuzzy_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two tokens: a band join on the length."""
    terms = vocabulary(build_postings(_docs(spark, sf_dir), WORDS)).select("term")
    return near_terms(_probes(spark).where(F.col("token").isin(*_PROBES[:2])), terms, 2, 2)


@query("t7_distance", f"SELECT a.n_name AS a, b.n_name AS b, CAST({_OSA.format(a='a.n_name', b='b.n_name')} AS INTEGER) AS distance FROM nation a, nation b WHERE a.n_nationkey < b.n_nationkey")
def t7_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = _table(spark, sf_dir, "nation")
    a, b = names.select(F.col("n_nationkey").alias("ka"), F.col("n_name").alias("a")), names.select(F.col("n_nationkey").alias("kb"), F.col("n_name").alias("b"))
    return a.join(F.broadcast(b), F.col("ka") < F.col("kb")).select("a", "b", alignment_distance(F.col("a"), F.col("b")).alias("distance"))


# --- filters -----------------------------------------------------------------------------


def _filtered(df: DataFrame, tree: dict, keep: list[str]) -> DataFrame:
    m, s = compile_filters(df, tree, tuple(df.columns))
    return df.where(m).select(*keep, s.alias("filter_score"))


def _leaf(field: str, operator: str, value, score: float = 0.0) -> dict:
    return {"field": field, "operator": operator, "value": value, "score": score}


@query("f1_and", "SELECT o_orderkey, 5.0::DOUBLE AS filter_score FROM orders WHERE o_totalprice > 200000 AND o_orderpriority = '1-URGENT'")
def f1_and(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _filtered(_table(spark, sf_dir, "orders"), {"operator": "AND", "filters": [_leaf("o_totalprice", "_gt", 200000, 2), _leaf("o_orderpriority", "_exact", "1-URGENT", 3)]}, ["o_orderkey"])


@query("f2_or_score", "SELECT o_orderkey, (CASE WHEN o_totalprice >= 300000 THEN 2.5 ELSE 0 END + CASE WHEN o_orderstatus = 'F' THEN 1.5 ELSE 0 END)::DOUBLE AS filter_score FROM orders WHERE o_totalprice >= 300000 OR o_orderstatus = 'F'")
def f2_or_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _filtered(_table(spark, sf_dir, "orders"), {"filters": [_leaf("o_totalprice", "_gte", "300000", 2.5), _leaf("o_orderstatus", "", "F", 1.5)]}, ["o_orderkey"])


@query(
    "f5_nested",
    """SELECT c_custkey, (CASE WHEN c_mktsegment = 'BUILDING' THEN 2 ELSE 0 END + CASE WHEN c_mktsegment = 'MACHINERY' THEN 1.5 ELSE 0 END + CASE WHEN c_acctbal > 5000 THEN 3 ELSE 0 END + CASE WHEN c_nationkey <= 5 THEN 0.5 ELSE 0 END)::DOUBLE AS filter_score
FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND (c_acctbal > 5000 OR c_nationkey <= 5)""",
)
def f5_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree = {
        "operator": "AND",
        "groups": [
            {"operator": "OR", "filters": [_leaf("c_mktsegment", "_exact", "BUILDING", 2), _leaf("c_mktsegment", "_exact", "MACHINERY", 1.5)]},
            {"operator": "OR", "filters": [_leaf("c_acctbal", "_gt", 5000, 3), _leaf("c_nationkey", "_lte", 5, 0.5)]},
        ],
    }
    return _filtered(_table(spark, sf_dir, "customer"), tree, ["c_custkey"])


@query("f4_empty_group", "SELECT r_regionkey, 0.0::DOUBLE AS filter_score FROM region")
def f4_empty_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _filtered(_table(spark, sf_dir, "region"), {"operator": "OR", "filters": [_leaf("r_name", "_exact", "NOWHERE", 1)], "groups": [{"operator": "AND"}]}, ["r_regionkey"])


@query("f12_contains", "SELECT p_partkey, 1.0::DOUBLE AS filter_score FROM part WHERE contains(lower(p_name), 'ri')")
def f12_contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _filtered(_table(spark, sf_dir, "part"), {"filters": [_leaf("p_name", "_contains", "RI", 1)]}, ["p_partkey"])


@query("f13_ncontains", "SELECT p_partkey, 0.0::DOUBLE AS filter_score FROM part WHERE NOT contains(lower(p_name), 'ri') AND p_size <> 7")
def f13_ncontains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _filtered(_table(spark, sf_dir, "part"), {"operator": "AND", "filters": [_leaf("p_name", "_ncontains", "ri"), _leaf("p_size", "_ne", 7), _leaf("p_size", "_ncontains", "x")]}, ["p_partkey"])


_WORD_ARRAY = f"{_tokens('p_name')}"


@query("f14_any_of", f"SELECT p_partkey, 1.0::DOUBLE AS filter_score FROM part WHERE list_has_any({_WORD_ARRAY}, ['red', 'blue']) OR p_size IN (3, 14)")
def f14_any_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = _table(spark, sf_dir, "part").withColumn("words", tokenize(F.col("p_name")))
    tree = {"filters": [_leaf("words", "_contains_any_of", ["red", "blue"]), _leaf("p_size", "_contains_any_of", [3, "14"])]}
    m, _ = compile_filters(parts, tree, ("words", "p_size"))
    return parts.where(m).select("p_partkey", F.lit(1.0).alias("filter_score"))


@query("f9_array_any", f"SELECT p_partkey, 2.0::DOUBLE AS filter_score FROM part WHERE len(list_filter({_WORD_ARRAY}, lambda x: x > 'm')) > 0 AND NOT list_contains({_WORD_ARRAY}, 'red')")
def f9_array_any(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = _table(spark, sf_dir, "part").withColumn("words", tokenize(F.col("p_name")))
    return _filtered(parts, {"operator": "AND", "filters": [_leaf("words", "_gt", "m", 2), _leaf("words", "_ne", "red")]}, ["p_partkey"])


@query("f19_date_range", "SELECT o_orderkey, 0.0::DOUBLE AS filter_score FROM orders WHERE o_orderdate >= TIMESTAMP '1995-03-01' AND o_orderdate < TIMESTAMP '1995-06-01 12:00:00'")
def f19_date_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _filtered(_table(spark, sf_dir, "orders"), {"operator": "AND", "filters": [_leaf("o_orderdate", "_gte", "1995-03-01"), _leaf("o_orderdate", "_lt", "1995-06-01T12:00:00Z")]}, ["o_orderkey"])


@query("f20_date_text", "SELECT o_orderkey, 1.0::DOUBLE AS filter_score FROM orders WHERE o_orderdate > TIMESTAMP '1996-01-01'")
def f20_date_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = _table(spark, sf_dir, "orders").withColumn("order_date", F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    return _filtered(orders, {"operator": "AND", "filters": [_leaf("order_date", "_gt", "1996-01-01", 1), _leaf("order_date", "_ncontains", "19")]}, ["o_orderkey"])


@query("f8_missing", "SELECT event_id, 0.0::DOUBLE AS filter_score FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL AND CAST(json_extract_string(props, '$.k') AS DOUBLE) <> 50")
def f8_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k"))
    m, s = compile_filters(events, {"operator": "AND", "filters": [_leaf("k", "_gt", -1), _leaf("absent", "_ne", "x")]}, ("k",))
    ok, _ = compile_filters(events, {"operator": "AND", "filters": [_leaf("k", "_gte", 0)], "groups": [{"filters": [_leaf("k", "_lt", 50), _leaf("k", "_gt", 50)]}]}, ("k",))
    return events.where(ok & ~m).select("event_id", s.alias("filter_score"))


@query("f18_numeric_text", "SELECT event_id, 0.0::DOUBLE AS filter_score FROM events WHERE CAST(json_extract_string(props, '$.k') AS DOUBLE) > 9")
def f18_numeric_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k"))
    return _filtered(events, {"filters": [_leaf("k", "_gt", "9")]}, ["event_id"])


@query("f18_coercions", "SELECT p_partkey, TRY_CAST(CASE WHEN regexp_full_match(p_name, '[+-]?[0-9]+(\\.[0-9]*)?') THEN p_name END AS DOUBLE) AS number, CAST(epoch(TIMESTAMP '1970-01-01' + INTERVAL (p_size) SECOND) AS BIGINT) AS seconds FROM part")
def f18_coercions(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = _table(spark, sf_dir, "part")
    size = F.col("p_size").cast("long")
    kinds = {f.name: f.dataType for f in parts.withColumn("size", size).schema.fields}
    return parts.select("p_partkey", to_number(F.col("p_name"), kinds["p_name"]).alias("number"), F.unix_timestamp(to_time(size, kinds["size"])).alias("seconds"))


# --- search ------------------------------------------------------------------------------


def _page(df: DataFrame, keep: list[str]) -> DataFrame:
    return df.select("qk", F.col("rank").cast("long").alias("rank"), "total", F.round("score", 6).alias("score"), "num_typos", "number_exact_words", *keep)


def _and_sql(words: list[str], order: str = "score DESC, k", limit: str = "rank <= 10", extra: str = "", where: str = "true") -> str:
    terms = ", ".join(f"'{w}'" for w in words)
    return f"""WITH {_TF}, hit AS (SELECT doc_id, CAST(doc_id AS VARCHAR) AS k, sum(tf)::DOUBLE AS score FROM tf WHERE term IN ({terms}) GROUP BY doc_id HAVING count(*) = {len(words)}),
ranked AS (SELECT hit.*, d.lang, d.source, d.n_chars, row_number() OVER (ORDER BY {order}) AS rank, count(*) OVER () AS total FROM hit JOIN documents d USING (doc_id) WHERE {where})
SELECT 0 AS qk, rank, total, round(score, 6) AS score, 0 AS num_typos, {len(words)} AS number_exact_words, doc_id{extra} FROM ranked WHERE {limit}"""


@query("q12_search_and", _and_sql(["the", "of"]))
def q12_search_and(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: documents that hold both words, by term frequency, first page."""
    index = IndexTables.of(_docs(spark, sf_dir), WORDS)
    return _page(search(index, [SearchQuery("the of")], typos=False), ["doc_id"])


@query("q20_search_ranked", _and_sql(["the", "and"], "n_chars DESC NULLS LAST, score DESC, k", "rank BETWEEN 21 AND 40", ", lang"))
def q20_search_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    settings = IndexSettings("documents", ("text",), (), (RankingCriterion("n_chars", "desc"), RankingCriterion("~score", "desc")), 4, 7, ("text",))
    return _page(search(IndexTables.of(_docs(spark, sf_dir), settings), [SearchQuery("the and", page=2, page_size=20)], typos=False), ["doc_id", "lang"])


@query(
    "q21_search_distinct",
    f"""WITH {_TF}, hit AS (SELECT doc_id, CAST(doc_id AS VARCHAR) AS k, tf::DOUBLE AS score FROM tf WHERE term = 'de'),
first_of AS (SELECT hit.*, source, row_number() OVER (PARTITION BY source ORDER BY score DESC, k) AS n FROM hit JOIN documents USING (doc_id)),
ranked AS (SELECT *, row_number() OVER (ORDER BY score DESC, k) AS rank, count(*) OVER () AS total FROM first_of WHERE n = 1)
SELECT 0 AS qk, rank, total, score, 0 AS num_typos, 1 AS number_exact_words, doc_id, source FROM ranked WHERE rank <= 10""",
)
def q21_search_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    settings = IndexSettings("documents", ("text",), (), (), 4, 7, ("text",), (), (), "source")
    return _page(search(IndexTables.of(_docs(spark, sf_dir), settings), [SearchQuery("de")], typos=False), ["doc_id", "source"])


@query("q14_search_filtered", _and_sql(["the"], "score DESC, k", "rank <= 10", "", "n_chars > 2000 AND source <> 'src0'"))
def q14_search_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree = {"operator": "AND", "filters": [_leaf("n_chars", "_gt", 2000), _leaf("source", "_ne", "src0")]}
    return _page(search(IndexTables.of(_docs(spark, sf_dir), WORDS), [SearchQuery("the", filters=tree)], typos=False), ["doc_id"])


@query(
    "q3_search_prefix",
    f"""WITH {_PART_TF}, hit AS (SELECT p_partkey, max(CASE WHEN ptf.field = 'p_name' THEN 1.0 ELSE tf END) AS score, max(CASE WHEN term = prefix THEN 1 ELSE 0 END) AS words FROM ptf JOIN pmap USING (field, term) WHERE prefix = 're' GROUP BY p_partkey),
ranked AS (SELECT *, row_number() OVER (ORDER BY score DESC, lpad(CAST(p_partkey AS VARCHAR), 9, '0')) AS rank, count(*) OVER () AS total FROM hit)
SELECT 0 AS qk, rank, total, score::DOUBLE AS score, 0 AS num_typos, CAST(words AS INTEGER) AS number_exact_words, p_partkey FROM ranked WHERE rank <= 10""",
)
def q3_search_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _page(search(IndexTables.of(_parts(spark, sf_dir), PARTS), [SearchQuery("re")], typos=False), ["p_partkey"])


def _typo_sql() -> str:
    return f"""WITH {_TF}, v AS (SELECT DISTINCT term FROM tf),
cand AS (SELECT term, {_OSA.format(a="'tahtthe'", b="term")} AS d FROM v WHERE abs(len(term) - 7) <= 2 AND levenshtein('tahtthe', term) <= 4 AND term <> 'tahtthe'),
m AS (SELECT doc_id, tf, term, CASE WHEN d <= 1 THEN 1 WHEN d <= 2 THEN 2 END AS cls FROM tf JOIN cand USING (term) WHERE d <= 2),
one AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY cls, term, tf DESC) AS n FROM m),
hit AS (SELECT doc_id, CAST(doc_id AS VARCHAR) AS k, tf * CASE cls WHEN 1 THEN 0.8 ELSE 0.6 END AS score, term FROM one WHERE n = 1 AND doc_id NOT IN (SELECT doc_id FROM tf WHERE term = 'tahtthe')
 UNION ALL SELECT doc_id, CAST(doc_id AS VARCHAR), tf, NULL FROM tf WHERE term = 'tahtthe'),
ranked AS (SELECT *, row_number() OVER (ORDER BY score DESC, k) AS rank, count(*) OVER () AS total FROM hit)
SELECT 0 AS qk, rank, total, round(score::DOUBLE, 6) AS score, CASE WHEN term IS NULL THEN 0 ELSE 1 END AS num_typos, CASE WHEN term IS NULL THEN 1 ELSE 0 END AS number_exact_words, doc_id, term || '(typo)' AS label FROM ranked WHERE rank <= 50"""


@query("q9_search_typo", _typo_sql())
def q9_search_typo(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = search(IndexTables.of(_docs(spark, sf_dir), WORDS), [SearchQuery("tahtthe", page_size=50)])
    label = F.get(F.col("field_matches")["text"], F.lit(0))
    return _page(found.withColumn("label", F.when(F.col("num_typos") > 0, label)), ["doc_id", "label"])


def _multi(name: int, word: str, where: str) -> str:
    return f"SELECT {name} AS qk, doc_id, CAST(doc_id AS VARCHAR) AS k, tf::DOUBLE AS score FROM tf JOIN documents USING (doc_id) WHERE term = '{word}' AND {where}"


@query(
    "q23_multi_search",
    f"""WITH {_TF}, hit AS ({_multi(0, "the", "true")} UNION ALL {_multi(1, "und", "lang = 'de'")} UNION ALL {_multi(2, "la", "n_chars >= 500")}),
ranked AS (SELECT *, row_number() OVER (PARTITION BY qk ORDER BY score DESC, k) AS rank, count(*) OVER (PARTITION BY qk) AS total FROM hit)
SELECT qk, rank, total, score, 0 AS num_typos, 1 AS number_exact_words, doc_id FROM ranked WHERE rank <= 10""",
)
def q23_multi_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    queries = [SearchQuery("the", name="a"), SearchQuery("und", name="b", filters={"filters": [_leaf("lang", "_exact", "de")]}), SearchQuery("la", name="c", filters={"filters": [_leaf("n_chars", "_gte", 500)]})]
    return _page(search(IndexTables.of(_docs(spark, sf_dir), WORDS), queries, typos=False), ["doc_id"])


@query(
    "q20_null_order",
    """SELECT p_partkey, row_number() OVER (ORDER BY CASE WHEN p_size % 3 = 0 THEN NULL ELSE p_size END ASC NULLS FIRST, p_retailprice DESC, lpad(CAST(p_partkey AS VARCHAR), 9, '0')) AS rank FROM part QUALIFY rank <= 40""",
)
def q20_null_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = _parts(spark, sf_dir).withColumns({"size": F.when(F.col("p_size") % 3 != 0, F.col("p_size")), "score": F.col("p_retailprice"), "qk": F.lit(0)})
    return page_of(parts, ranking_keys(parts, (RankingCriterion("size", "asc"),)), 1, 40).select("p_partkey", F.col("rank").cast("long").alias("rank"))


@query("q21_distinct_numbers", "SELECT p_partkey FROM part QUALIFY p_size % 5 = 0 OR row_number() OVER (PARTITION BY CASE WHEN p_size % 5 = 0 THEN NULL ELSE p_size END ORDER BY p_retailprice DESC, lpad(CAST(p_partkey AS VARCHAR), 9, '0')) = 1")
def q21_distinct_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = _parts(spark, sf_dir).withColumns({"size": F.when(F.col("p_size") % 5 != 0, F.col("p_size").cast("double")), "score": F.col("p_retailprice"), "qk": F.lit(0)})
    return distinct_first(parts, "size", ranking_keys(parts, ())).select("p_partkey")


# --- BM25 --------------------------------------------------------------------------------


@query("b1_document_frequency", f"WITH {_DOC_TOKENS} SELECT term AS key, count(DISTINCT doc_id) AS df, round(ln((SELECT count(*) FROM documents) / count(DISTINCT doc_id)), 9) AS idf FROM tok GROUP BY term")
def b1_document_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    freq = bm25.document_frequency(build_postings(docs, WORDS), WORDS)
    n = docs.agg(F.count(F.lit(1)).alias("n"))
    return freq.crossJoin(F.broadcast(n)).select("key", "df", F.round(bm25.inverse_frequency(F.col("n"), F.col("df")), 9).alias("idf"))


@query(
    "b5_bm25",
    f"""WITH {_TF}, len AS (SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '[^ \\t\\r\\n]+')) AS dl FROM documents), c AS (SELECT count(*) AS n, avg(dl) AS average FROM len),
f AS (SELECT term, count(*) AS df FROM tf WHERE term IN ('the', 'und', 'que') GROUP BY term)
SELECT doc_id, term AS token, round(ln(n / df) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / average)), 9) AS bm25 FROM tf JOIN f USING (term) JOIN len USING (doc_id), c""",
)
def b5_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    scores = bm25.bm25_scores(docs, build_postings(docs, WORDS), WORDS, ["the", "und", "que"])
    return scores.select(F.col(ID).cast("long").alias("doc_id"), "token", F.round("bm25", 9).alias("bm25"))


# --- analytics ---------------------------------------------------------------------------

_EVENTS = "ev AS (SELECT 'index' || CAST(user_id % 7 AS VARCHAR) AS index_name, CASE WHEN user_id % 11 = 0 THEN '' ELSE 'word' || CAST(user_id % 50 AS VARCHAR) END AS query, CASE event_type WHEN 'click' THEN 'exact_match' WHEN 'view' THEN 'wildcard' WHEN 'purchase' THEN 'fuzzy_search' ELSE 'multi_search' END AS search_type, CAST(floor(abs(value) * 1000000) AS BIGINT) AS ns, ts FROM events), span AS (SELECT max(ts) AS now FROM ev)"


def _events(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, Column]:
    raw = _table(spark, sf_dir, "events")
    kind = F.when(F.col("event_type") == "click", "exact_match").when(F.col("event_type") == "view", "wildcard").when(F.col("event_type") == "purchase", "fuzzy_search").otherwise("multi_search")
    user = F.col("user_id")
    events = raw.select(
        F.concat(F.lit("index"), (user % 7).cast("string")).alias("index_name"),
        F.when(user % 11 == 0, "").otherwise(F.concat(F.lit("word"), (user % 50).cast("string"))).alias("query"),
        kind.alias("search_type"),
        F.floor(F.abs("value") * 1_000_000).cast("long").alias("response_time"),
        F.lit(1).alias("result_count"),
        F.col("ts").alias("timestamp"),
    )
    return events, raw.agg(F.max("ts")).first()[0]


@query("a2_recent", f"WITH {_EVENTS} SELECT search_type, count(*) AS n FROM ev, span WHERE ts > now - INTERVAL 3 DAY AND ts < now GROUP BY 1")
def a2_recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    events, now = _events(spark, sf_dir)
    return analytics.between(events, now - timedelta(days=3), now).groupBy("search_type").agg(F.count(F.lit(1)).alias("n"))


@query(
    "a4_summary",
    f"""WITH {_EVENTS}, x AS (SELECT count(*) FILTER (ts > now - INTERVAL 1 DAY) AS cur, count(*) FILTER (ts > now - INTERVAL 14 DAY AND ts < now - INTERVAL 7 DAY) AS prev,
 coalesce((sum(ns) FILTER (ts > now - INTERVAL 1 DAY)) // nullif(count(*) FILTER (ts > now - INTERVAL 1 DAY), 0) // 1000000, 0) AS ms, coalesce((sum(ns) FILTER (ts > now - INTERVAL 14 DAY AND ts < now - INTERVAL 7 DAY)) // nullif(count(*) FILTER (ts > now - INTERVAL 14 DAY AND ts < now - INTERVAL 7 DAY), 0) // 1000000, 0) AS pms FROM ev, span)
SELECT cur AS total_searches, round(CASE WHEN prev = 0 THEN CASE WHEN cur > 0 THEN 100.0 ELSE 0.0 END ELSE (cur - prev) * 100.0 / prev END, 6)::DOUBLE AS searches_change, CAST(ms AS BIGINT) AS avg_response_ms,
 CASE WHEN pms <> 0 AND (ms - pms) / pms > 0.1 THEN 'up' WHEN pms <> 0 AND (ms - pms) / pms < -0.1 THEN 'down' ELSE 'stable' END AS response_trend FROM x""",
)
def a4_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    events, now = _events(spark, sf_dir)
    return analytics.summary(events, now).withColumn("searches_change", F.round("searches_change", 6))


@query(
    "a9_hourly",
    f"WITH {_EVENTS} SELECT CAST(h AS INTEGER) AS hour, count(ns) AS searches, CAST(coalesce(sum(ns) // nullif(count(ns), 0) // 1000000, 0) AS BIGINT) AS avg_ms FROM range(24) r(h) LEFT JOIN (SELECT ns, hour(ts) AS hh FROM ev, span WHERE ts > now - INTERVAL 1 DAY) ON h = hh GROUP BY h",
)
def a9_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    events, now = _events(spark, sf_dir)
    return analytics.hourly(analytics.after(events, now - timedelta(days=1)))


@query("a10_popular", f"WITH {_EVENTS} SELECT query, count(*) AS searches, 'stable' AS trend FROM ev, span WHERE ts > now - INTERVAL 7 DAY AND query <> '' GROUP BY query ORDER BY 2 DESC, 1 LIMIT 5")
def a10_popular(spark: SparkSession, sf_dir: str) -> DataFrame:
    events, now = _events(spark, sf_dir)
    return analytics.popular(analytics.after(events, now - timedelta(days=7)))


@query(
    "a11_index_usage",
    f"WITH {_EVENTS}, ix AS (SELECT 'index' || CAST(n_nationkey AS VARCHAR) AS index_name, CAST(n_nationkey * 100 AS BIGINT) AS documents FROM nation) SELECT index_name, count(ns) AS searches, documents, round(documents * 0.001, 6)::DOUBLE AS size_mb FROM ix LEFT JOIN (SELECT index_name, ns FROM ev, span WHERE ts > now - INTERVAL 7 DAY) USING (index_name) GROUP BY ALL",
)
def a11_index_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    events, now = _events(spark, sf_dir)
    indexes = _table(spark, sf_dir, "nation").select(F.concat(F.lit("index"), F.col("n_nationkey").cast("string")).alias("index_name"), (F.col("n_nationkey") * 100).cast("long").alias("documents"))
    return analytics.index_usage(analytics.after(events, now - timedelta(days=7)), indexes).withColumn("size_mb", F.round("size_mb", 6))


@query(
    "a12_response_buckets",
    f"WITH {_EVENTS}, b AS (SELECT CASE WHEN ns // 1000000 <= 25 THEN '0-25ms' WHEN ns // 1000000 <= 50 THEN '25-50ms' WHEN ns // 1000000 <= 100 THEN '50-100ms' ELSE '100ms+' END AS bucket FROM ev) SELECT bucket, count(b.bucket) AS searches, round(count(b.bucket) * 100.0 / (SELECT count(*) FROM ev), 6)::DOUBLE AS percent FROM (VALUES ('0-25ms'), ('25-50ms'), ('50-100ms'), ('100ms+')) n(bucket) LEFT JOIN b USING (bucket) GROUP BY bucket",
)
def a12_response_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    events, _ = _events(spark, sf_dir)
    return analytics.distribution(events).withColumn("percent", F.round("percent", 6))


@query("a13_type_counts", f"WITH {_EVENTS} SELECT count(*) FILTER (search_type = 'exact_match') AS exact_match, count(*) FILTER (search_type = 'wildcard') AS wildcard, count(*) FILTER (search_type = 'fuzzy_search') AS fuzzy_search, count(*) FILTER (search_type = 'filtered') AS filtered FROM ev")
def a13_type_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.type_counts(_events(spark, sf_dir)[0])


@query("a1_retention", f"WITH {_EVENTS} SELECT index_name, query, ns AS response_time FROM ev ORDER BY ts DESC, index_name, query LIMIT 500")
def a1_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.retained(_events(spark, sf_dir)[0], 500).select("index_name", "query", "response_time")


# --- jobs --------------------------------------------------------------------------------

_JOBS = """jobs AS (SELECT CAST(o_orderkey AS VARCHAR) AS id, 'type' || o_orderpriority[1] AS type, CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'running' ELSE 'failed' END AS status, 'index' || CAST(o_custkey % 5 AS VARCHAR) AS index_name, o_orderdate AS started, o_orderdate + INTERVAL (o_orderkey % 600) SECOND AS completed FROM orders)"""


def _jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = _table(spark, sf_dir, "orders").withColumn("o_orderdate", F.col("o_orderdate").cast("timestamp"))
    return orders.select(
        F.col("o_orderkey").cast("string").alias("id"),
        F.concat(F.lit("type"), F.substring("o_orderpriority", 1, 1)).alias("type"),
        F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "O", "running").otherwise("failed").alias("status"),
        F.concat(F.lit("index"), (F.col("o_custkey") % 5).cast("string")).alias("index_name"),
        F.col("o_orderdate").alias("created_at"),
        F.col("o_orderdate").alias("started_at"),
        F.timestamp_micros(F.unix_micros("o_orderdate") + (F.col("o_orderkey") % 600) * 1_000_000).alias("completed_at"),
    )


@query(
    "j6_job_metrics",
    f"""WITH {_JOBS}, x AS (SELECT *, CASE WHEN status = 'completed' THEN epoch_us(completed) - epoch_us(started) END / 1000000.0 AS s FROM jobs)
SELECT count(*) AS created, count(*) FILTER (status = 'completed') AS completed, count(*) FILTER (status = 'failed') AS failed, round(coalesce(sum(s), 0), 6)::DOUBLE AS total_seconds, round(coalesce(avg(s), 0), 6)::DOUBLE AS average_seconds,
 round(CASE WHEN count(*) FILTER (status IN ('completed', 'failed')) = 0 THEN 1.0 ELSE (count(*) FILTER (status = 'completed')) / (count(*) FILTER (status IN ('completed', 'failed'))) END, 9)::DOUBLE AS success_rate, count(*) FILTER (status IN ('pending', 'running')) AS workload FROM x""",
)
def j6_job_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = jobstats.metrics(_jobs(spark, sf_dir))
    return found.withColumns({"total_seconds": F.round("total_seconds", 6), "average_seconds": F.round("average_seconds", 6), "success_rate": F.round("success_rate", 9)})


@query(
    "j7_average_by_type",
    f"WITH {_JOBS}, r AS (SELECT type, (epoch_us(completed) - epoch_us(started)) / 1000000.0 AS s, row_number() OVER (PARTITION BY type ORDER BY completed DESC, id) AS n FROM jobs WHERE status = 'completed') SELECT type, round(avg(s), 6)::DOUBLE AS average_seconds, count(*) AS jobs FROM r WHERE n <= 100 GROUP BY type",
)
def j7_average_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobstats.average_by_type(_jobs(spark, sf_dir)).withColumn("average_seconds", F.round("average_seconds", 6))


@query("j3_job_list", f"WITH {_JOBS} SELECT id, type FROM jobs WHERE index_name = 'index3' AND status = 'failed'")
def j3_job_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobstats.select_jobs(_jobs(spark, sf_dir), "index3", "failed").select("id", "type")


@query("j5_job_retention", f"WITH {_JOBS} SELECT id FROM jobs WHERE status = 'running' OR completed >= TIMESTAMP '1996-06-01' - INTERVAL 24 HOUR")
def j5_job_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobstats.retained(_jobs(spark, sf_dir), datetime(1996, 6, 1)).select("id")


@query("j6_job_counts", f"WITH {_JOBS} SELECT status, count(*) AS jobs FROM jobs GROUP BY status")
def j6_job_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobstats.counts(_jobs(spark, sf_dir), "status")


@query("s7_dictionary", f"WITH {_PART_TF} SELECT DISTINCT prefix AS term FROM pmap")
def s7_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dictionary(vocabulary(build_postings(_parts(spark, sf_dir), PARTS)), PARTS)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return q12_search_and(spark, sf_dir)
