"""Registered queries that run the engine itself: stored indexes, catalog, jobs,
settings and validation, with the DuckDB SQL that checks them.

Queries that tell what an operation answers return (step, outcome) rows: "ok", or the
error code that the public API gives.
"""

from __future__ import annotations

import json
import threading
import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from datetime import UTC, datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.engine import Engine
from lodestone.errors import LodestoneError
from lodestone.functions.frames import local_frame
from lodestone.functions.text import field_tokens, tokenize
from lodestone.jobs import JobManager
from lodestone.operators import analytics
from lodestone.operators.fuzzy import near_stored, near_terms
from lodestone.operators.index import ID, build_postings
from lodestone.plans.search import IndexTables, search, search_all
from lodestone.queries import _DOC_TOKENS, _EVENTS, _PART_TF, _PROBES, _TF, PARTS, Query, _docs, _events, _filtered, _fuzzy_sql, _leaf, _page, _parts, _table, _tokens
from lodestone.settings import IndexSettings, SearchQuery, needs_reindex, page_bounds, patch_settings, validate_name, validate_rename
from lodestone.sources.documents import from_records, parse_body, read_events_json, read_json, to_json_lines
from lodestone.sources.events import EventSink
from lodestone.sources.files import scratch_folder
from lodestone.sources.store import IndexStore, load_indexes, table_sizes

QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, oracle: str) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[name], ORACLE_SQL[name] = f, oracle
        return f

    return register


def _values(columns: str, *rows: str) -> str:
    return f"SELECT * FROM (VALUES {', '.join(rows)}) t({columns})"


def _steps(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    return local_frame(spark, [(s, str(o)) for s, o in rows], "step string, outcome string")


def _expect(**steps: str) -> str:
    return _values("step, outcome", *(f"('{s}', '{o}')" for s, o in steps.items()))


def _outcome(work: Callable) -> str:
    try:
        work()
    except LodestoneError as e:
        return e.code
    return "ok"


@contextmanager
def _engine(spark: SparkSession, **options) -> Iterator[Engine]:
    engine = Engine(spark, scratch_folder(spark, "engine"), **{"track": False, **options})
    try:
        yield engine
    finally:
        engine.close()


def _nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias(ID), F.col("n_name").alias("title"), F.col("n_regionkey").alias("region"))


_built: dict[tuple, IndexStore] = {}


def _stored(spark: SparkSession, sf_dir: str, name: str) -> IndexStore:
    """The index of ``part`` or ``documents`` on disk, built once a session."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _built or not _built[key].exists():
        parts = name == "part"
        store = IndexStore(spark, scratch_folder(spark, f"index-{name}"))
        store.create(PARTS if parts else IndexSettings("documents", ("text",), (), (), 4, 7, ("text",)))
        store.upsert(_parts(spark, sf_dir) if parts else _docs(spark, sf_dir))
        _built[key] = store
    return _built[key]


def _as_part(postings: DataFrame) -> DataFrame:
    return postings.select(F.col(ID).cast("long").alias("p_partkey"), "field", "term", "tf")


# --- storage -----------------------------------------------------------------------------


@query("k1_stored_postings", f"WITH {_PART_TF} SELECT p_partkey, field, term, tf FROM ptf")
def k1_stored_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Postings as written by the store and read back."""
    return _as_part(_stored(spark, sf_dir, "part").postings())


@query("s9_stored_documents", "SELECT lpad(CAST(p_partkey AS VARCHAR), 9, '0') AS \"documentID\", p_partkey, p_name, p_type, p_size FROM part")
def s9_stored_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stored(spark, sf_dir, "part").docs().select(ID, "p_partkey", "p_name", "p_type", "p_size")


@query("s8_loaded_index", f"WITH {_PART_TF} SELECT DISTINCT term, field FROM ptf")
def s8_loaded_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vocabulary of an index that a second engine found in the folder."""
    with _engine(spark) as engine:
        engine.create_index(IndexSettings(**{**PARTS.__dict__, "name": "part"}))
        engine.index("part").add(_parts(spark, sf_dir), wait=True)
        return load_indexes(spark, engine.data_dir)["part"].vocab()


@query("s11_catalog", "SELECT r_name AS name FROM region ORDER BY 1")
def s11_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Indexes of a folder, by name; a folder that names another is skipped."""
    with _engine(spark) as engine:
        for r in _table(spark, sf_dir, "region").collect():
            engine.create_index({"name": r["r_name"]})
        IndexStore(spark, f"{engine.data_dir}/misnamed").create(IndexSettings("other"))
        again = Engine(spark, engine.data_dir, track=False)
        again.close()
        return local_frame(spark, [(n,) for n in again.indexes()], "name string")


@query("k4_persisted", "SELECT CAST(n_nationkey AS VARCHAR) AS \"documentID\", n_name AS title FROM nation")
def k4_persisted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K4: four writes, merged into one segment by ``persist``, read by another engine."""
    with _engine(spark) as engine:
        engine.create_index({"name": "n", "searchable_fields": ["title"]})
        docs = _nations(spark, sf_dir)
        for r in range(4):
            engine.index("n").add(docs.where(F.col(ID).cast("int") % 4 == r), wait=True)
        engine.index("n").persist()
        store = load_indexes(spark, engine.data_dir)["n"]
        if len(store.manifest()["segments"]) != 1:
            raise AssertionError("segments were not merged")
        return store.docs().select(ID, "title")


@query("i4_stored_upsert", "SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN concat(p_name, ' second') WHEN p_size % 3 = 1 THEN concat(p_name, ' third') ELSE p_name END AS p_name FROM part")
def i4_stored_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """I4: of several rows of one document in a batch the last stays, and a later batch
    replaces an earlier one."""
    parts = _parts(spark, sf_dir).select(ID, "p_partkey", "p_name", "p_size")
    store = IndexStore(spark, scratch_folder(spark, "upsert"))
    store.create(IndexSettings("part", ("p_name",)))
    newer = parts.where("p_size % 3 = 0").withColumn("p_name", F.concat("p_name", F.lit(" second")))
    store.upsert(parts.union(newer))
    store.upsert(parts.where("p_size % 3 = 1").withColumn("p_name", F.concat("p_name", F.lit(" third"))))
    return store.docs().select("p_partkey", "p_name")


@query(
    "i7_concurrent_writes",
    f"WITH {_PART_TF} SELECT p_partkey, field, term, tf FROM ptf JOIN part USING (p_partkey) WHERE field = 'p_name' AND p_size % 10 <> 2",
)
def i7_concurrent_writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nine writers that add at once, and one that deletes what was there;
    no write is lost."""
    parts = _parts(spark, sf_dir).select(ID, "p_name", "p_size")
    store = IndexStore(spark, scratch_folder(spark, "writes"))
    store.create(IndexSettings("part", ("p_name",)))
    store.upsert(parts.where("p_size % 10 = 2"))
    jobs = [threading.Thread(target=store.upsert, args=(parts.where(f"p_size % 10 = {k}"),)) for k in (0, 1, 3, 4, 5, 6, 7, 8, 9)]
    jobs.append(threading.Thread(target=store.delete, args=(parts.where("p_size % 10 = 2"),)))
    for j in jobs:
        j.start()
    for j in jobs:
        j.join()
    return _as_part(store.postings())


@query("i9_bulk_progress", _values("step, total, message", "(0, 4, 'documents')", "(1, 4, 'postings')", "(2, 4, 'vocabulary')", "(3, 4, 'variants')", "(4, 4, 'searchable')"))
def i9_bulk_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a bulk load reports."""
    seen: list[tuple] = []
    store = IndexStore(spark, scratch_folder(spark, "bulk"))
    store.create(IndexSettings("nation", ("title",)))
    store.upsert(_nations(spark, sf_dir), progress=lambda *step: seen.append(step))
    return local_frame(spark, seen, "step int, total int, message string")


@query("i5_document_keys", "SELECT count(*) AS documents, count(DISTINCT doc_id) AS keys FROM documents WHERE text IS NOT NULL AND regexp_matches(lower(text), '[a-z0-9]')")
def i5_document_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documentID is the key of postings; there is no second numbering."""
    found = _stored(spark, sf_dir, "documents").postings().select(ID).distinct()
    return found.agg(F.count(F.lit(1)).alias("documents"), F.count_distinct(F.col(ID).cast("long")).alias("keys"))


@query("i11_stored_delete", f"WITH {_PART_TF} SELECT p_partkey, field, term, tf FROM ptf JOIN part USING (p_partkey) WHERE p_size % 4 <> 0 AND p_partkey <> 1")
def i11_stored_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By frame, and by a list that goes into the manifest."""
    store = IndexStore(spark, scratch_folder(spark, "delete"))
    store.create(PARTS)
    parts = _parts(spark, sf_dir)
    store.upsert(parts)
    store.delete(parts.where("p_size % 4 = 0"))
    store.delete(["000000001"])
    return _as_part(store.postings())


@query("i12_cleared", "SELECT p_partkey, concat(p_name, ' again') AS p_name FROM part WHERE p_size > 25")
def i12_cleared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents go; those that are written later stay."""
    parts = _parts(spark, sf_dir).select(ID, "p_partkey", "p_name", "p_size")
    store = IndexStore(spark, scratch_folder(spark, "clear"))
    store.create(IndexSettings("part", ("p_name",)))
    store.upsert(parts)
    store.clear()
    store.upsert(parts.where("p_size > 25").withColumn("p_name", F.concat("p_name", F.lit(" again"))))
    return store.docs().select("p_partkey", "p_name")


@query("i13_reindexed", f"WITH {_PART_TF} SELECT p_partkey, field, term, tf FROM ptf WHERE field = 'p_type'")
def i13_reindexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Other searchable fields; a frame from before still reads its files."""
    store = IndexStore(spark, scratch_folder(spark, "reindex"))
    store.create(IndexSettings("part", ("p_name",)))
    store.upsert(_parts(spark, sf_dir))
    before = store.postings()
    store.reindex(IndexSettings("part", ("p_type",)))
    if before.where("field != 'p_name'").count() or not before.count():
        raise AssertionError("a frame lost its snapshot")
    return _as_part(store.postings())


@query("i10_memory_bound", "SELECT true AS bounded")
def i10_memory_bound(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Memory needs no estimate, as a build holds no table on the driver."""
    plan = build_postings(_docs(spark, sf_dir), PARTS)._jdf.queryExecution().executedPlan().toString()
    return local_frame(spark, [("Broadcast" not in plan and "Python" not in plan,)], "bounded boolean")


@query("s6_stored_posting_list", f"WITH {_PART_TF} SELECT p_partkey, ptf.field, max(CASE WHEN ptf.field = 'p_name' THEN 1.0 ELSE tf END)::DOUBLE AS score FROM ptf JOIN pmap USING (field, term) WHERE prefix = 'w' GROUP BY ALL")
def s6_stored_posting_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.operators.index import lookup_term

    return lookup_term(_stored(spark, sf_dir, "part").postings(), PARTS, "w").select(F.col(ID).cast("long").alias("p_partkey"), "field", "score")


# --- sources and sinks -------------------------------------------------------------------


@query("s1_json_documents", "SELECT CAST(n_nationkey AS VARCHAR) AS \"documentID\", n_name AS title, CAST(n_regionkey AS BIGINT) AS region FROM nation")
def s1_json_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file that holds an array of objects."""
    path = scratch_folder(spark, "json")
    rows = _nations(spark, sf_dir)
    rows.agg(F.to_json(F.collect_list(F.struct(*rows.columns))).alias("value")).write.text(path)
    return read_json(spark, path).select(ID, "title", "region")


@query("v7_bound_body", "SELECT CAST(n_nationkey AS VARCHAR) AS \"documentID\", n_name AS title FROM nation")
def v7_bound_body(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Request bodies, one object each or an array, become documents in order."""
    rows = [r.asDict() for r in _nations(spark, sf_dir).select(ID, "title").collect()]
    bodies = [json.dumps(rows[0]), json.dumps(rows[1:])]
    return from_records(spark, [r for b in bodies for r in parse_body(b)]).select(ID, "title")


@query("v7_bad_bodies", _expect(object="ok", array="ok", empty_array="VALIDATION_FAILED", number="VALIDATION_FAILED", mixed="VALIDATION_FAILED", broken="VALIDATION_FAILED"))
def v7_bad_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    bodies = {"object": '{"a": 1}', "array": '[{"a": 1}, {}]', "empty_array": "[]", "number": "7", "mixed": '[{"a": 1}, 2]', "broken": "{"}
    return _steps(spark, [(k, _outcome(lambda b=b: parse_body(b))) for k, b in bodies.items()])


@query("k5_json_results", """SELECT concat('{"n_nationkey":', n_nationkey, ',"n_name":"', n_name, '","n_regionkey":', n_regionkey, '}') AS value FROM nation""")
def k5_json_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return to_json_lines(_table(spark, sf_dir, "nation"))


_SENT = datetime(2024, 1, 1, tzinfo=UTC)


def _sent(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    """Events of all customers, one by one through the sink, in small batches."""
    sink = EventSink(spark, scratch_folder(spark, "events"), batch=10_000, **options)
    rows = _table(spark, sf_dir, "nation").orderBy("n_nationkey").collect()
    for k, r in enumerate(rows):
        sink.add([("nation", r["n_name"], "exact_match", k * 1000, k, _SENT + timedelta(seconds=k))])
        if k % 5 == 4:
            sink.flush()
    sink.close()
    return sink.events()


@query("k3_event_sink", "SELECT n_name AS query, 'exact_match' AS search_type, n_nationkey * 1000::BIGINT AS response_time, n_nationkey AS result_count, TIMESTAMP '2024-01-01' + INTERVAL (n_nationkey) SECOND AS timestamp FROM nation")
def k3_event_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K3, A1: flushed in batches, merged once there are more than two files."""
    return _sent(spark, sf_dir, most_files=2).select("query", "search_type", "response_time", "result_count", "timestamp")


@query("a1_sink_retention", "SELECT n_name AS query FROM nation ORDER BY n_nationkey DESC LIMIT 7")
def a1_sink_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1: the sink keeps the latest events."""
    return _sent(spark, sf_dir, keep=7, most_files=2).select("query")


@query("s10_event_file", "SELECT n_name AS query, n_nationkey AS result_count FROM nation")
def s10_event_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A JSON array file of events."""
    path = scratch_folder(spark, "event-file")
    rows = _table(spark, sf_dir, "nation").select(F.lit("i").alias("index_name"), F.col("n_name").alias("query"), F.col("n_nationkey").alias("result_count"))
    rows.agg(F.to_json(F.collect_list(F.struct(*rows.columns))).alias("value")).write.text(path)
    return read_events_json(spark, path).select("query", "result_count")


# --- text --------------------------------------------------------------------------------


@query("t5_text_of_arrays", f"SELECT p_partkey, array_to_string({_tokens("concat(p_name, ' ', p_type)")}, ' ') AS tokens FROM part")
def t5_text_of_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T5: an array of strings is its elements joined by a blank; fields of other types
    have no text."""
    parts = _table(spark, sf_dir, "part").withColumn("tags", F.array("p_name", "p_type"))
    tokens = F.concat(field_tokens(parts, "tags"), field_tokens(parts, "p_size"), field_tokens(parts, "absent"))
    return parts.select("p_partkey", F.array_join(tokens, " ").alias("tokens"))


@query("t8_lower_case", f"SELECT p_partkey, array_to_string({_tokens('p_name')}, ' ') AS tokens FROM part")
def t8_lower_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A capital I with a dot becomes a plain i."""
    return _table(spark, sf_dir, "part").select("p_partkey", F.array_join(tokenize(F.translate("p_name", "i", "İ")), " ").alias("tokens"))


# --- filters and search ------------------------------------------------------------------


@query("f3_unknown_group", "SELECT o_orderkey, (CASE WHEN o_totalprice >= 300000 THEN 2.5 ELSE 0 END + CASE WHEN o_orderstatus = 'F' THEN 1.5 ELSE 0 END)::DOUBLE AS filter_score FROM orders WHERE o_totalprice >= 300000 OR o_orderstatus = 'F'")
def f3_unknown_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """taken as OR."""
    return _filtered(_table(spark, sf_dir, "orders"), {"operator": "XOR", "filters": [_leaf("o_totalprice", "_gte", 300000, 2.5), _leaf("o_orderstatus", "_exact", "F", 1.5)]}, ["o_orderkey"])


@query("f15_unknown_operator", "SELECT o_orderkey, 1.0::DOUBLE AS filter_score FROM orders WHERE o_orderstatus = 'P'")
def f15_unknown_operator(spark: SparkSession, sf_dir: str) -> DataFrame:
    """taken as equality."""
    return _filtered(_table(spark, sf_dir, "orders"), {"filters": [_leaf("o_orderstatus", "_like", "P", 1)]}, ["o_orderkey"])


@query(
    "q2_field_restriction",
    f"""WITH {_PART_TF}, hit AS (SELECT p_partkey, tf::DOUBLE AS score FROM ptf WHERE field = 'p_type' AND term = 'promo'),
ranked AS (SELECT *, row_number() OVER (ORDER BY score DESC, lpad(CAST(p_partkey AS VARCHAR), 9, '0')) AS rank, count(*) OVER () AS total FROM hit)
SELECT 0 AS qk, rank, total, score, 0 AS num_typos, 1 AS number_exact_words, p_partkey FROM ranked WHERE rank <= 10""",
)
def q2_field_restriction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q2, on a stored index: one field only."""
    return _page(search(_stored(spark, sf_dir, "part").tables(), [SearchQuery("promo", restrict_searchable_fields=("p_type",))]), ["p_partkey"])


@query("q2_unknown_field", _expect(known="ok", unknown="VALIDATION_FAILED"))
def q2_unknown_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = _stored(spark, sf_dir, "part").tables()
    return _steps(spark, [(k, _outcome(lambda f=f: search(tables, [SearchQuery("promo", restrict_searchable_fields=f)]))) for k, f in {"known": ("p_name",), "unknown": ("p_name", "p_size")}.items()])


def _typo_hits(word: str, where: str = "true") -> str:
    """Documents that match a word exactly, else by the best typo (one edit: the word
    is too short for two), with their rank."""
    from lodestone.queries import _OSA

    return f"""v AS (SELECT DISTINCT term FROM tf),
cand AS (SELECT term, {_OSA.format(a=f"'{word}'", b="term")} AS d FROM v WHERE abs(len(term) - {len(word)}) <= 2 AND levenshtein('{word}', term) <= 4 AND term <> '{word}'),
typo AS (SELECT doc_id, tf * 0.8 AS score, term, row_number() OVER (PARTITION BY doc_id ORDER BY term, tf DESC) AS n FROM tf JOIN cand USING (term) WHERE d <= 1 AND {where}),
hit AS (SELECT doc_id, score::DOUBLE AS score, 1 AS typos FROM typo WHERE n = 1 AND doc_id NOT IN (SELECT doc_id FROM tf WHERE term = '{word}') UNION ALL SELECT doc_id, tf::DOUBLE, 0 FROM tf WHERE term = '{word}'),
ranked AS (SELECT *, row_number() OVER (ORDER BY score DESC, CAST(doc_id AS VARCHAR)) AS rank, count(*) OVER () AS total FROM hit)
SELECT 0 AS qk, rank, total, round(score, 6) AS score, typos AS num_typos, 1 - typos AS number_exact_words, doc_id FROM ranked WHERE rank <= 100000"""


@query("q8_exact_before_typo", f"WITH {_TF}, {_typo_hits('than')}")
def q8_exact_before_typo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q8, Q11: a word that many documents hold exactly and others by a typo, all of
    them, on a stored index with its stored variants."""
    return _page(search(_stored(spark, sf_dir, "documents").tables(), [SearchQuery("than", page_size=100_000)]), ["doc_id"])


@query("q11_derived_union", f"WITH {_TF}, {_typo_hits('than')}")
def q11_derived_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q11: the same without a stored index."""
    settings = IndexSettings("documents", ("text",), (), (), 4, 7, ("text",))
    return _page(search(IndexTables.of(_docs(spark, sf_dir), settings), [SearchQuery("than", page_size=100_000)]), ["doc_id"])


@query(
    "q5_protected_token",
    f"""WITH {_TF}, hit AS (SELECT doc_id, tf::DOUBLE AS score FROM tf WHERE term = 'than'), ranked AS (SELECT *, row_number() OVER (ORDER BY score DESC, CAST(doc_id AS VARCHAR)) AS rank, count(*) OVER () AS total FROM hit)
SELECT 0 AS qk, rank, total, score, 0 AS num_typos, 1 AS number_exact_words, doc_id FROM ranked""",
)
def q5_protected_token(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q5: a protected query word has no typos, whatever its case. Every hit is listed."""
    tables = _stored(spark, sf_dir, "documents").tables()
    tables.settings = IndexSettings("documents", ("text",), (), (), 4, 7, ("text",), (), ("Than",))
    return _page(search_all(tables, [SearchQuery("THAN")]), ["doc_id"])


@query("q6_protected_candidate", f"WITH {_TF}, {_typo_hits('than', "term <> 'that' AND NOT (len(term) >= 3 AND starts_with('thank', term))")}")
def q6_protected_candidate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q6: no candidate is a protected word or, from three letters on, begins one."""
    tables = _stored(spark, sf_dir, "documents").tables()
    tables.settings = IndexSettings("documents", ("text",), (), (), 4, 7, ("text",), (), ("that", "thank"))
    return _page(search(tables, [SearchQuery("than", page_size=100_000)]), ["doc_id"])


@query("q7_stored_variants", _fuzzy_sql(2))
def q7_stored_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q7: tokens against the variants that an index stores."""
    return near_stored(list(_PROBES), _stored(spark, sf_dir, "documents").tables().variants, 2)


@query("q7a_nearest", f"SELECT token, term, distance FROM (SELECT *, row_number() OVER (PARTITION BY token ORDER BY distance, term) AS n FROM ({_fuzzy_sql(2)})) WHERE n <= 5")
def q7a_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The list variant, with a deterministic limit."""
    terms = _stored(spark, sf_dir, "documents").vocab().select("term")
    return near_terms(local_frame(spark, [(p,) for p in _PROBES], "token string"), terms, 2, limit=5)


@query("q7b_dictionary_refresh", _values("step, total", "('before', 0)", "('after adding', 1)", "('after deleting', 0)"))
def q7b_dictionary_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A typo search sees a word as soon as its document is written."""
    with _engine(spark) as engine:
        engine.create_index({"name": "n", "searchable_fields": ["title"]})
        index = engine.index("n")
        index.add(_nations(spark, sf_dir), wait=True)
        out = [("before", index.search("quixotc")["total"])]
        index.add([{ID: "q", "title": "Quixotic"}], wait=True)
        out.append(("after adding", index.search("quixotc")["total"]))
        index.delete("q", wait=True)
        out.append(("after deleting", index.search("quixotc")["total"]))
    return local_frame(spark, out, "step string, total int")


@query("q19_projection", _values("fields, columns", "('none', 'documentID,region,title')", "('title', 'documentID,title')", "('nope', 'documentID')"))
def q19_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    with _engine(spark) as engine:
        engine.create_index({"name": "n", "searchable_fields": ["title"]})
        engine.index("n").add(_nations(spark, sf_dir), wait=True)
        found = {k: engine.index("n").search({"query": "nation", "retrievable_fields": f})["hits"][0]["document"] for k, f in {"none": [], "title": ["title"], "nope": ["nope"]}.items()}
    return local_frame(spark, [(k, ",".join(sorted(d))) for k, d in found.items()], "fields string, columns string")


@query("q24_query_metadata", "SELECT 4 AS searches, 4 AS query_ids, true AS timed, 25 AS total")
def q24_query_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every result of single and multiple searches has its own id and time."""
    with _engine(spark) as engine:
        engine.create_index({"name": "n", "searchable_fields": ["title"]})
        index = engine.index("n")
        index.add(_nations(spark, sf_dir), wait=True)
        many = index.multi_search([{"name": "a", "query": "nation"}, {"name": "b", "query": "nation 1"}])
        found = [index.search("nation"), index.search("nation"), *many["results"].values()]
        timed = all(r["took_ms"] >= 0 for r in found) and many["processing_time_ms"] >= 0
        row = (len(found), len({r["query_id"] for r in found}), timed, index.stats()["document_count"])
    return local_frame(spark, [row], "searches int, query_ids int, timed boolean, total int")


# --- analytics ---------------------------------------------------------------------------


@query("a8_total_documents", "SELECT 'nation' AS index_name, count(*) AS documents FROM nation UNION ALL SELECT 'empty', 0")
def a8_total_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    stores = {}
    for name in ("nation", "empty"):
        stores[name] = IndexStore(spark, scratch_folder(spark, name))
        stores[name].create(IndexSettings(name, ("title",)))
    stores["nation"].upsert(_nations(spark, sf_dir))
    return table_sizes(stores, spark)


@query(
    "a17_dashboard",
    f"""WITH {_EVENTS}, day AS (SELECT ev.* FROM ev, span WHERE ts > now - INTERVAL 1 DAY), week AS (SELECT ev.* FROM ev, span WHERE ts > now - INTERVAL 7 DAY),
top AS (SELECT query, count(*) AS n FROM week WHERE query <> '' GROUP BY query ORDER BY n DESC, query LIMIT 1)
SELECT 'total_searches' AS metric, CAST(count(*) AS VARCHAR) AS value FROM day
UNION ALL SELECT 'avg_response_ms', CAST(coalesce(sum(ns) // nullif(count(*), 0) // 1000000, 0) AS VARCHAR) FROM day
UNION ALL SELECT 'total_documents', CAST(sum(n_nationkey) AS VARCHAR) FROM nation UNION ALL SELECT 'active_indexes', CAST(count(*) AS VARCHAR) FROM nation
UNION ALL SELECT 'hours', '24' UNION ALL SELECT 'searches_by_hour', CAST(count(*) AS VARCHAR) FROM day
UNION ALL SELECT 'most_popular', query FROM top UNION ALL SELECT 'wildcard', CAST(count(*) FILTER (search_type = 'wildcard') AS VARCHAR) FROM day
UNION ALL SELECT 'slow', CAST(count(*) FILTER (ns // 1000000 > 100) AS VARCHAR) FROM day
UNION ALL SELECT 'usage', CAST(count(*) AS VARCHAR) FROM week WHERE index_name IN (SELECT 'index' || CAST(n_nationkey AS VARCHAR) FROM nation)""",
)
def a17_dashboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole dashboard, as text."""
    events, now = _events(spark, sf_dir)
    indexes = _table(spark, sf_dir, "nation").select(F.concat(F.lit("index"), F.col("n_nationkey").cast("string")).alias("index_name"), F.col("n_nationkey").cast("long").alias("documents"))
    board = analytics.dashboard(events, indexes, now)
    rows = {
        **{k: board[k] for k in ("total_searches", "avg_response_ms", "total_documents", "active_indexes")},
        "hours": len(board["hourly"]),
        "searches_by_hour": sum(h["searches"] for h in board["hourly"]),
        "most_popular": board["popular_searches"][0]["query"],
        "wildcard": board["search_types"]["wildcard"],
        "slow": next(b["searches"] for b in board["response_times"] if b["bucket"] == "100ms+"),
        "usage": sum(u["searches"] for u in board["index_usage"]),
    }
    return local_frame(spark, [(k, str(v)) for k, v in rows.items()], "metric string, value string")


@query("a14_system_health", "SELECT true AS memory_is_percent, true AS others_unknown")
def a14_system_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Memory in percent; metrics without a source are null."""
    found = analytics.system_health(spark)
    return local_frame(spark, [(0 <= found["memory"] <= 100, all(found[k] is None for k in ("cpu", "disk", "index_health")))], "memory_is_percent boolean, others_unknown boolean")


@query("a15_placeholders", "SELECT 'documents_change' AS metric, true AS is_null UNION ALL SELECT 'indexes_change', true")
def a15_placeholders(spark: SparkSession, sf_dir: str) -> DataFrame:
    events, now = _events(spark, sf_dir)
    board = analytics.dashboard(events, spark.createDataFrame([], "index_name string, documents long"), now)
    return local_frame(spark, [(k, board[k] is None) for k in ("documents_change", "indexes_change")], "metric string, is_null boolean")


# --- catalog -----------------------------------------------------------------------------


@query("e1_create_index", _expect(new="ok", again="INDEX_ALREADY_EXISTS", blank="VALIDATION_FAILED", padded="VALIDATION_FAILED", bad_order="VALIDATION_FAILED", empty="0"))
def e1_create_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    with _engine(spark) as engine:
        tries = {"new": {"name": "a"}, "again": {"name": "a"}, "blank": {"name": "  "}, "padded": {"name": " a"}, "bad_order": {"name": "b", "ranking_criteria": [{"field": "x", "order": "up"}]}}
        rows = [(k, _outcome(lambda s=s: engine.create_index(s))) for k, s in tries.items()]
        rows.append(("empty", engine.index("a").stats()["document_count"]))
    return _steps(spark, rows)


@query("e2_delete_index", _expect(known="ok", again="INDEX_NOT_FOUND", left="b", on_disk="b"))
def e2_delete_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    with _engine(spark) as engine:
        for name in ("a", "b"):
            engine.create_index({"name": name})
        rows = [(k, _outcome(lambda: engine.delete_index("a"))) for k in ("known", "again")]
        rows += [("left", ",".join(engine.indexes())), ("on_disk", ",".join(load_indexes(spark, engine.data_dir)))]
    return _steps(spark, rows)


@query("e3_rename_index", "SELECT CAST(n_nationkey AS VARCHAR) AS \"documentID\", n_name AS title, 'countries' AS index_name FROM nation")
def e3_rename_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and settings move to the new name, on disk too."""
    with _engine(spark) as engine:
        engine.create_index({"name": "nations", "searchable_fields": ["title"]})
        engine.index("nations").add(_nations(spark, sf_dir), wait=True)
        engine.rename_index("nations", "countries")
        store = load_indexes(spark, engine.data_dir)["countries"]
        return store.docs().select(ID, "title", F.lit(store.settings().name).alias("index_name"))


@query("v6_rename_rules", _expect(same="SAME_NAME", taken="INDEX_ALREADY_EXISTS", unknown="INDEX_NOT_FOUND", blank="VALIDATION_FAILED", padded="VALIDATION_FAILED", free="ok"))
def v6_rename_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    with _engine(spark) as engine:
        for name in ("a", "b"):
            engine.create_index({"name": name})
        tries = {"same": ("a", "a"), "taken": ("a", "b"), "unknown": ("x", "y"), "blank": ("a", " "), "padded": ("a", "c "), "free": ("a", "c")}
        rows = [(k, _outcome(lambda p=p: engine.rename_index(*p))) for k, p in tries.items()]
        if _outcome(lambda: validate_rename("a", "a")) != "VALIDATION_FAILED":
            raise AssertionError("a name may not stay")
    return _steps(spark, rows)


@query("e5_update_settings", _expect(kind="update_settings", threshold="6", order="asc", searchable="title", unknown="VALIDATION_FAILED", segments="1"))
def e5_update_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Settings that postings do not depend on are saved without a reindex."""
    with _engine(spark) as engine:
        engine.create_index({"name": "n", "searchable_fields": ["title"]})
        index = engine.index("n")
        index.add(_nations(spark, sf_dir), wait=True)
        before = [s["name"] for s in index.store.manifest()["segments"]]
        job = index.update_settings({"min_word_size_for_1_typo": 6, "min_word_size_for_2_typos": 9, "ranking_criteria": [{"field": "region", "order": "asc"}]}, wait=True)
        s = index.settings
        same = [x["name"] for x in index.store.manifest()["segments"]] == before
        rows = [("kind", engine.job(job).type), ("threshold", s.min_word_size_for_1_typo), ("order", s.ranking_criteria[0].order), ("searchable", ",".join(s.searchable_fields))]
        rows += [("unknown", _outcome(lambda: index.update_settings({"colour": 1}))), ("segments", len(before) if same else "changed")]
    return _steps(spark, rows)


@query("e6_settings_reindex", "SELECT 'update_settings_reindex' AS kind, (SELECT count(*) FROM nation) AS by_region, 0::BIGINT AS by_title")
def e6_settings_reindex(spark: SparkSession, sf_dir: str) -> DataFrame:
    with _engine(spark) as engine:
        engine.create_index({"name": "n", "searchable_fields": ["title"]})
        index = engine.index("n")
        index.add(_nations(spark, sf_dir).withColumn("region", F.concat(F.lit("area "), F.col("region").cast("string"))), wait=True)
        job = index.update_settings({"searchable_fields": ["region"]}, wait=True)
        row = (engine.job(job).type, index.search("area")["total"], index.search("nation")["total"])
    return local_frame(spark, [row], "kind string, by_region long, by_title long")


@query("e7_reindex_choice", _expect(searchable="True", order_only="False", prefix="False", typo="False", filterable="False", distinct="False"))
def e7_reindex_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = IndexSettings("x", ("a", "b"))
    changes = {
        "searchable": {"searchable_fields": ["a"]}, "order_only": {"searchable_fields": ["b", "a"]}, "prefix": {"fields_without_prefix_search": ["a"]},
        "typo": {"min_word_size_for_1_typo": 5}, "filterable": {"filterable_fields": ["c"]}, "distinct": {"distinct_field": "a"},
    }
    return _steps(spark, [(k, needs_reindex(old, patch_settings(old, p))) for k, p in changes.items()])


@query("e8_patch_merge", _expect(kept="a,b", replaced="c", cleared="", not_strings="x,", wrong_type="w", number="5", null_distinct="", no_known_key="VALIDATION_FAILED"))
def e8_patch_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = IndexSettings("x", ("a", "b"), ("w",), distinct_field="a")

    def patched(**p) -> IndexSettings:
        return patch_settings(old, p)

    rows = [
        ("kept", ",".join(patched(distinct_field="b").searchable_fields)),
        ("replaced", ",".join(patched(searchable_fields=["c"]).searchable_fields)),
        ("cleared", ",".join(patched(filterable_fields=None).filterable_fields)),
        ("not_strings", ",".join(patched(searchable_fields=["x", 7]).searchable_fields)),
        ("wrong_type", ",".join(patched(filterable_fields="z").filterable_fields)),
        ("number", patched(min_word_size_for_1_typo=5.0).min_word_size_for_1_typo),
        ("null_distinct", patched(distinct_field=None).distinct_field),
        ("no_known_key", _outcome(lambda: patched(colour=1))),
    ]
    return _steps(spark, rows)


@query("e9_stats", "SELECT 'n' AS name, count(*) AS documents, 'title' AS searchable, 'region' AS filterable, 4 AS one, 7 AS two FROM nation")
def e9_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    with _engine(spark) as engine:
        engine.create_index({"name": "n", "searchable_fields": ["title"], "filterable_fields": ["region"]})
        engine.index("n").add(_nations(spark, sf_dir), wait=True)
        s = engine.index("n").stats()
    typo = s["typo_settings"]
    row = (s["name"], s["document_count"], ",".join(s["searchable_fields"]), ",".join(s["filterable_fields"]), typo["min_word_size_for_1_typo"], typo["min_word_size_for_2_typos"])
    return local_frame(spark, [row], "name string, documents long, searchable string, filterable string, one int, two int")


@query("e10_async_jobs", _expect(add="completed", add_progress="100.0", bad_add="VALIDATION_FAILED", delete="completed", delete_missing="failed", left="24", clear="completed", empty="0"))
def e10_async_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs in the background, their progress and their results."""
    with _engine(spark) as engine:
        engine.create_index({"name": "n", "searchable_fields": ["title"]})
        index = engine.index("n")
        add = engine.wait(index.add(_nations(spark, sf_dir)))
        rows = [("add", add.status), ("add_progress", add.progress.percent), ("bad_add", _outcome(lambda: index.add([{"title": "no id"}])))]
        rows += [("delete", engine.wait(index.delete("3")).status), ("delete_missing", engine.wait(index.delete("3")).status), ("left", index.stats()["document_count"])]
        rows += [("clear", engine.wait(index.clear()).status), ("empty", index.stats()["document_count"])]
    return _steps(spark, rows)


@query("e10a_cancelled_add", _expect(status="cancelled", documents="0", pending="cancelled"))
def e10a_cancelled_add(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cancelled add leaves nothing behind; one that waits never starts."""
    store = IndexStore(spark, scratch_folder(spark, "cancel"))
    store.create(IndexSettings("n", ("title",)))
    jobs = JobManager(1)
    first, second = jobs.create("add_documents", "n"), jobs.create("add_documents", "n")
    held = threading.Event()

    def add(progress) -> None:
        def step(*s) -> None:
            held.wait(60)
            progress(*s)

        store.upsert(_nations(spark, sf_dir), progress=step)

    jobs.run(first, add, spark)
    jobs.run(second, add, spark)
    jobs.cancel(second)
    while jobs.get(first).status == "pending":
        time.sleep(0.01)
    jobs.cancel(first)
    held.set()
    rows = [("status", jobs.wait(first).status), ("documents", store.docs().count()), ("pending", jobs.wait(second).status)]
    jobs.stop()
    return _steps(spark, rows)


@query("e11_reindex_job", "SELECT 'reindex' AS kind, 'completed' AS status, 1 AS segments, (SELECT count(*) FROM nation) AS found")
def e11_reindex_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    with _engine(spark) as engine:
        engine.create_index({"name": "n", "searchable_fields": ["title"]})
        index = engine.index("n")
        docs = _nations(spark, sf_dir)
        for r in range(2):
            index.add(docs.where(F.col(ID).cast("int") % 2 == r), wait=True)
        job = engine.wait(index.reindex())
        row = (job.type, job.status, len(index.store.manifest()["segments"]), index.search("nation")["total"])
    return local_frame(spark, [row], "kind string, status string, segments int, found long")


# --- jobs --------------------------------------------------------------------------------


def _run_jobs(spark: SparkSession, sf_dir: str) -> JobManager:
    """A job for each nation: those of region 4 fail."""
    jobs = JobManager(4)
    for r in _table(spark, sf_dir, "nation").collect():
        job = jobs.create(f"type{r['n_regionkey']}", r["n_name"])

        def work(progress, r=r) -> None:
            progress(r["n_nationkey"], 25, "half way")
            if r["n_regionkey"] == 4:
                raise ValueError("region 4")

        jobs.run(job, work)
    for j in jobs.list():
        jobs.wait(j.id)
    return jobs


@query("j1_jobs_created", "SELECT n_name AS index_name, 'type' || CAST(n_regionkey AS VARCHAR) AS type, true AS own_id FROM nation")
def j1_jobs_created(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J1, J3."""
    jobs = _run_jobs(spark, sf_dir).list()
    ids = {j.id for j in jobs}
    return local_frame(spark, [(j.index_name, j.type, len(ids) == len(jobs)) for j in jobs], "index_name string, type string, own_id boolean")


@query("j2_jobs_executed", "SELECT n_name AS index_name, CASE WHEN n_regionkey = 4 THEN 'failed' ELSE 'completed' END AS status, CASE WHEN n_regionkey = 4 THEN 'region 4' ELSE '' END AS error, n_nationkey * 4.0::DOUBLE AS percent, true AS finished FROM nation")
def j2_jobs_executed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status, error text, progress and times of each job."""
    rows = [(j.index_name, j.status, j.error, j.progress.percent, j.started_at is not None and j.completed_at is not None and j.completed_at >= j.started_at) for j in _run_jobs(spark, sf_dir).list()]
    return local_frame(spark, rows, "index_name string, status string, error string, percent double, finished boolean")


@query("j12_accessors", "SELECT count(*) AS created, count(*) FILTER (n_regionkey <> 4) AS completed, count(*) FILTER (n_regionkey = 4) AS failed, round(count(*) FILTER (n_regionkey <> 4) / count(*), 9)::DOUBLE AS success_rate, 0::BIGINT AS workload FROM nation")
def j12_accessors(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _run_jobs(spark, sf_dir).metrics()
    row = (m["created"], m["completed"], m["failed"], round(m["success_rate"], 9), m["workload"])
    return local_frame(spark, [row], "created long, completed long, failed long, success_rate double, workload long")


@query("j11_stopped", _values("status, jobs", "('completed', 1)", "('cancelled', 3)"))
def j11_stopped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stop waits for the job that runs and cancels those that wait."""
    jobs, started, go = JobManager(1), threading.Event(), threading.Event()

    def work(_) -> None:
        started.set()
        go.wait(60)

    for _ in range(4):
        jobs.run(jobs.create("t", "i"), work)
    started.wait(60)
    threading.Timer(0.2, go.set).start()
    jobs.stop()
    counts: dict[str, int] = {}
    for j in jobs.list():
        counts[j.status] = counts.get(j.status, 0) + 1
    return local_frame(spark, list(counts.items()), "status string, jobs int")


# --- validation --------------------------------------------------------------------------

_NAMES = "CASE n_nationkey % 5 WHEN 0 THEN '' WHEN 1 THEN '   ' WHEN 2 THEN ' ' || n_name WHEN 3 THEN n_name || ' ' ELSE n_name END"
_NAME_RULE = f"SELECT n_nationkey, CASE WHEN trim({_NAMES}) <> '' AND trim({_NAMES}) = {_NAMES} THEN 'ok' ELSE 'VALIDATION_FAILED' END AS outcome FROM nation"


def _names(spark: SparkSession, sf_dir: str, check: Callable[[str], object]) -> DataFrame:
    rows = _table(spark, sf_dir, "nation").selectExpr("n_nationkey", f"{_NAMES} AS name").collect()
    return local_frame(spark, [(r["n_nationkey"], _outcome(lambda r=r: check(r["name"]))) for r in rows], "n_nationkey int, outcome string")


@query("v1_index_name", _NAME_RULE)
def v1_index_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _names(spark, sf_dir, validate_name)


@query("v2_document_id", _NAME_RULE)
def v2_document_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _names(spark, sf_dir, lambda name: validate_name(name, ID))


@query("v3_settings", _expect(good="0", no_name="1", duplicates="2", blanks="2", unknown_references="2", bad_ranking="2"))
def v3_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V3, V9: how many rules each of these settings breaks."""
    tries = {
        "good": {"name": "a", "searchable_fields": ["x", "y"], "fields_without_prefix_search": ["y"], "ranking_criteria": [{"field": "z", "order": "asc"}]},
        "no_name": {"searchable_fields": ["x"]},
        "duplicates": {"name": "a", "searchable_fields": ["x", "x"], "filterable_fields": ["z", "z"]},
        "blanks": {"name": "a", "filterable_fields": [" "], "non_typo_tolerant_words": [""]},
        "unknown_references": {"name": "a", "searchable_fields": ["x"], "fields_without_prefix_search": ["y"], "no_typo_tolerance_fields": ["z"]},
        "bad_ranking": {"name": "a", "ranking_criteria": [{"field": " ", "order": "up"}]},
    }
    return _steps(spark, [(k, len(IndexSettings.from_dict(s).problems())) for k, s in tries.items()])


@query("v5_pages", "SELECT CAST(p AS INTEGER) AS page, CAST(s AS INTEGER) AS size, CASE WHEN p > 0 THEN p ELSE 1 END::INTEGER AS real_page, least(CASE WHEN s > 0 THEN s ELSE 10 END, 100)::INTEGER AS real_size FROM range(-2, 4) a(p), (VALUES (-5), (0), (1), (10), (99), (100), (101), (5000)) b(s)")
def v5_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(p, s, *page_bounds(p, s, 100)) for p in range(-2, 4) for s in (-5, 0, 1, 10, 99, 100, 101, 5000)]
    return local_frame(spark, rows, "page int, size int, real_page int, real_size int")


@query("v8_defaults", "SELECT CAST(a AS INTEGER) AS one, CAST(b AS INTEGER) AS two, CASE WHEN a = 0 THEN 4 ELSE a END::INTEGER AS real_one, CASE WHEN CASE WHEN b = 0 THEN 7 ELSE b END >= CASE WHEN a = 0 THEN 4 ELSE a END THEN CASE WHEN b = 0 THEN 7 ELSE b END ELSE CASE WHEN a = 0 THEN 4 ELSE a END + 1 END::INTEGER AS real_two FROM range(0, 10) x(a), range(0, 10) y(b)")
def v8_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V8: missing thresholds get defaults; the second never undercuts the first."""
    rows = []
    for a in range(10):
        for b in range(10):
            s = IndexSettings("x", min_word_size_for_1_typo=a, min_word_size_for_2_typos=b).validated()
            rows.append((a, b, s.min_word_size_for_1_typo, s.min_word_size_for_2_typos))
    return local_frame(spark, rows, "one int, two int, real_one int, real_two int")


@query("v9_references", "SELECT n_name AS field, CASE WHEN n_regionkey = 0 THEN 'ok' ELSE 'VALIDATION_FAILED' END AS outcome FROM nation")
def v9_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V9: lists may name searchable fields only."""
    rows = _table(spark, sf_dir, "nation").collect()
    known = [r["n_name"] for r in rows if r["n_regionkey"] == 0]
    out = [(r["n_name"], _outcome(lambda r=r: IndexSettings.from_dict({"name": "x", "searchable_fields": known, "no_typo_tolerance_fields": [r["n_name"]]}).validated())) for r in rows]
    return local_frame(spark, out, "field string, outcome string")


@query("q7b_vocabulary_of_segments", f"WITH {_DOC_TOKENS} SELECT DISTINCT term, 'text' AS field FROM tok")
def q7b_vocabulary_of_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vocabulary of an index in several segments."""
    store = IndexStore(spark, scratch_folder(spark, "segments"))
    store.create(IndexSettings("documents", ("text",), fields_without_prefix_search=("text",)))
    docs = _docs(spark, sf_dir)
    for r in range(3):
        store.upsert(docs.where(F.col("doc_id") % 3 == r))
    return store.vocab().select("term", "field")
