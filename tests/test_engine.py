from datetime import UTC, datetime, timedelta

import pytest

from lodestone.engine import Engine
from lodestone.errors import DocumentNotFound, IndexExists, IndexNotFound, InvalidInput, JobNotFound, SameName
from lodestone.jobs import JobManager, Progress
from lodestone.operators import analytics
from lodestone.operators.index import ID
from lodestone.settings import IndexSettings, RankingCriterion, needs_reindex, page_bounds, patch_settings, validate_name
from lodestone.sources.documents import parse_body
from lodestone.streaming.ingest import stream_into_index, windowed_searches

SETTINGS = {"name": "tools", "searchable_fields": ["label", "makers"], "filterable_fields": ["made"], "ranking_criteria": [{"field": "weight", "order": "desc"}]}
DOCS = [
    {"documentID": " t1 ", "label": "Claw Hammer", "makers": ["Ana Ruiz"], "made": 1988, "weight": 0.9},
    {"documentID": "t2", "label": "Hammer Drill", "makers": ["Olu"], "made": 2011, "weight": 0.4},
]


@pytest.fixture
def engine(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "data"))
    yield e
    e.close()


def test_documents_and_search(engine, spark):
    engine.create_index(SETTINGS)
    index = engine.index("tools")
    assert index.search("hammer")["total"] == 0
    index.add(DOCS, wait=True)
    index.add('{"documentID": "t3", "label": "Sledge Hammer", "made": 1950, "weight": 0.1, "extra": "x"}', wait=True)
    found = index.search("hammer")
    assert [h["document"][ID] for h in found["hits"]] == ["t1", "t2", "t3"] and found["total"] == 3
    assert found["hits"][0]["field_matches"] == {"label": ["hammer"]}
    index.add([{"documentID": "t2", "label": "Mallet", "made": 2020, "weight": 1.0}], wait=True)
    assert index.search("hammer")["total"] == 2 and index.search("mallet")["total"] == 1 and index.search("malet")["total"] == 1
    assert index.documents(page_size=2)["pages"] == 2 and index.get("t2")["label"] == "Mallet"
    index.delete("t1", wait=True)
    with pytest.raises(DocumentNotFound):
        index.get("t1")
    with pytest.raises(RuntimeError):
        index.delete("t1", wait=True)
    projected = index.search({"query": "hammer", "retrievable_fields": ["label", "nope"]})["hits"][0]["document"]
    assert set(projected) == {ID, "label"}
    assert index.search({"query": "hammer", "page": 9})["total"] == 1
    many = index.multi_search([{"name": "x", "query": "hammer"}, {"name": "y", "query": "mallet", "filters": {"filters": [{"field": "made", "operator": "_lt", "value": 2000}]}}])
    assert {k: v["total"] for k, v in many["results"].items()} == {"x": 1, "y": 0} and many["total_queries"] == 2
    for bad in ([], [{"name": "x", "query": "a"}, {"name": "x", "query": "b"}], [{"name": " ", "query": "a"}]):
        with pytest.raises(InvalidInput):
            index.multi_search(bad)
    board = engine.analytics()
    assert len(board["hourly"]) == 24 and board["active_indexes"] == 1 and board["total_documents"] == 2 and board["popular_searches"]
    index.persist()
    again = Engine(spark, engine.data_dir, track=False).index("tools")
    assert again.search("hammer")["total"] == 1
    index.clear(wait=True)
    assert index.stats()["document_count"] == 0


def test_catalog(engine):
    engine.create_index(SETTINGS)
    with pytest.raises(IndexExists):
        engine.create_index(SETTINGS)
    with pytest.raises(InvalidInput):
        engine.create_index({"name": " "})
    with pytest.raises(IndexNotFound):
        engine.index("none")
    with pytest.raises(SameName):
        engine.rename_index("tools", "tools")
    engine.index("tools").add(DOCS, wait=True)
    engine.rename_index("tools", "kit")
    assert engine.indexes() == ["kit"] and engine.index("kit").settings.name == "kit"
    engine.index("kit").update_settings({"searchable_fields": ["label"], "min_word_size_for_1_typo": 5}, wait=True)
    assert engine.index("kit").search("ruiz")["total"] == 0 and engine.index("kit").stats()["typo_settings"]["min_word_size_for_1_typo"] == 5
    engine.delete_index("kit")
    assert engine.indexes() == [] and engine.health()["status"] == "ok"
    assert {j.type for j in engine.jobs("kit")} == {"update_settings_reindex", "delete_index"}
    metrics = engine.job_metrics()
    assert metrics["success_rate"] == 1.0 and metrics["workload"] == 0


def test_invalid_documents(engine):
    engine.create_index(SETTINGS)
    index = engine.index("tools")
    for body in ("[1]", "[]", "nope", '"x"'):
        with pytest.raises(InvalidInput):
            index.add(body)
    with pytest.raises(InvalidInput):
        index.add([{"documentID": "  ", "title": "x"}])
    with pytest.raises(InvalidInput):
        index.add([{"title": "x"}])
    assert parse_body('{"a": 1}') == [{"a": 1}]


def test_settings_rules():
    s = IndexSettings("x", ("a", "a"), fields_without_prefix_search=("z",), ranking_criteria=(RankingCriterion("f", "up"),))
    assert len(s.problems()) == 3
    assert IndexSettings("x", min_word_size_for_1_typo=5, min_word_size_for_2_typos=3).validated().min_word_size_for_2_typos == 6
    old = IndexSettings("x", ("a",), non_typo_tolerant_words=("w",))
    new = patch_settings(old, {"searchable_fields": ["a", 5], "non_typo_tolerant_words": None, "distinct_field": 7, "unknown": 1})
    assert new.searchable_fields == ("a", "") and new.non_typo_tolerant_words == () and new.distinct_field == ""
    with pytest.raises(InvalidInput):
        patch_settings(old, {"unknown": 1})
    assert needs_reindex(old, new) and not needs_reindex(old, patch_settings(old, {"distinct_field": "a"}))
    assert page_bounds(0, -1) == (1, 10) and page_bounds(3, 500, 100) == (3, 100)
    with pytest.raises(InvalidInput):
        validate_name(" x")
    assert IndexSettings.from_dict(__import__("json").loads(new.to_json())) == new


def test_jobs():
    jobs = JobManager(2)
    ok, bad = jobs.create("reindex", "i"), jobs.create("delete", "i")
    jobs.run(ok, lambda progress: progress(5, 10, "half"))
    jobs.run(bad, lambda progress: 1 / 0)
    assert jobs.wait(ok).status == "completed" and jobs.get(ok).progress.percent == 50.0
    assert jobs.wait(bad).status == "failed" and "division" in jobs.get(bad).error
    m = jobs.metrics()
    assert (m["created"], m["completed"], m["failed"], m["success_rate"]) == (2, 1, 1, 0.5)
    assert len(jobs.list("i", "failed")) == 1 and Progress().percent == 0.0
    with pytest.raises(JobNotFound):
        jobs.get("x")
    jobs.stop()


def test_empty_dashboard(spark):
    board = analytics.dashboard(spark.createDataFrame([], analytics.EVENT_SCHEMA), spark.createDataFrame([], "index_name string, documents long"), datetime(2024, 1, 1, tzinfo=UTC))
    assert board["total_searches"] == 0 and board["searches_change"] == 0.0 and board["avg_response_ms"] == 0 and board["response_trend"] == "stable"
    assert len(board["hourly"]) == 24 and all(b["percent"] == 0.0 for b in board["response_times"])


def test_streaming(engine, spark, tmp_path):
    engine.create_index({"name": "s", "searchable_fields": ["title"]})
    source = str(tmp_path / "in")
    spark.createDataFrame([("1", "alpha", 1), ("1", "beta", 2), ("2", "alpha", 1), (" ", "bad", 1)], "documentID string, title string, v int").write.parquet(source)
    store = engine.index("s").store
    stream = spark.readStream.schema("documentID string, title string, v int").parquet(source)
    stream_into_index(stream, store, str(tmp_path / "cp"), "v").awaitTermination()
    assert engine.index("s").search("beta")["total"] == 1 and engine.index("s").search("alpha")["total"] == 1

    start = datetime(2024, 1, 1, tzinfo=UTC)
    rows = [("i", "q", "wildcard", 5_000_000, 1, start + timedelta(minutes=m)) for m in (0, 10, 70)]
    spark.createDataFrame(rows, analytics.EVENT_SCHEMA).write.parquet(str(tmp_path / "ev"))
    events = spark.readStream.schema(analytics.EVENT_SCHEMA).parquet(str(tmp_path / "ev"))
    q = windowed_searches(events).writeStream.format("memory").queryName("hourly_searches").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r["searches"] for r in spark.table("hourly_searches").collect()) == [1, 2]
