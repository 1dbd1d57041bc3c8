"""Index storage under concurrent writers, and the event sink."""

import threading
from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lodestone.engine import Engine
from lodestone.operators.index import ID
from lodestone.plans.search import search
from lodestone.settings import IndexSettings, SearchQuery
from lodestone.sources import store as store_module
from lodestone.sources.events import EventSink
from lodestone.sources.files import Files
from lodestone.sources.manifest import Conflict, Manifest
from lodestone.sources.store import IndexStore

SETTINGS = IndexSettings("notes", ("title",), (), (), 4, 7, ("title",))


@pytest.fixture
def store(spark, tmp_path):
    s = IndexStore(spark, str(tmp_path / "notes"))
    s.create(SETTINGS)
    return s


def frame(spark, *rows):
    return spark.createDataFrame(rows, f"{ID} string, title string").coalesce(1)


def contents(store):
    return {r[ID]: r["title"] for r in store.docs().collect()}


def test_last_row_of_a_batch_stays(spark, store):
    store.upsert(frame(spark, ("x", "first"), ("y", "only"), ("x", "second")))
    assert contents(store) == {"x": "second", "y": "only"}
    ordered = spark.createDataFrame([("x", "new", 9), ("x", "old", 1), ("y", "none", None), ("y", "some", 3)], f"{ID} string, title string, v int")
    store.upsert(ordered, "v")
    assert contents(store) == {"x": "new", "y": "some"}


def test_concurrent_jobs_lose_nothing(spark, tmp_path):
    engine = Engine(spark, str(tmp_path / "data"), workers=8, track=False)
    engine.create_index(SETTINGS)
    index = engine.index("notes")
    index.add([{ID: f"old{k}", "title": "gone soon"} for k in range(6)], wait=True)
    jobs = [index.add([{ID: f"new{k}", "title": f"kept {k}"}]) for k in range(14)] + [index.delete(f"old{k}") for k in range(6)]
    done = [engine.wait(j) for j in jobs]
    assert [(j.status, j.error) for j in done] == [("completed", "")] * 20
    assert contents(index.store) == {f"new{k}": f"kept {k}" for k in range(14)}
    assert index.search("kept")["total"] == 14 and index.search("gone")["total"] == 0
    assert len(index.store.manifest()["segments"]) <= store_module.COMPACT_AT + 1  # deletes merge too
    engine.close()


def test_another_process_commits_in_between(spark, tmp_path):
    """The change is applied again to the newer state; nothing is overwritten."""
    folder = str(tmp_path / "state")
    ours, theirs = Manifest(Files(spark, folder), folder), Manifest(Files(spark, folder), f"{tmp_path}//state")
    seen = []

    def change(state):
        seen.append(dict(state))
        if len(seen) == 1:  # another writer, which does not share our lock
            theirs.commit(lambda s: {**s, "theirs": 1})
        return {**state, "ours": len(seen)}

    assert ours.commit(change) == {"theirs": 1, "ours": 2} and seen == [{}, {"theirs": 1}]
    assert ours.latest() == (2, {"theirs": 1, "ours": 2})
    files = Files(spark, folder)
    assert files.create_new(f"{folder}/a", "one") and not files.create_new(f"{folder}/a", "two") and files.read(f"{folder}/a") == "one"
    with pytest.raises(Conflict):
        ours.commit(lambda s: (_ for _ in ()).throw(Conflict()))


def test_upsert_meets_new_settings(spark, store):
    """A segment that was built under old settings is built again before it goes in."""
    docs = spark.createDataFrame([("a", "alpha", "beta")], f"{ID} string, title string, body string")
    store.upsert(docs)
    built = []

    def progress(step, total, message):
        if step == total and not built:
            built.append(message)
            other = IndexStore(spark, store.path)
            threading.Thread(target=other.reindex, args=(IndexSettings("notes", ("body",), (), (), 4, 7, ("body",)),)).run()

    store.upsert(docs.withColumn(ID, F.lit("b")), progress=progress)
    assert {(r[ID], r["field"], r["term"]) for r in store.postings().collect()} == {("a", "body", "beta"), ("b", "body", "beta")}


def test_readers_keep_their_snapshot(spark, store):
    store.upsert(frame(spark, ("a", "alpha"), ("b", "beta")))
    store.upsert(frame(spark, ("b", "gamma")))
    held, found = store.docs(), search(store.tables(), [SearchQuery("alpha")])
    store.reindex()
    store.upsert(frame(spark, ("a", "delta")))
    store.reindex()
    assert {r["title"] for r in held.collect()} == {"alpha", "gamma"} and found.count() == 1
    assert contents(store) == {"a": "delta", "b": "gamma"} and len(store.manifest()["segments"]) == 1
    kept = set(store.files.folders(store.path))
    store.vacuum(0)
    left = set(store.files.folders(store.path))
    assert left < kept and left == {s["name"] for s in store.manifest()["segments"]}
    assert contents(store) == {"a": "delta", "b": "gamma"}


def test_many_small_writes(spark, store, monkeypatch):
    monkeypatch.setattr(store_module, "COMPACT_AT", 3)
    expected = {}
    for k in range(7):
        store.upsert(frame(spark, (f"d{k % 4}", f"text {k}"), (f"e{k}", "same")))
        expected |= {f"d{k % 4}": f"text {k}", f"e{k}": "same"}
        if k % 3 == 2:
            store.delete([f"e{k}", "unknown"])
            del expected[f"e{k}"]
    assert contents(store) == expected and len(store.manifest()["segments"]) <= 4
    store.delete(store.docs().select(ID))
    assert contents(store) == {} and store.postings().count() == 0
    assert search(store.tables(), [SearchQuery("same")]).count() == 0


def test_prefix_settings_change_without_reindex(spark, store):
    """Stored variants do not cover prefixes then; they are derived."""
    store.upsert(frame(spark, ("a", "lighthouse"), ("b", "light")))
    store.save_settings(IndexSettings("notes", ("title",), (), (), 4, 7))
    assert store.tables().variants is None
    assert {r[ID] for r in search(store.tables(), [SearchQuery("ligth")]).collect()} == {"a", "b"}
    store.reindex()
    assert store.tables().variants is not None
    assert {r[ID] for r in search(store.tables(), [SearchQuery("ligth")]).collect()} == {"a", "b"}


def test_event_sink(spark, tmp_path):
    start = datetime(2024, 3, 1, tzinfo=UTC)
    sink = EventSink(spark, str(tmp_path / "events"), keep=400, batch=50, seconds=0.05, most_files=4)
    jobs = spark.sparkContext.statusTracker()
    before = len(jobs.getJobIdsForGroup(None))
    for k in range(1000):
        sink.add([("i", f"q{k}", "exact_match", k, 1, start + timedelta(seconds=k))])
    assert len(jobs.getJobIdsForGroup(None)) - before < 100  # the caller starts no job of its own
    sink.close()
    assert sorted(r["response_time"] for r in sink.events().collect()) == list(range(600, 1000))
    assert len(sink._manifest.latest()[1]["batches"]) <= 5
    other = EventSink(spark, str(tmp_path / "events"), keep=400)
    other.add([("i", "late", "exact_match", 1, 1, start + timedelta(days=1))])
    assert other.events().where("query = 'late'").count() == 1 and other.events().count() == 400
    other.close()
