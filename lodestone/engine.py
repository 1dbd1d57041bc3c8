"""The engine: a catalog of indexes with the operations of the public API (E1-E12,
J1-J12, Q23-Q25, A17, M9, M12-M14, M21, M22).

Reads return DataFrames or plain results; writes return a job id and run in the
background, or at once with ``wait=True``.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from datetime import UTC, datetime
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession

from lodestone.errors import DocumentNotFound, IndexExists, IndexNotFound, InvalidInput, SameName
from lodestone.functions.text import search_type_of
from lodestone.jobs import Job, JobManager
from lodestone.operators import analytics
from lodestone.operators.index import ID, clean_documents, find_document, list_documents
from lodestone.operators.rank import project
from lodestone.plans.search import fetch_documents, search, search_pages
from lodestone.settings import IndexSettings, SearchQuery, needs_reindex, page_bounds, patch_settings, validate_name, validate_rename
from lodestone.sources.documents import from_records, parse_body
from lodestone.sources.events import EventSink
from lodestone.sources.store import IndexStore, load_indexes, table_sizes

MAX_LIST_PAGE = 100
MULTI_SEARCH = "multi_search"


class Index:
    """One index (M22): its store, and searches over the current snapshot."""

    def __init__(self, engine: Engine, name: str, store: IndexStore) -> None:
        self.engine, self.name, self.store = engine, name, store

    @property
    def settings(self) -> IndexSettings:
        return self.store.settings()

    # --- documents

    def add(self, docs: DataFrame | list[dict] | str | bytes, wait: bool = False) -> str:
        """Upsert documents; any invalid one rejects the batch."""
        if isinstance(docs, str | bytes):
            docs = parse_body(docs)
        frame = from_records(self.engine.spark, docs) if isinstance(docs, list) else docs
        valid, rejected = clean_documents(frame)
        bad = [f"document {r['reason']}" for r in rejected.limit(20).collect()]
        if bad:
            raise InvalidInput(bad)

        return self.engine._job("add_documents", self.name, lambda progress: self.store.upsert(valid, progress=progress), wait)

    def delete(self, ident: str, wait: bool = False) -> str:
        """A missing document makes the job fail."""
        validate_name(ident, ID)

        def work(_: Callable) -> None:
            if find_document(self.store.docs(), ident).isEmpty():
                raise DocumentNotFound(ident)
            self.store.delete([ident])

        return self.engine._job("delete_document", self.name, work, wait)

    def clear(self, wait: bool = False) -> str:
        """I12, E10b."""
        return self.engine._job("delete_all_documents", self.name, lambda _: self.store.clear(), wait)

    def reindex(self, wait: bool = False) -> str:
        """I13, E11."""
        return self.engine._job("reindex", self.name, lambda _: self.store.reindex(), wait)

    def persist(self) -> None:
        """K1, K4: every write is durable; this merges the segments."""
        self.store.compact()

    def documents(self, page: int = 1, page_size: int = 10) -> dict[str, Any]:
        """S4, V5."""
        page, size = page_bounds(page, page_size, MAX_LIST_PAGE)
        rows, total = list_documents(self.store.docs(), page, size)
        return {"documents": rows, "total": total, "page": page, "page_size": size, "pages": -(-total // size)}

    def get(self, ident: str) -> Row:
        """S5."""
        found = find_document(self.store.docs(), validate_name(ident, ID)).collect()
        if not found:
            raise DocumentNotFound(ident)
        return found[0]

    def stats(self) -> dict[str, Any]:
        """E9."""
        s = self.settings
        return {
            "name": s.name,
            "document_count": self.store.docs().count(),
            "searchable_fields": list(s.searchable_fields),
            "filterable_fields": list(s.filterable_fields),
            "typo_settings": {"min_word_size_for_1_typo": s.min_word_size_for_1_typo, "min_word_size_for_2_typos": s.min_word_size_for_2_typos, "non_typo_tolerant_words": list(s.non_typo_tolerant_words)},
            "field_settings": {"fields_without_prefix_search": list(s.fields_without_prefix_search), "no_typo_tolerance_fields": list(s.no_typo_tolerance_fields), "distinct_field": s.distinct_field},
        }

    # --- settings

    def update_settings(self, patch: dict[str, Any], wait: bool = False) -> str:
        """Reindexes only where the searchable fields change."""
        old = self.settings
        new = patch_settings(old, patch).validated()
        if needs_reindex(old, new):
            return self.engine._job("update_settings_reindex", self.name, lambda _: self.store.reindex(new), wait)
        return self.engine._job("update_settings", self.name, lambda _: self.store.save_settings(new), wait)

    # --- search

    def search_frame(self, queries: list[SearchQuery]) -> DataFrame:
        return search(self.store.tables(), queries)

    def search(self, query: SearchQuery | dict | str, tag: str | None = None) -> dict[str, Any]:
        """Q1-Q22, Q24, Q25, A1: one search as a result object (M12, M13). A search can
        be stopped from another thread by ``Engine.cancel_searches`` with its tag."""
        q = SearchQuery(query) if isinstance(query, str) else SearchQuery.from_dict(query) if isinstance(query, dict) else query
        with self.engine._tagged(tag):
            return self._run([q], [""])[0]

    def multi_search(self, queries: list[SearchQuery | dict], page: int = 1, page_size: int = 10, tag: str | None = None) -> dict[str, Any]:
        """Named queries, one Spark plan; page and size are shared."""
        start = time.time()
        parsed = [SearchQuery.from_dict(q) if isinstance(q, dict) else q for q in queries]
        names = [q.name for q in parsed]
        if not parsed:
            raise InvalidInput("at least one query is required")
        if any(not n.strip() for n in names) or len(set(names)) < len(names):
            raise InvalidInput("query names must be unique and not blank")
        shared = [SearchQuery(**{**q.__dict__, "page": page, "page_size": page_size}) for q in parsed]
        with self.engine._tagged(tag):
            results = self._run(shared, names, MULTI_SEARCH)
        return {"results": dict(zip(names, results, strict=True)), "total_queries": len(parsed), "processing_time_ms": (time.time() - start) * 1000}

    def _run(self, queries: list[SearchQuery], names: list[str], kind: str | None = None) -> list[dict[str, Any]]:
        """Pages first, then the documents that are on them; both are bounded."""
        start = time.time()
        page, size = page_bounds(queries[0].page, queries[0].page_size)
        tables = self.store.tables()
        rows = search_pages(tables, queries).orderBy("qk", "rank").collect()  # at most one page a query
        shown = [set(project(tables.docs, q.retrievable_fields).columns) for q in queries]
        columns = [c for c in tables.docs.columns if any(c in s for s in shown)]
        ids = sorted({r[ID] for r in rows})
        found = {r[ID]: r for r in fetch_documents(tables, ids, columns).collect()} if ids else {}
        took = time.time() - start
        out = []
        for k, q in enumerate(queries):
            own = [r for r in rows if r["qk"] == k]
            hits = [
                {
                    "document": {c: found[r[ID]][c] for c in columns if c in shown[k]},
                    "field_matches": r["field_matches"],
                    "score": r["score"],
                    "hit_info": {"num_typos": r["num_typos"], "number_exact_words": r["number_exact_words"], "filter_score": r["filter_score"]},
                }
                for r in own
            ]
            # a page beyond the last has no row that tells the total
            total = own[0]["total"] if own else self._total(q) if page > 1 else 0
            out.append({"hits": hits, "total": total, "page": page, "page_size": size, "took_ms": int(took * 1000), "query_id": str(uuid.uuid4()), "name": names[k]})
        self.engine._track(self.name, queries, [r["total"] for r in out], took, kind)
        return out

    def _total(self, query: SearchQuery) -> int:
        first = search_pages(self.store.tables(), [SearchQuery(**{**query.__dict__, "page": 1, "page_size": 1})]).first()
        return first["total"] if first else 0


class Engine:
    """The catalog (M21) over a data folder, which may lie in any Hadoop file system."""

    def __init__(self, spark: SparkSession, data_dir: str, workers: int | None = None, track: bool = True) -> None:
        self.spark, self.data_dir, self.track = spark, data_dir.rstrip("/"), track
        self.jobs_manager = JobManager(workers)
        self.stores = load_indexes(spark, self.data_dir)
        self.sink = EventSink(spark, f"{self.data_dir}/.analytics/events")

    # --- jobs

    def _job(self, kind: str, index_name: str, work: Callable, wait: bool) -> str:
        job_id = self.jobs_manager.create(kind, index_name)
        self.jobs_manager.run(job_id, work, self.spark)
        if wait:
            job = self.jobs_manager.wait(job_id)
            if job.status == "failed":
                raise RuntimeError(job.error)
        return job_id

    def job(self, job_id: str) -> Job:
        return self.jobs_manager.get(job_id)

    def jobs(self, index_name: str, status: str | None = None) -> list[Job]:
        return self.jobs_manager.list(index_name, status)

    def job_metrics(self) -> dict:
        return self.jobs_manager.metrics()

    def wait(self, job_id: str, timeout: float | None = None) -> Job:
        return self.jobs_manager.wait(job_id, timeout)

    def cancel_job(self, job_id: str) -> None:
        """E10a."""
        self.jobs_manager.cancel(job_id, self.spark)

    @contextmanager
    def _tagged(self, tag: str | None) -> Iterator[None]:
        context = self.spark.sparkContext
        if tag:
            context.addJobTag(tag)
        try:
            yield
        finally:
            if tag:
                context.removeJobTag(tag)

    def cancel_searches(self, tag: str) -> None:
        """Q23: stop the searches that run under ``tag``; they raise."""
        self.spark.sparkContext.cancelJobsWithTag(tag)

    def close(self) -> None:
        self.jobs_manager.stop()
        self.sink.close()

    # --- catalog

    def create_index(self, settings: IndexSettings | dict[str, Any], wait: bool = True) -> str:
        """E1, V3."""
        s = (IndexSettings.from_dict(settings) if isinstance(settings, dict) else settings).validated()
        validate_name(s.name)
        if s.name in self.stores:
            raise IndexExists(s.name)
        store = IndexStore(self.spark, f"{self.data_dir}/{s.name}")
        self.stores[s.name] = store
        return self._job("create_index", s.name, lambda _: store.create(s), wait)

    def delete_index(self, name: str, wait: bool = True) -> str:
        """E2."""
        store = self.index(name).store
        del self.stores[name]
        return self._job("delete_index", name, lambda _: store.remove(), wait)

    def rename_index(self, old: str, new: str, wait: bool = True) -> str:
        """E3, V6."""
        store = self.index(old).store
        if old == new:
            raise SameName(old)
        validate_rename(old, new)
        if new in self.stores:
            raise IndexExists(new)

        def work(_: Callable) -> None:
            moved = IndexStore(self.spark, f"{self.data_dir}/{new}")
            store.save_settings(IndexSettings(**{**store.settings().__dict__, "name": new}))
            if not store.files.rename(store.path, moved.path):
                raise OSError(f"cannot rename {old} to {new}")
            self.stores[new] = moved
            self.stores.pop(old, None)

        return self._job("rename_index", old, work, wait)

    def indexes(self) -> list[str]:
        """S11, A16."""
        return sorted(self.stores)

    def index(self, name: str) -> Index:
        """E4."""
        if name not in self.stores:
            raise IndexNotFound(name)
        return Index(self, name, self.stores[name])

    # --- analytics

    def _track(self, index_name: str, queries: list[SearchQuery], totals: list[int], took: float, kind: str | None) -> None:
        """A1, Q25: one event a query, into the sink's buffer."""
        if self.track:
            now = datetime.now(UTC)
            self.sink.add([(index_name, q.query, kind or search_type_of(q.query, bool(q.filters)), int(took * 1e9), t, now) for q, t in zip(queries, totals, strict=True)])

    def events(self) -> DataFrame:
        """The latest 10 000 events, those in the buffer included."""
        return self.sink.events()

    def analytics(self, now: datetime | None = None) -> dict[str, Any]:
        """A17."""
        return analytics.dashboard(self.events(), table_sizes(self.stores, self.spark), now or datetime.now(UTC))

    def health(self) -> dict[str, Any]:
        return {"status": "ok", "indexes": len(self.stores)}
