"""Index storage.

An index is a folder of immutable segments and a versioned manifest that lists them
in order. A write adds a segment: its documents, postings, vocabulary and deletion
variants, or the identifiers that it takes out. A row counts while no later segment
holds or takes out its identifier, so an upsert costs its own batch, not the index.

Writers prepare segments side by side and commit one after the other: a commit
creates the next manifest version and is applied again to the newest state where
another writer came first, in this process or elsewhere. A segment whose settings
went out of date meanwhile is built again before it goes in.

Segments merge like a log: once there are more than ``COMPACT_AT``, the newest ones
merge until the next older is much larger. Merged segments stay on disk for
``KEEP_SECONDS``, for searches and lazy frames that still read them.

Postings are range-partitioned and sorted by (term, documentID), vocabulary and
variants by their first column: lookups by equality skip most row groups, and a
frequent term spreads over as many files as it needs.
"""

from __future__ import annotations

import logging
import time
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators.fuzzy import term_variants
from lodestone.operators.index import ID, build_postings, dictionary, last_version, vocabulary
from lodestone.plans.search import IndexTables
from lodestone.settings import IndexSettings, needs_reindex
from lodestone.sources.files import Files
from lodestone.sources.manifest import Conflict, Manifest

COMPACT_AT = 12
#: A segment joins a merge if it is at most so many times as large as what merges already.
MERGE_RATIO = 4
KEEP_SECONDS = 3600.0
ORPHAN_SECONDS = 86_400.0
#: A segment of up to so many postings is one sorted file of each kind.
ONE_FILE = 100_000
#: Up to so many identifiers a delete is a list in the manifest instead of a file.
INLINE_IDS = 1000
KINDS = {"docs": f"{ID} string", "postings": f"{ID} string, field string, term string, tf long", "vocab": "term string, field string", "variants": "variant string, term string"}
STEPS = ("documents", "postings", "vocabulary", "variants")

Progress = Callable[[int, int, str], None]


def _quiet(current: int, total: int, message: str = "") -> None:
    return None


def _names(segments: list[dict]) -> list[str]:
    return [s["name"] for s in segments]


class IndexStore:
    def __init__(self, spark: SparkSession, path: str, keep_seconds: float = KEEP_SECONDS) -> None:
        self.spark, self.path, self.files = spark, path.rstrip("/"), Files(spark, path)
        self.keep_seconds = keep_seconds
        self._manifest = Manifest(self.files, self.path)

    # --- manifest

    def exists(self) -> bool:
        return self._manifest.exists()

    def manifest(self) -> dict:
        return self._manifest.latest()[1]

    def settings(self) -> IndexSettings:
        return IndexSettings.from_dict(self.manifest()["settings"])

    def create(self, settings: IndexSettings) -> None:
        """Fails where the folder holds an index."""

        def first(state: dict) -> dict:
            if state:
                raise Conflict(f"{self.path} holds an index")
            return {"settings": settings.to_dict(), "segments": [], "retired": []}

        self._manifest.commit(first)

    def save_settings(self, settings: IndexSettings) -> None:
        """E5: settings that need no reindex."""

        def change(state: dict) -> dict:
            if needs_reindex(IndexSettings.from_dict(state["settings"]), settings):
                raise Conflict("these settings need a reindex")
            return {**state, "settings": settings.to_dict()}

        self._manifest.commit(change)

    # --- reading

    def _part(self, segment: dict, kind: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{segment['name']}/{kind}")

    def _taken(self, segment: dict) -> list[DataFrame]:
        """The identifiers that a segment takes out of earlier ones."""
        out = []
        if segment.get("rows"):
            out.append(self._part(segment, "docs").select(ID))
        if segment.get("gone"):
            out.append(self._part(segment, "gone").select(ID))
        if segment.get("ids"):
            out.append(self.spark.createDataFrame([(i,) for i in segment["ids"]], f"{ID} string"))
        return out

    def _alive(self, segments: list[dict], kind: str) -> DataFrame:
        """Rows of ``segments`` that none of the later ones takes out: one union and
        one anti-join, however many segments there are."""
        held = [(k, s) for k, s in enumerate(segments) if s.get("rows")]
        if not held:
            return self.spark.createDataFrame([], KINDS[kind])
        parts = [self._part(s, kind).withColumn("_at", F.lit(k)) for k, s in held]
        rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
        taken = [t.withColumn("_gone", F.lit(k)) for k, s in enumerate(segments) if k > held[0][0] for t in self._taken(s)]
        if taken:
            last = reduce(DataFrame.unionByName, taken).groupBy(ID).agg(F.max("_gone").alias("_gone")).withColumnRenamed(ID, "_id")
            rows = rows.join(last, (F.col(ID) == F.col("_id")) & (F.col("_gone") > F.col("_at")), "left_anti")
        return rows.drop("_at")

    def docs(self) -> DataFrame:
        return self._alive(self.manifest()["segments"], "docs")

    def postings(self) -> DataFrame:
        return self._alive(self.manifest()["segments"], "postings")

    def _plain(self, segments: list[dict], kind: str) -> DataFrame:
        held = [self._part(s, kind) for s in segments if s.get("rows")]
        return reduce(DataFrame.unionByName, held) if held else self.spark.createDataFrame([], KINDS[kind])

    def vocab(self) -> DataFrame:
        """Distinct words of the segments. Words of taken-out documents may linger
        until their segments merge; they reach no posting."""
        return self._plain(self.manifest()["segments"], "vocab").distinct()

    def tables(self) -> IndexTables:
        """One snapshot. Stored variants serve while they cover the fields that have
        prefixes now; else they are derived from the vocabulary."""
        state = self.manifest()
        segments, settings = state["segments"], IndexSettings.from_dict(state["settings"])
        covered = all(set(settings.prefix_fields) <= set(s.get("wide", ())) for s in segments if s.get("rows"))
        variants = self._plain(segments, "variants") if covered else None
        return IndexTables(self._alive(segments, "docs"), self._alive(segments, "postings"), settings, self._plain(segments, "vocab"), variants)

    # --- writing

    def _write_segment(self, docs: DataFrame | None, gone: DataFrame | None, settings: IndexSettings, progress: Progress = _quiet) -> dict:
        name = f"segment-{uuid.uuid4().hex}"
        entry: dict = {"name": name, "rows": 0}
        if gone is not None:
            gone.select(ID).distinct().write.parquet(f"{self.path}/{name}/gone")
            entry["gone"] = True
        if docs is not None:
            progress(0, len(STEPS), STEPS[0])
            # a Bloom filter for each row group serves lookups by identifier
            docs.write.option(f"parquet.bloom.filter.enabled#{ID}", "true").option("parquet.bloom.filter.adaptive.enabled", "true").parquet(f"{self.path}/{name}/docs")
            entry["rows"] = self._part(entry, "docs").count()
            if entry["rows"]:
                self._write_postings(entry, settings, progress)
        return entry

    def _write_postings(self, entry: dict, settings: IndexSettings, progress: Progress) -> None:
        """Postings, vocabulary and variants of a segment's stored documents."""
        base = f"{self.path}/{entry['name']}"
        for kind in ("counts", "postings", "vocab", "variants"):
            self.files.delete(f"{base}/{kind}")
        progress(1, len(STEPS), STEPS[1])
        # counted once into files: finding range bounds, sorting and the vocabulary all read them
        build_postings(self._part(entry, "docs"), settings).write.parquet(f"{base}/counts")
        counts = self._part(entry, "counts")
        small = counts.count() <= ONE_FILE

        def sort(rows: DataFrame, *keys: str) -> DataFrame:
            dealt = rows.coalesce(1) if small else rows.repartitionByRange(*keys)
            return dealt.sortWithinPartitions(*keys)

        sort(counts, "term", ID).write.parquet(f"{base}/postings")
        progress(2, len(STEPS), STEPS[2])
        sort(vocabulary(counts), "term").write.parquet(f"{base}/vocab")
        progress(3, len(STEPS), STEPS[3])
        # a key becomes many variants: small keys are spread over all cores first
        keys = dictionary(self._part(entry, "vocab"), settings)
        keys = keys if small else keys.repartition(self.spark.sparkContext.defaultParallelism, "term")
        sort(term_variants(keys), "variant").write.parquet(f"{base}/variants")
        self.files.delete(f"{base}/counts")
        entry["wide"] = list(settings.prefix_fields)
        progress(len(STEPS), len(STEPS), "searchable")

    def _add(self, segment: dict, settings: IndexSettings, progress: Progress = _quiet) -> None:
        while True:

            def change(state: dict, built=settings) -> dict:
                if segment.get("rows") and needs_reindex(built, IndexSettings.from_dict(state["settings"])):
                    raise Conflict("searchable fields changed")
                return {**state, "segments": [*state["segments"], segment]}

            try:
                self._manifest.commit(change)
                break
            except Conflict:
                settings = self.settings()
                self._write_postings(segment, settings, progress)
        if len(self.manifest()["segments"]) > COMPACT_AT:
            self._merge_newest()

    def upsert(self, docs: DataFrame, order: str | None = None, progress: Progress = _quiet) -> None:
        """I4: replace documents by identifier; of several rows of one identifier that
        with the largest ``order`` stays, or without ``order`` the last in row order."""
        settings = self.settings()
        segment = self._write_segment(last_version(docs, F.col(order) if order else None), None, settings, progress)
        if segment["rows"]:
            self._add(segment, settings, progress)

    def delete(self, ids: DataFrame | list[str]) -> None:
        """Take documents out by identifier."""
        if isinstance(ids, list) and len(ids) <= INLINE_IDS:
            segment = {"name": f"segment-{uuid.uuid4().hex}", "rows": 0, "ids": ids}
        else:
            frame = ids if isinstance(ids, DataFrame) else self.spark.createDataFrame([(i,) for i in ids], f"{ID} string")
            segment = self._write_segment(None, frame, self.settings())
        self._add(segment, self.settings())

    def clear(self) -> None:
        """I12."""
        self._manifest.commit(lambda state: {**state, "segments": [], "retired": self._retire(state, state["segments"])})

    def reindex(self, settings: IndexSettings | None = None) -> None:
        """Rebuild the postings of all documents, under new settings if given.
        Segments that come in meanwhile are rebuilt before the new state is committed."""
        seen: list[str] = []
        built: list[dict] = []
        while True:
            state = self.manifest()
            now = settings or IndexSettings.from_dict(state["settings"])
            segments = state["segments"]
            if _names(segments[: len(seen)]) != seen:  # another writer merged what was read
                seen, built = [], []
            rest = segments[len(seen) :]
            if rest:
                built = [*built, self._merged(rest, bool(seen), now)]
                seen = _names(segments)

            def change(state: dict, new=now, seen=seen, built=built) -> dict:
                if _names(state["segments"]) != seen:
                    raise Conflict
                kept = [s for s in built if s["rows"] or s.get("gone")]
                return {**state, "settings": new.to_dict(), "segments": kept, "retired": self._retire(state, state["segments"])}

            try:
                self._manifest.commit(change)
                break
            except Conflict:
                continue
        self.vacuum()

    compact = reindex

    def _merged(self, segments: list[dict], below: bool, settings: IndexSettings) -> dict:
        """One segment in place of several; ``below``: others lie under them."""
        taken = [t for s in segments for t in self._taken(s)] if below else []
        gone = reduce(DataFrame.unionByName, taken) if taken else None
        docs = self._alive(segments, "docs") if any(s.get("rows") for s in segments) else None
        return self._write_segment(docs, gone, settings)

    def _merge_newest(self) -> None:
        state = self.manifest()
        segments, settings = state["segments"], IndexSettings.from_dict(state["settings"])
        start = max(0, len(segments) - 2)
        total = sum(s["rows"] for s in segments[start:])
        while start and segments[start - 1]["rows"] <= MERGE_RATIO * max(1, total):
            start -= 1
            total += segments[start]["rows"]
        part = segments[start:]
        new = self._merged(part, start > 0, settings)

        def change(state: dict) -> dict:
            now = state["segments"]
            if _names(now[start : start + len(part)]) != _names(part) or needs_reindex(settings, IndexSettings.from_dict(state["settings"])):
                raise Conflict
            kept = [new] if new["rows"] or new.get("gone") else []
            return {**state, "segments": [*now[:start], *kept, *now[start + len(part) :]], "retired": self._retire(state, part)}

        try:
            self._manifest.commit(change)
        except Conflict:  # another writer merged them
            self.files.delete(f"{self.path}/{new['name']}")
        self.vacuum()

    @staticmethod
    def _retire(state: dict, segments: list[dict]) -> list[dict]:
        return [*state.get("retired", []), *({"name": s["name"], "at": time.time()} for s in segments)]

    def vacuum(self, keep_seconds: float | None = None) -> None:
        """Delete segments that were replaced longer ago than ``keep_seconds``, and
        folders of writers that never committed."""
        keep = self.keep_seconds if keep_seconds is None else keep_seconds
        gone: list[str] = []

        def change(state: dict) -> dict:
            gone[:] = [r["name"] for r in state.get("retired", []) if r["at"] < time.time() - keep]
            return {**state, "retired": [r for r in state.get("retired", []) if r["name"] not in gone]}

        if any(r["at"] < time.time() - keep for r in self.manifest().get("retired", [])):
            self._manifest.commit(change)
        state = self.manifest()
        known = set(_names(state["segments"])) | {r["name"] for r in state.get("retired", [])}
        lost = [n for n in self.files.folders(self.path) if n.startswith("segment-") and n not in known and n not in gone]
        for name in [*gone, *(n for n in lost if self.files.age(f"{self.path}/{n}") > ORPHAN_SECONDS)]:
            self.files.delete(f"{self.path}/{name}")

    def remove(self) -> None:
        self.files.delete(self.path)


def load_indexes(spark: SparkSession, data_dir: str) -> dict[str, IndexStore]:
    """Every folder whose manifest names the folder itself; unreadable or
    misnamed ones are skipped with a warning."""
    out = {}
    for name in Files(spark, data_dir).folders(data_dir):
        store = IndexStore(spark, f"{data_dir.rstrip('/')}/{name}")
        try:
            if store.exists() and store.settings().name == name:
                out[name] = store
            elif store.exists():
                logging.getLogger(__name__).warning("index folder %s names another index; skipped", name)
        except Exception as e:  # noqa: BLE001
            logging.getLogger(__name__).warning("index folder %s is unreadable: %s", name, e)
    return out


def table_sizes(stores: dict[str, IndexStore], spark: SparkSession) -> DataFrame:
    """(index_name, documents)."""
    rows = [s.docs().select(F.lit(n).alias("index_name")).groupBy("index_name").agg(F.count(F.lit(1)).alias("documents")) for n, s in stores.items()]
    names = spark.createDataFrame([(n,) for n in stores], "index_name string")
    if not rows:
        return names.withColumn("documents", F.lit(0).cast("long"))
    return names.join(reduce(DataFrame.union, rows), "index_name", "left").select("index_name", F.coalesce("documents", F.lit(0)).cast("long").alias("documents"))
