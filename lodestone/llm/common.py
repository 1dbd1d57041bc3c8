"""Helpers that several corpus operators share."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ASCII_LOWER = "abcdefghijklmnopqrstuvwxyz"

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_own_dir: list[str] = []
_open: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    Where the setting is absent and the master is local, a temporary folder
    serves; on a cluster without the setting this raises, since a local folder
    would be invisible to the other machines.
    """
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not _own_dir:
        holder = tempfile.TemporaryDirectory(prefix="lodestone-")
        atexit.register(holder.cleanup)
        _own_dir.append(holder.name)
    return _own_dir[0]


def _sweep() -> None:
    for path, spark in list(_open.items()):
        try:
            delete_path(spark, path)
        except Exception:  # noqa: BLE001, S110 - the session has ended before the program
            pass


atexit.register(_sweep)


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder. What nobody deletes before, as it stands behind
    a result, goes at the end of the program."""
    path = f"{shared_dir(spark)}/lodestone-{label}-{uuid.uuid4().hex}"
    _open[path] = spark
    return path


def delete_path(spark: SparkSession, path: str) -> None:
    _open.pop(path, None)
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(conf).delete(target, True)


def result(df: DataFrame, label: str, *used: DataFrame) -> DataFrame:
    """Write an operator's result, then delete the tables that it was made of. The
    result's own files stay until ``release`` or the end of the program."""
    out = materialize(df, label)
    for x in used:
        release(x)
    return out


def materialize(df: DataFrame, label: str = "stage") -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    The lineage ends at replicated files, so a lost executor costs only the
    tasks that it ran; nothing is computed twice. The write's own shuffle files are
    removed at its end, which nothing can ask for again.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._lodestone_path = path  # type: ignore[attr-defined]
    return out


def release(df: DataFrame) -> None:
    """Delete the files behind a materialized frame that no later step reads."""
    path = getattr(df, "_lodestone_path", None)
    if path:
        delete_path(df.sparkSession, path)


def exchanged(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` with a partitioning that the planner cannot see. An aggregate joined on
    its own keys is not shuffled again, and a join can split a hot key only where both
    sides are shuffled for it; the aggregate is the smaller side, so this costs little."""
    return df.withColumns({k: F.greatest(k, k) for k in keys})


def row_tie(columns: list[str]) -> Column:
    """A number that depends on all of a row's columns, to choose among repeated rows."""
    return F.xxhash64(F.to_json(F.struct(*[F.col(f"`{c}`") for c in columns])))


def whole_row(df: DataFrame) -> Column:
    """All columns as one struct, so that none of their names can clash."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns])


def lower_ascii(col: Column) -> Column:
    """Lower-case A-Z only; every other character stays as it is."""
    return F.translate(col, ASCII_UPPER, ASCII_LOWER)


def utf8_length(col: Column) -> Column:
    return F.octet_length(col).cast("long")


def any_true(cols: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, cols)


# --- hashing of words and shingles over whole Arrow buffers -------------------------------

U64 = np.uint64
_BASE = U64(0x9E3779B97F4A7C15)
_M1 = U64(0xBF58476D1CE4E5B9)
_M2 = U64(0x94D049BB133111EB)
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finalizer."""
    x = x ^ (x >> U64(30))
    x = x * _M1
    x ^= x >> U64(27)
    x *= _M2
    x ^= x >> U64(31)
    return x


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "up" not in _powers or len(_powers["up"]) < n:
        size = max(n, 1 << 20)
        inverse = U64(pow(int(_BASE), -1, 1 << 64))
        up, down = np.full(size, _BASE, U64), np.full(size, inverse, U64)
        up[0] = down[0] = 1
        _powers["up"], _powers["down"] = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _powers["up"][:n], _powers["down"][:n]


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


def word_hashes(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the whitespace-separated words of concatenated documents.

    ``data`` holds the UTF-8 bytes, ``starts`` the documents' offsets with the
    end as last element. Returns the word hashes and each word's document.
    """
    n = len(data)
    if n == 0:
        return np.empty(0, U64), np.empty(0, np.int64)
    solid = ~_SPACE[data]
    edge = np.zeros(n + 1, bool)
    edge[starts] = True
    before = np.empty(n, bool)
    before[0], before[1:] = False, solid[:-1]
    first = np.flatnonzero(solid & (~before | edge[:-1]))
    after = np.empty(n, bool)
    after[-1], after[:-1] = False, solid[1:]
    last = np.flatnonzero(solid & (~after | edge[1:]))
    up, down = _power_tables(n + 1)
    total = np.empty(n + 1, U64)
    total[0] = 0
    np.cumsum((_FOLD[data].astype(U64) + U64(1)) * up[:n], out=total[1:])
    h = (total[last + 1] - total[first]) * down[first]
    h = mix(h + (last - first).astype(U64))
    return h, np.searchsorted(starts, first, side="right") - 1


def shingle_sets(data: np.ndarray, starts: np.ndarray, size: int) -> list[np.ndarray]:
    """Per document the sorted distinct hashes of its ``size``-word shingles.

    A document of fewer words has its whole sequence as one shingle; one
    without words has the empty set.
    """
    h, doc = word_hashes(data, starts)
    n_docs = len(starts) - 1
    words = np.bincount(doc, minlength=n_docs) if len(doc) else np.zeros(n_docs, np.int64)
    at = np.concatenate(([0], np.cumsum(words)))
    grams = np.empty(0, U64)
    if len(h) >= size:
        grams = h[: len(h) - size + 1].copy()
        for k in range(1, size):
            grams *= _BASE
            grams += h[k : len(h) - size + 1 + k]
        grams = mix(grams)
    out = []
    for d in range(n_docs):
        lo, hi = at[d], at[d + 1]
        if hi - lo >= size:
            out.append(np.unique(grams[lo : hi - size + 1]))
        elif hi > lo:
            short = np.full(1, hi - lo, U64)
            for k in range(lo, hi):
                short = mix(short * _BASE + h[k : k + 1])
            out.append(short)
        else:
            out.append(np.empty(0, U64))
    return out


def text_blocks(array, most_bytes: int = 1 << 20):
    """Split an Arrow string array into runs of whole documents of about
    ``most_bytes``; yields (first, end, data, starts). Nulls are empty."""
    import pyarrow as pa

    if array.type != pa.large_string():
        array = array.cast(pa.large_string())
    if array.null_count:
        array = array.fill_null("")
    n = len(array)
    if n == 0:
        return
    buffers = array.buffers()
    offsets = np.frombuffer(buffers[1], np.int64)[array.offset : array.offset + n + 1]
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None and buffers[2].size else np.empty(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most_bytes, side="right")) - 1)
        j = min(j, n)
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


# --- connected components ----------------------------------------------------------------


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """Components of an edge table (a, b) as (node, root), root the smallest node.

    Alternating large-star and small-star rounds; each is two pre-aggregated
    shuffles and a join, and the edge table is written to the shared folder, so
    no adjacency list and no component is ever held by one task or the driver.
    Nodes without an edge are absent.
    """
    spark = edges.sparkSession

    def star(e: DataFrame, large: bool) -> DataFrame:
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else e
        low = both.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low"))
        joined = both.join(exchanged(low, "a"), "a")
        if large:
            out = joined.where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b"))
        else:
            out = joined.select(F.col("b").alias("a"), F.col("low").alias("b")).union(low.select("a", F.col("low").alias("b")))
        return out.where("a != b").distinct()

    # every edge points from its larger to its smaller node
    current = materialize(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct(), "edges")
    state = None
    for _ in range(most_rounds):
        stepped = materialize(star(star(current, True), False), "edges")
        digest = stepped.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        release(current)
        current = stepped
        if digest == state:
            break
        state = digest
    else:
        raise RuntimeError("components did not settle")
    roots = current.select(F.col("b").alias("node")).distinct()
    out = current.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots.select("node", F.col("node").alias("root")))
    out._lodestone_path = current._lodestone_path  # type: ignore[attr-defined]
    return out


def with_schema(df: DataFrame, **extra: T.DataType) -> T.StructType:
    return T.StructType([*df.schema.fields, *(T.StructField(k, v) for k, v in extra.items())])
