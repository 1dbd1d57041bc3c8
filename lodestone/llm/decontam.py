"""Benchmark decontamination with a broadcast hash set of test n-grams.

Texts are lower-cased (A-Z) and cut into words; every ``n`` consecutive words of
a benchmark item are a window, an item of fewer words is one window. Windows of
both sides are hashed, document windows probe the hash set, and a hit counts
only if the words themselves agree. Everything runs as DataFrame functions.

A window row holds its place and its hash. The words of a window are put together
for those rows only that may be hits, so work grows with the length of a text:

* up to ``BROADCAST_WINDOWS`` distinct windows the whole window table is broadcast;
* up to ``BROADCAST_KEYS`` its hashes alone are, and what passes them meets the
  window table in a shuffle join;
* beyond, every document window does, with its own words.

In both shuffle joins a frequent window is split by the skew join.

Null and empty texts have no words and no hits; an empty benchmark hits nothing,
and an empty table has no rows. Repeated document rows are each judged; repeated
items count once; items with a null id are left out. ``contamination`` reads the
named columns only; ``decontaminate`` carries all others along, whatever their
names. Identifiers may be of any type that can be grouped, null included.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import lower_ascii, materialize

#: Up to so many distinct windows (about 200 bytes each) the set is broadcast.
BROADCAST_WINDOWS = 250_000
#: Up to so many of their hashes (about 24 bytes each) are broadcast instead.
BROADCAST_KEYS = 8_000_000
WORD_RUN = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SEPARATORS_ANY_CASE = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
NO_RANGES = "array<struct<start:int,end:int>>"


def words_of(text: Column) -> Column:
    """Words of a text, A-Z lower-cased; null has none."""
    return F.array_remove(F.split(lower_ascii(F.coalesce(text, F.lit(""))), SEPARATORS), "")


def _bound(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), 0)


def _window_keys(hashes: Column, length: int) -> Column:
    """Hash of every run of ``length`` word hashes, in order; the same value as the
    hash of the run as an array."""
    size = F.size(hashes)
    keys = F.transform(F.sequence(F.lit(0), size - length), lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(length)]))
    return F.when(size >= length, keys).otherwise(F.array().cast("array<bigint>"))


def benchmark_windows(benchmark: DataFrame, n: int = 8, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """Distinct windows: gram (words joined by a space), n_gram, key, items."""
    words = benchmark.select(F.col(id_col).cast("string").alias("item"), words_of(F.col(text_col)).alias("words"))
    words = words.withColumn("n_gram", F.least(F.lit(n), F.size("words"))).where("n_gram > 0 AND item IS NOT NULL")
    places = F.sequence(F.lit(1), F.size("words") - F.col("n_gram") + 1)
    grams = words.select("item", "n_gram", F.explode(F.transform(places, lambda i: F.array_join(F.slice("words", i, F.col("n_gram")), " "))).alias("gram"))
    keyed = grams.groupBy("gram", "n_gram").agg(F.sort_array(F.collect_set("item")).alias("items"))
    return keyed.withColumn("key", F.xxhash64(F.transform(F.split("gram", " "), lambda w: F.xxhash64(w))))


def _as_ranges(hits: Column) -> Column:
    """Sorted disjoint word ranges that cover the hits, in one walk over the words hit."""

    def runs(w: Column) -> Column:
        begins = F.filter(w, lambda p, i: (i == 0) | (F.get(w, i - 1) < p - 1))
        ends = F.filter(w, lambda p, i: (i == F.size(w) - 1) | (F.get(w, i + 1) > p + 1))
        return F.zip_with(begins, ends, lambda s, e: F.named_struct(F.lit("start"), s, F.lit("end"), e + 1))

    words = F.flatten(F.transform(hits, lambda h: F.sequence(h["start"], h["end"] - 1)))
    return F.when(F.size(hits) > 0, _bound(F.sort_array(F.array_distinct(words)), runs)).otherwise(F.array().cast(NO_RANGES))


def contamination(
    docs: DataFrame, benchmark: DataFrame, n: int = 8, id_col: str = "doc_id", text_col: str = "text", broadcast_windows: int = BROADCAST_WINDOWS, broadcast_keys: int = BROADCAST_KEYS
) -> DataFrame:
    """Per document row: the id column, text_key (hash of the text), n_words,
    spans (sorted disjoint {start, end} word ranges that are hit), n_hit and items
    (sorted distinct item ids as strings)."""
    windows = materialize(benchmark_windows(benchmark, n), "windows")
    shape = windows.agg(F.count(F.lit(1)).alias("n"), F.collect_set("n_gram").alias("lengths")).first()
    lengths = sorted(shape["lengths"])

    text = F.col(text_col)
    cut = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("text_key"), words_of(text).alias("words"))
    # place 0 stands for the row itself; then come the windows of each length
    own_row = F.array(F.lit(None).cast("bigint"))
    keys = _bound(F.transform("words", lambda w: F.xxhash64(w)), lambda h: F.concat(own_row, *(_window_keys(h, x) for x in lengths)))
    # the hashes are a column before they are exploded: exploding stays in generated
    # code then, where a row does not copy the words of its document
    rows = cut.withColumn("keys", keys).select("id", "text_key", "words", F.size("words").alias("n_words"), F.posexplode("keys").alias("at", "probe"))
    base, ahead, length = F.lit(None).cast("int"), F.lit(1), F.lit(None).cast("int")
    for x in lengths:
        base = F.when(F.col("at") >= ahead, ahead).otherwise(base)
        length = F.when(F.col("at") >= ahead, F.lit(x)).otherwise(length)
        ahead = ahead + F.greatest(F.lit(0), F.col("n_words") - (x - 1))
    placed = rows.select("id", "text_key", "words", "n_words", "at", "probe", (F.col("at") - base).alias("first"), length.alias("length"))
    gram = F.array_join(F.slice("words", F.col("first") + 1, F.col("length")), " ")
    own = (F.col("probe") == F.col("key")) & (F.col("length") == F.col("n_gram"))
    hit = F.when(F.col("at") > 0, F.struct(F.col("first").alias("start"), (F.col("first") + F.col("length")).alias("end"))).alias("span")
    columns = ["id", "text_key", "n_words", "at"]
    if shape["n"] <= broadcast_windows:
        met = placed.join(F.broadcast(windows), own & (gram == F.col("gram")), "left").where("at = 0 OR gram IS NOT NULL").select(*columns, hit, "items")
    else:
        probes = placed.where("at > 0")
        if shape["n"] <= broadcast_keys:
            probes = probes.join(F.broadcast(windows.select(F.col("key").alias("probe")).distinct()), "probe", "left_semi")
        probes = probes.select(*columns, "first", "length", "probe", gram.alias("words_there"))
        found = probes.join(windows, own & (F.col("words_there") == F.col("gram"))).select(*columns, hit, "items")
        alone = cut.select("id", "text_key", F.size("words").alias("n_words"), F.lit(0).alias("at"), F.lit(None).cast("struct<start:int,end:int>").alias("span"), F.lit(None).cast("array<string>").alias("items"))
        met = alone.unionByName(found)
    per_doc = met.groupBy("id", "text_key").agg(
        F.count_if(F.col("at") == 0).alias("copies"),
        F.max("n_words").alias("n_words"),
        F.collect_set("span").alias("hits"),
        F.sort_array(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
    )
    spans = per_doc.select("id", "text_key", "n_words", _as_ranges(F.col("hits")).alias("spans"), "items", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy"))
    n_hit = F.aggregate("spans", F.lit(0), lambda acc, s: acc + s["end"] - s["start"])
    return spans.select(F.col("id").alias(id_col), "text_key", "n_words", "spans", "items", n_hit.alias("n_hit"))


def cut_words(text: Column, spans: Column) -> Column:
    """A text without the words of ``spans`` and the separators after them."""
    # piece 0 is what stands before the first word, piece k + 1 is word k and what follows it
    words = F.array_remove(F.split(text, SEPARATORS_ANY_CASE), "")
    pieces = F.zip_with(F.concat(F.array(F.lit("")), words), F.split(text, WORD_RUN), lambda word, after: F.concat(word, after))
    zero = F.array(F.lit(0))
    begins = F.concat(zero, F.transform(spans, lambda s: s["end"] + 1))
    ends = lambda p: F.concat(F.transform(spans, lambda s: s["start"] + 1), F.array(F.size(p)))
    return _bound(pieces, lambda p: F.array_join(F.zip_with(begins, ends(p), lambda b, e: F.array_join(F.slice(p, b + 1, e - b), "")), ""))


def decontaminate(docs: DataFrame, benchmark: DataFrame, n: int = 8, remove: str = "documents", min_items: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents without what the benchmark covers, with all their columns.

    ``remove="documents"`` drops documents that hold windows of ``min_items`` or
    more items. ``remove="spans"`` keeps every document and cuts the hit words
    (and the separators after them) out of its text.
    """
    if remove not in ("documents", "spans"):
        raise ValueError("remove must be 'documents' or 'spans'")
    found = contamination(docs, benchmark, n, id_col, text_col).where(F.size("items") >= min_items)
    hit = found.groupBy(F.col(id_col).alias("id"), F.col("text_key").alias("key")).agg(F.any_value("spans").alias("spans"))
    # the input's columns go in one struct, so that no name of theirs can clash
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    keyed = docs.select(whole.alias("row"), F.col(id_col).alias("row_id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("row_key"))
    same = (F.col("row_key") == F.col("key")) & F.col("row_id").eqNullSafe(F.col("id"))
    if remove == "documents":
        return keyed.join(hit.select("id", "key"), same, "left_anti").select("row.*")
    met = keyed.join(hit, same, "left")
    text = F.col("row")[text_col]
    cut = F.when(F.col("spans").isNotNull(), cut_words(text, F.col("spans"))).otherwise(text)
    return met.select(*[cut.alias(c) if c == text_col else F.col("row")[c].alias(c) for c in docs.columns])
