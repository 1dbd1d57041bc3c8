"""Removal of repeated byte strings by suffix arrays.

A byte goes if a ``length``-byte string that covers it also starts anywhere else.

1. Anchors. Every window of ``length`` bytes picks the smallest hash among its
   ``GRAM``-byte grams (its minimizer, ties to the left). Consecutive windows with
   the same anchor form a region. Equal windows pick equal grams at equal places,
   so equal windows always share an anchor hash: their class.
2. Regions of classes with one occurrence only are dropped; equal regions of a
   class collapse to one with a repeat mark. Copies of a whole text are counted
   once by text digest, and a text with copies is repeated throughout.
3. Shards. The regions, in order of their class, are the text of the shards: every
   ``SHARD_BYTES`` of it, wherever a class may end, get a suffix array (Larsson-Sadakane
   refinement: only unsorted groups are sorted again, at twice the depth) and its
   common prefixes (Kasai's walk, many stretches of the text at once). Runs of
   suffixes that agree in ``length`` bytes and hold two window starts are repeated.
   A class that lies in several shards is merged across them: the sorted windows of
   each further shard are looked up in those merged so far, and the other way round,
   by binary search. This decides all classes of up to ``CLASS_REGIONS`` different
   regions, on their bytes.
4. Larger classes (a very frequent passage in ever new surroundings) are cut into runs
   of ``RUN`` windows at equal distances from the anchor. Runs that occur once and
   whose common core occurs once are dropped by hash; equal runs, and single windows of
   runs with a shared core, go to further shards with the smallest and the largest
   place of each, which must agree on their bytes there. Other places of such a run
   are told equal by its 128-bit hash.

All windows of a region overlap, so what its repeated windows cover is one range.
Every task streams; it holds the regions of ``HOLD_BYTES`` and one class, or one text.
Null texts are empty; texts under ``length`` bytes lose nothing. Repeated rows are
copies of each other. Identifiers may be of any type, null included. An empty table
gives no rows. Only the named columns are read, so other columns cannot clash. Region
identities are 128-bit hashes.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import _BASE, _M1, U64, _power_tables, exchanged, materialize, mix, release, result, text_blocks, utf8_length

LENGTH = 200
GRAM = 32
#: Text of one suffix array: small enough for the processor's cache.
SHARD_BYTES = 1 << 17
#: Text that a task gathers before it cuts it into shards.
HOLD_BYTES = 1 << 20
CLASS_REGIONS = 2048
RUN = 4
PIECE = 1 << 20
LANES = 16384


# --- regions -----------------------------------------------------------------------------


def regions_of(data: np.ndarray, starts: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """(document, first window, windows, anchor hash, region hash) of every region
    of the concatenated documents."""
    n, w = len(data), length - gram + 1
    none = tuple(np.empty(0, t) for t in (np.int64, np.int64, np.int64, U64, U64))
    if n < length:
        return none
    up, down = _power_tables(n + 1)
    total = np.empty(n + 1, U64)
    total[0] = 0
    np.cumsum((data.astype(U64) + U64(1)) * up[:n], out=total[1:])
    grams = mix((total[gram:] - total[:-gram]) * down[: n - gram + 1])
    key = (grams & U64(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=U64)
    blocks = -(-len(key) // w)
    padded = np.full(blocks * w, np.iinfo(U64).max, U64)
    padded[: len(key)] = key
    table = padded.reshape(blocks, w)
    ahead = np.minimum.accumulate(table, axis=1).ravel()
    behind = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].ravel()
    windows = n - length + 1
    anchor = np.minimum(behind[:windows], ahead[w - 1 : w - 1 + windows]) & U64(0xFFFFFFFF)
    valid = np.zeros(windows + 1, bool)
    for s, e in zip(starts[:-1], starts[1:], strict=True):
        if e - s >= length:
            valid[s : e - length + 1] = True
    valid = valid[:windows]
    new = valid.copy()
    new[1:] &= ~valid[:-1] | (anchor[1:] != anchor[:-1])
    first = np.flatnonzero(new)
    if not len(first):
        return none
    closing = valid.copy()
    closing[:-1] &= ~valid[1:] | (anchor[1:] != anchor[:-1])
    last = np.flatnonzero(closing)
    count = last - first + 1
    anchors = grams[anchor[first].astype(np.int64)]
    whole = mix((total[last + length] - total[first]) * down[first] + count.astype(U64) * _BASE)
    return np.searchsorted(starts, first, side="right") - 1, first, count, anchors, whole


def _regions(length: int, gram: int):
    def run(batches):
        import pyarrow as pa

        for b in batches:
            for i, _, data, starts in text_blocks(b.column(3)):
                pieces = [(0, data, starts)]
                if len(starts) == 2 and len(data) > 2 * PIECE:  # a very long text in overlapping pieces
                    pieces = [(o, p := data[o : o + PIECE + length - 1], np.array([0, len(p)])) for o in range(0, len(data) - length + 1, PIECE)]
                for shift, part, bounds in pieces:
                    doc, first, count, anchors, whole = regions_of(part, bounds, length, gram)
                    if not len(doc):
                        continue
                    rows = pa.array(doc + i)
                    at = (first - bounds[doc] + shift).astype(np.int64)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(anchors.view(np.int64)), pa.array(whole.view(np.int64)), b.column(0).take(rows), b.column(1).take(rows), b.column(2).take(rows), pa.array(at), pa.array(count.astype(np.int32))],
                        ["h", "rh", "t1", "t2", "owner", "at", "windows"],
                    )

    return run


# --- suffix arrays -----------------------------------------------------------------------


def packed(text: np.ndarray, pad: int) -> np.ndarray:
    """The eight bytes from each position as one big-endian number."""
    padded = np.zeros(len(text) + pad + 8, U64)
    padded[: len(text)] = text
    out = np.zeros(len(text) + pad, U64)
    for k in range(8):
        out = (out << U64(8)) | padded[k : k + len(out)]
    return out


def suffix_array(keys: np.ndarray, n: int) -> np.ndarray:
    """Suffixes of the first ``n`` positions in order, by Larsson-Sadakane
    refinement from eight-byte keys; a suffix that ends earlier comes first."""
    sa = np.argsort(keys[:n])
    ranked = keys[sa]
    first = np.ones(n, bool)
    first[1:] = ranked[1:] != ranked[:-1]
    group = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    rank = np.zeros(n + 1, np.int64)
    rank[sa] = group + 1  # 0 stands for the end
    h = 8
    open_at = np.flatnonzero(~(first & np.append(first[1:], True)))  # members of unsorted groups
    while len(open_at):
        pos = sa[open_at]
        own = rank[pos]
        pair = (own.astype(U64) << U64(32)) | rank[np.minimum(pos + h, n)].astype(U64)
        order = np.argsort(pair)
        pos, pair = pos[order], pair[order]
        sa[open_at] = pos
        new = np.ones(len(pos), bool)
        new[1:] = pair[1:] != pair[:-1]
        lead = np.maximum.accumulate(np.where(new, np.arange(len(pos)), 0))
        rank[pos] = open_at[lead] + 1
        open_at = open_at[~(new & np.append(new[1:], True))]
        h *= 2
    return sa


def common_prefixes(keys: np.ndarray, sa: np.ndarray, most: int) -> np.ndarray:
    """Kasai: per position the bytes shared with its predecessor in the suffix
    array, up to ``most``. The text is walked in ``LANES`` stretches at once, each
    carrying its own length from one position to the next."""
    n = len(sa)
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    out = np.zeros(n, np.int64)
    lanes = max(1, min(LANES, n // 64))
    step = -(-n // lanes)
    base = np.arange(lanes, dtype=np.int64) * step
    base = base[base < n]
    h = np.zeros(len(base), np.int64)
    for t in range(step):
        i = base + t
        if i[-1] >= n:
            base, h, i = base[:-1], h[:-1], i[:-1]
        if not len(base):
            break
        j = before[i]
        h = np.maximum(h - 1, 0)
        h[j < 0] = 0
        live = np.flatnonzero((j >= 0) & (h < most))
        while len(live):
            apart = keys[i[live] + h[live]] ^ keys[j[live] + h[live]]
            same = apart == 0
            stop = live[~same]
            if len(stop):
                rest = apart[~same]
                h[stop] += sum((rest >> U64(64 - 8 * k) == 0).astype(np.int64) for k in range(1, 8))
            live = live[same]
            h[live] += 8
            live = live[h[live] < most]
        out[i] = np.minimum(h, most)
    return out


def merge_shards(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which windows of two sorted shards occur in the other, by binary search."""
    if not len(a) or not len(b):
        return np.zeros(len(a), bool), np.zeros(len(b), bool)
    at = np.minimum(np.searchsorted(a, b), len(a) - 1)
    in_a = a[at] == b
    back = np.minimum(np.searchsorted(b, a), len(b) - 1)
    return b[back] == a, in_a


def merge_class(shards: list[tuple[np.ndarray, np.ndarray]], repeated: np.ndarray) -> None:
    """Mark in ``repeated`` the windows of one class that several of its shards hold.
    A shard is (windows in order, their numbers)."""
    held, numbers = shards[0]
    for windows, own in shards[1:]:
        in_b, in_a = merge_shards(held, windows)
        repeated[numbers[in_b]] = True
        repeated[own[in_a]] = True
        fresh = ~in_a
        at = np.searchsorted(held, windows[fresh])
        held, numbers = np.insert(held, at, windows[fresh]), np.insert(numbers, at, own[fresh])


def repeated_windows(texts: list[bytes], multi: list[bool], length: int, shard_bytes: int = SHARD_BYTES, classes: list[int] | None = None) -> list[np.ndarray]:
    """Per region, for each of its windows, whether it occurs twice or more in its
    class. Regions come in order of their class; without classes they are one."""
    classes = [0] * len(texts) if classes is None else classes
    shards: list[list[int]] = [[]]
    size = 0
    for k, t in enumerate(texts):
        if size and size + len(t) > shard_bytes:
            shards.append([])
            size = 0
        shards[-1].append(k)
        size += len(t)
    counts = [max(0, len(t) - length + 1) for t in texts]
    offsets = np.concatenate(([0], np.cumsum(counts)))
    repeated = np.zeros(offsets[-1], bool)
    ends = {classes[s[-1]] for s, after in zip(shards, shards[1:], strict=False) if classes[s[-1]] == classes[after[0]]}
    split: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {c: [] for c in ends}
    for shard in shards:
        if not shard:
            continue
        text = np.frombuffer(b"".join(texts[k] for k in shard), np.uint8)
        n = len(text)
        keys = packed(text, 2 * length + 16)
        sa = suffix_array(keys, n)
        shared = common_prefixes(keys, sa, length)
        weight = np.zeros(n, np.int64)
        number = np.full(n, -1, np.int64)
        at = 0
        spans: dict[int, tuple[int, int]] = {}
        for k in shard:
            weight[at : at + counts[k]] = 2 if multi[k] else 1
            number[at : at + counts[k]] = np.arange(offsets[k], offsets[k + 1])
            spans[classes[k]] = (spans.get(classes[k], (at, 0))[0], at + len(texts[k]))
            at += len(texts[k])
        # neighbours in order that agree in ``length`` bytes; equal windows are of one class
        run = np.cumsum(shared[sa] < length)
        often = np.bincount(run, weights=weight[sa]) >= 2
        found = sa[often[run]]
        repeated[number[found][number[found] >= 0]] = True
        for c, (start, end) in spans.items():
            if c in split:
                pos = sa[(sa >= start) & (sa < end)]
                pos = pos[number[pos] >= 0]
                windows = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(text, length)[pos]).view(f"S{length}").ravel()
                split[c].append((windows, number[pos]))
    for parts in split.values():
        merge_class(parts, repeated)
    return [repeated[offsets[k] : offsets[k + 1]] for k in range(len(texts))]


def _shard_runner(length: int, shard_bytes: int, hold_bytes: int = HOLD_BYTES):
    """(h, rh, multi, bytes) sorted by h to (h, rh, from, to): the covered range of
    each region with a repeated window. Classes come whole."""

    def run(batches):
        import pyarrow as pa

        def solve(rows):
            masks = repeated_windows([r[3] for r in rows], [r[2] for r in rows], length, shard_bytes, [r[0] for r in rows])
            kept = [(r[0], r[1], int(m.argmax()), len(m) - 1 - int(m[::-1].argmax()) + length) for r, m in zip(rows, masks, strict=True) if m.any()]
            return pa.RecordBatch.from_arrays([pa.array([k[c] for k in kept], t) for c, t in enumerate((pa.int64(), pa.int64(), pa.int32(), pa.int32()))], ["h", "rh", "from", "to"])

        held: list[tuple] = []
        size = 0
        for b in batches:
            for h, rh, multi, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3), strict=True):
                if size >= hold_bytes and held[-1][0] != h:
                    yield solve(held)
                    held, size = [], 0
                value = data.as_py()
                held.append((h, rh, multi, value))
                size += len(value)
        if held:
            yield solve(held)

    return run


def _cutter(length: int):
    """(text, picks of h, rh, at, windows, multi, kinds) to (h, rh, multi, kinds, bytes)."""

    def run(batches):
        import pyarrow as pa

        kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.binary()]
        names = ["h", "rh", "multi", "kinds", "bytes"]
        for b in batches:
            rows: list[tuple] = []
            size = 0
            for text, picks in zip(b.column(0), b.column(1), strict=True):
                data = text.as_buffer()
                for p in picks.as_py():
                    rows.append((p["h"], p["rh"], p["multi"], p["kinds"], data[p["at"] : p["at"] + p["windows"] + length - 1].to_pybytes()))
                    size += length
                if size > 8 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                    rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return run


def _hashes(total: np.ndarray, down: np.ndarray, start: np.ndarray, end: np.ndarray, tag: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each byte range and its tag."""
    plain = (total[end] - total[start]) * down[start]
    tag = tag.astype(U64)
    return mix(plain + tag * _M1).view(np.int64), mix(plain * _BASE + mix(tag + U64(1))).view(np.int64)


def _prefix(data) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    text = np.frombuffer(data, np.uint8)
    up, down = _power_tables(len(text) + 1)
    return text, np.concatenate((np.zeros(1, U64), np.cumsum((text.astype(U64) + U64(1)) * up[: len(text)]))), down


def _runs(length: int, gram: int):
    """(h, rh, multi, bytes) to rows of up to RUN windows: h, rh, first, last, multi,
    q1, q2 (hashes of the run's bytes) and c (hash of the bytes that all windows at
    these distances from the anchor share)."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            parts: list[tuple] = []
            for h, rh, multi, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3), strict=True):
                text, total, down = _prefix(data.as_py())
                n = len(text) - length + 1
                grams = mix((total[gram:] - total[:-gram]) * down[: len(text) - gram + 1]).view(np.int64)
                anchor = int((grams == h).argmax())
                number = np.arange((anchor - n + 1) // RUN, anchor // RUN + 1)
                near = anchor - RUN * number  # the window nearest to the anchor, and the farthest
                first, last = np.maximum(near - RUN + 1, 0), np.minimum(near, n - 1)
                q1, q2 = _hashes(total, down, first, last + length, (number * RUN + (last - first)) * RUN + (near - last))
                c, _ = _hashes(total, down, near, near - RUN + 1 + length, number)
                m = len(number)
                parts.append((np.full(m, h), np.full(m, rh), first.astype(np.int32), last.astype(np.int32), np.full(m, multi), q1, q2, c))
            if parts:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*parts, strict=True)], ["h", "rh", "first", "last", "multi", "q1", "q2", "c"])

    return run


def _singles(length: int):
    """(h, rh, first, last, multi, open, bytes of the run) to a row per window."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            rows: list[list] = [[] for _ in range(7)]
            for h, rh, at, last, multi, is_open, data in zip(*(b.column(k).to_pylist() for k in range(6)), b.column(6), strict=True):
                _, total, down = _prefix(data.as_py())
                start = np.arange(last - at + 1)
                w1, w2 = _hashes(total, down, start, start + length, np.zeros(len(start), np.int64))
                for col, v in zip(rows, ([h] * len(start), [rh] * len(start), (start + at).tolist(), [multi] * len(start), [is_open] * len(start), w1.tolist(), w2.tolist()), strict=True):
                    col.extend(v)
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.bool_(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds, strict=True)], ["h", "rh", "off", "multi", "open", "w1", "w2"])

    return run


def _remover(batches):
    """(id, text, ranges) to the removal result of each row."""
    import pyarrow as pa

    for b in batches:
        rows = []
        for text, found in zip(b.column(1), b.column(2), strict=True):
            data = text.as_buffer()
            n = data.size
            ranges = sorted((r["from"], r["to"]) for r in found.as_py() or ())
            merged: list[list[int]] = []
            for s, e in ranges:
                if merged and s <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], e)
                else:
                    merged.append([s, e])
            digest, at = hashlib.sha256(), 0
            for s, e in merged:
                digest.update(memoryview(data)[at:s])
                at = e
            digest.update(memoryview(data)[at:n])
            rows.append((n, sum(e - s for s, e in merged), len(merged), digest.hexdigest(), [x for s in merged for x in s]))
        cols = list(zip(*rows, strict=True)) or [()] * 5
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64())]
        yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])


def repeated_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text", class_regions: int = CLASS_REGIONS, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Per row: id column, n_bytes, n_removed, n_spans, kept_sha256 and spans (the
    removed byte ranges [from, to, ...])."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    slim = docs.select(F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(1), text).alias("t2"), F.xxhash64(F.col(id_col)).alias("owner"), text.alias("text"), F.col(id_col).alias("id"))
    id_type = dict(slim.dtypes)["id"]
    cut = slim.select("t1", "t2", "owner", "text").mapInArrow(_regions(length, gram), "h long, rh long, t1 long, t2 long, owner long, at long, windows int")
    occurrences = materialize(cut, "occurrences")

    # classes with two places or more; copies of a text are one place
    place = F.xxhash64("t1", "t2", "at")
    classes = occurrences.select("h", place.alias("place")).groupBy("h").agg(F.min("place").alias("low"), F.max("place").alias("high")).where("low != high").select("h")
    # the places are dealt anew for their grouping, so that the join can split a hot anchor
    shared = exchanged(occurrences.join(exchanged(classes, "h"), "h"), "h")
    often = shared.groupBy("h", "rh", "t1", "t2", "at", "windows").agg(F.min("owner").alias("owner"))
    often = materialize(often, "places")
    release(occurrences)

    # one text to cut each different region from
    regions = often.groupBy("h", "rh").agg(F.min(F.struct("t1", "t2", "at", "windows", "owner")).alias("rep"), F.count(F.lit(1)).alias("n"))
    regions = materialize(regions.select("h", "rh", (F.col("n") > 1).alias("multi"), "rep.*"), "regions")
    kinds = regions.groupBy("h").agg(F.count(F.lit(1)).alias("kinds"))
    picks = regions.join(exchanged(kinds, "h"), "h").groupBy("t1", "t2", "owner").agg(F.collect_list(F.struct("h", "rh", "at", "windows", "multi", "kinds")).alias("picks"))
    met = slim.select("t1", "t2", "owner", "text").join(picks, ["t1", "t2", "owner"]).dropDuplicates(["t1", "t2", "owner"])
    cut = materialize(met.select(F.col("text").cast("binary").alias("text"), "picks").mapInArrow(_cutter(length), "h long, rh long, multi boolean, kinds long, bytes binary"), "cut")
    release(regions)

    shards = cut.where(F.col("kinds") <= class_regions).select("h", "rh", "multi", "bytes").repartition("h").sortWithinPartitions("h")
    covered = "h long, rh long, `from` int, `to` int"
    found = shards.mapInArrow(_shard_runner(length, shard_bytes), covered)

    def proven(groups: DataFrame, one: str, two: str) -> DataFrame:
        """Of the hash groups those whose two places agree byte for byte."""
        places = groups.select(one, two, "multi", F.explode(F.array_distinct(F.array("low", "high"))).alias("p")).select(one, two, "multi", "p.*")
        texts = places.join(hot.select("h", "rh", "bytes"), ["h", "rh"]).select(F.col(one).alias("h"), F.col(two).alias("rh"), "multi", F.expr(f"substring(bytes, first + 1, last - first + {length})").alias("bytes"))
        return texts.repartition("h").sortWithinPartitions("h").mapInArrow(_shard_runner(length, shard_bytes), covered).select(F.col("h").alias(one), F.col("rh").alias(two)).distinct()

    # frequent anchors in many surroundings: run by run, then window by window
    hot = cut.where(F.col("kinds") > class_regions).select("h", "rh", "multi", "bytes")
    runs = materialize(hot.mapInArrow(_runs(length, gram), "h long, rh long, first int, last int, multi boolean, q1 long, q2 long, c long"), "runs")
    where = F.struct("h", "rh", "first", "last")
    groups = runs.groupBy("q1", "q2").agg(F.min(where).alias("low"), F.max(where).alias("high"), F.max("multi").alias("multi"), F.min("c").alias("c"))
    full = materialize(proven(groups.where("multi OR low != high"), "q1", "q2"), "full")
    run_found = runs.join(full, ["q1", "q2"]).select("h", "rh", F.col("first").alias("from"), (F.col("last") + length).alias("to"))
    # runs that are not repeated as a whole but share their core with another: with one
    # run of each repeated kind, as their windows may repeat there
    cores = groups.groupBy("c").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("c")
    kinds_of = groups.join(cores, "c", "left_semi").join(full.withColumn("whole", F.lit(True)), ["q1", "q2"], "left")
    pieces = kinds_of.select("low.*", "multi", F.col("whole").isNull().alias("open"))
    cut_pieces = pieces.join(hot.select("h", "rh", "bytes"), ["h", "rh"]).select("h", "rh", "first", "last", "multi", "open", F.expr(f"substring(bytes, first + 1, last - first + {length})").alias("bytes"))
    singles = materialize(cut_pieces.mapInArrow(_singles(length), "h long, rh long, off int, multi boolean, open boolean, w1 long, w2 long"), "singles")
    spot = F.struct("h", "rh", F.col("off").alias("first"), F.col("off").alias("last"))
    pairs = singles.groupBy("w1", "w2").agg(F.min(spot).alias("low"), F.max(spot).alias("high"), F.max("multi").alias("multi")).where("multi OR low != high")
    window_found = singles.where("open").join(proven(pairs, "w1", "w2"), ["w1", "w2"]).select("h", "rh", F.col("off").alias("from"), (F.col("off") + length).alias("to"))

    ranges = found.union(run_found).union(window_found).groupBy("h", "rh").agg(F.min("from").alias("from"), F.max("to").alias("to"))
    ranges = materialize(ranges, "ranges")
    for x in (cut, runs, full, singles):
        release(x)
    placed = often.select("h", "rh", "t1", "t2", "at").join(ranges, ["h", "rh"]).select("t1", "t2", (F.col("at") + F.col("from")).alias("from"), (F.col("at") + F.col("to")).alias("to"))
    copies = slim.select("t1", "t2", utf8_length(F.col("text")).alias("n")).groupBy("t1", "t2").agg(F.count(F.lit(1)).alias("copies"), F.max("n").alias("n")).where((F.col("copies") > 1) & (F.col("n") >= length)).select("t1", "t2", F.lit(0).cast("long").alias("from"), F.col("n").alias("to"))
    per_text = placed.union(copies).groupBy("t1", "t2").agg(F.collect_list(F.struct("from", "to")).alias("ranges"))
    per_text = materialize(per_text, "removals")
    release(often)
    release(ranges)
    out = slim.select("t1", "t2", "id", F.col("text").cast("binary").alias("text")).join(per_text, ["t1", "t2"], "left").select("id", "text", "ranges")
    spans = out.mapInArrow(_remover, f"id {id_type}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<bigint>").withColumnRenamed("id", id_col)
    return result(spans, "spans", per_text)
