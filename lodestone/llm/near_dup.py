"""Near-duplicate detection: banded MinHash with odd-sketch verification.

A document's set holds the hashes of its distinct k-word shingles. Equal sets
collapse to one node first, so a group of copies costs one row. ``SAMPLES``
MinHash values make the bands, and are folded into a parity bitmap (odd sketch)
whose XOR population count estimates high similarities.

1. Star rounds. A band bucket links its members to one lead, never all pairs: its
   smallest node at first, then a drawn member of its largest component for the
   members of other components. The sketch discards distant pairs, the full sets
   confirm the rest, and connected components follow each round.
2. Buckets that still hold several components compare the members of different
   components, so no link is lost to the stars. Members are classed by the size of
   their sets, which differ by one class at most where they are linked, and classes
   are cut into blocks of bounded members and bytes. Block against block, a finer
   sketch of ``FINE_SAMPLES`` values marks the members that have a close partner;
   only their sets are sent, once a block, and compared in the task. A block gives
   out members, and in the end links that join components: at most one row a member,
   never one a pair. Comparisons inside a block do grow with the square of a family
   whose members are near the threshold but unlinked.

Rows and band size are chosen so that a pair at the threshold is missed with
probability below ``MISS``; the fine sketch's margin is five standard deviations
below the threshold (stars may use a tighter one, as step 2 covers what they skip).
Confirmation compares whole sets of 64-bit shingle hashes.

Null texts and texts without words have the empty set and are linked with
nothing. Repeated rows are nodes of the same set. Null identifiers count only where a
component has no other; identifiers may be of any type that can be ordered. Empty
tables give empty results. Only the named columns are read, and ``near_dedup``
carries all others along, whatever their names.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import U64, connected_components, exchanged, materialize, mix, release, result, row_tie, shingle_sets, text_blocks, whole_row

SAMPLES = 128
SKETCH_BITS = 512
MISS = 1e-6
FINE_SAMPLES = 1024
FINE_BITS = 4096
#: Sketch estimates down to so far under the threshold go on to the full sets:
#: of a star, and of step 2.
STAR_MARGIN = 0.08
FINE_MARGIN = 0.07
STAR_ROUNDS = 3
#: Members of a bucket that one task compares with another block at a time, and the
#: bytes of their sets (a set beyond that is a block of its own).
BLOCK = 512
BLOCK_BYTES = 16 << 20

_FACTORS = mix(np.arange(1, FINE_SAMPLES + 1, dtype=U64) * U64(0xD1342543DE82EF95)) | U64(1)


def band_rows(percent: int) -> int:
    """The most rows a band can have so that a pair at the threshold is found."""
    s = percent / 100
    fit = [r for r in range(1, 9) if (1 - s**r) ** (SAMPLES // r) <= MISS]
    if not fit:
        raise ValueError("the threshold is too low for this many samples")
    return max(fit)


def minhash(values: np.ndarray, samples: int = SAMPLES) -> np.ndarray:
    best = np.full(samples, np.iinfo(U64).max, U64)
    for i in range(0, len(values), 512):
        np.minimum(best, np.multiply.outer(_FACTORS[:samples], values[i : i + 512]).min(axis=1), out=best)
    return best


def band_keys(samples: np.ndarray, rows: int) -> np.ndarray:
    bands = len(samples) // rows
    keys = np.arange(bands, dtype=U64) * U64(0x9E3779B97F4A7C15)
    for part in samples[: bands * rows].reshape(bands, rows).T:
        keys = mix(keys + part)
    return keys.view(np.int64)


def odd_sketch(samples: np.ndarray, bits: int = SKETCH_BITS) -> np.ndarray:
    """Parity of the samples' hits on each bit, as 64-bit words."""
    at = mix(samples + np.arange(len(samples), dtype=U64) * U64(0xBF58476D1CE4E5B9)) % U64(bits)
    parity = (np.bincount(at.astype(np.int64), minlength=bits) & 1).astype(np.uint8)
    return np.packbits(parity, bitorder="little").view(np.int64)


def most_odd_bits(percent: int, margin: float, samples: int = SAMPLES, bits: int = SKETCH_BITS) -> int:
    """XOR bits expected of a pair ``margin`` under the threshold."""
    apart = 1 - max(0.0, percent / 100 - margin)
    return math.ceil(bits / 2 * (1 - math.exp(-4 * samples * apart / bits)))


def _sketcher(size: int, rows: int):
    def run(batches):
        import pyarrow as pa

        for b in batches:
            for i, j, data, starts in text_blocks(b.column(2)):
                nodes, counts, bands, sketches = [], [], [], []
                for values in shingle_sets(data, starts, size):
                    counts.append(len(values))
                    if not len(values):
                        nodes.append(None), bands.append([]), sketches.append([])
                        continue
                    samples = minhash(values)
                    nodes.append(hashlib.blake2b(values.tobytes(), digest_size=16).digest())
                    bands.append(band_keys(samples, rows))
                    sketches.append(odd_sketch(samples))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(i, j - i), b.column(1).slice(i, j - i), pa.array(counts, pa.int64()), pa.array(nodes, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(sketches, pa.list_(pa.int64()))],
                    ["id", "text_key", "n_shingles", "node", "bands", "sketch"],
                )

    return run


def _keyed(size: int):
    """(text) to (node, text)."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            for i, j, data, starts in text_blocks(b.column(0)):
                nodes = [hashlib.blake2b(v.tobytes(), digest_size=16).digest() if len(v) else None for v in shingle_sets(data, starts, size)]
                yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.binary()), b.column(0).slice(i, j - i).cast(pa.string())], ["node", "text"])

    return run


def _confirm(size: int, percent: int):
    """(a, b, text_a, text_b) to the (a, b) whose sets reach the threshold."""

    def sets(column):
        return [v for *_, data, starts in text_blocks(column) for v in shingle_sets(data, starts, size)]

    def run(batches):
        import pyarrow as pa

        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                b = whole.slice(at, 256)
                once = b.column(0).dictionary_encode()
                where = once.indices.to_numpy()
                _, first = np.unique(where, return_index=True)
                left = sets(b.column(2).take(pa.array(first)))
                right = sets(b.column(3))
                keep = []
                for k, other in zip(where, right, strict=True):
                    own = left[k]
                    low, high = sorted((len(own), len(other)))
                    common = 0
                    if 100 * low >= percent * high:
                        common = len(own) + len(other) - len(np.unique(np.concatenate((own, other))))
                    keep.append(100 * common >= percent * (len(own) + len(other) - common))
                yield b.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return run


def _xor_bits(a: str, b: str) -> Column:
    words = SKETCH_BITS // 64
    return sum((F.bit_count(F.get(a, F.lit(k)).bitwiseXOR(F.get(b, F.lit(k)))) for k in range(words)), F.lit(0))


def _fine(size: int):
    """(node, text) to (node, fine sketch)."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            for i, j, data, starts in text_blocks(b.column(1)):
                fine = [odd_sketch(minhash(v, FINE_SAMPLES), FINE_BITS).tobytes() for v in shingle_sets(data, starts, size)]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array(fine, pa.binary())], ["node", "fine"])

    return run


def _groups(batches, keys: int):
    """Rows of sorted batches, as one list for each run of equal first ``keys`` columns."""
    held: list[tuple] = []
    for b in batches:
        for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if held and held[-1][:keys] != row[:keys]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


PLACE = "key long, cls int, cross int, i int, j int, side int, node binary, root binary, n long, bands array<bigint>"
KEYS = ["key", "cls", "cross", "i", "j"]


class _Block:
    """Members of one place: rows (key, cls, cross, i, j, side, node, root, n, bands, ...).

    In a block of its own both sides are the same rows, else side 0 meets side 1."""

    def __init__(self, rows: list[tuple]) -> None:
        self.key, _, cross, i, j = rows[0][:5]
        self.same = not cross and i == j
        self.left = [r for r in rows if r[5] == 0]
        self.right = self.left if self.same else [r for r in rows if r[5] == 1]
        number = {root: k for k, root in enumerate({r[7] for r in rows})}
        self.several = len(number) > 1 and bool(self.left) and bool(self.right)
        if self.several:
            sides = (self.left, self.right)
            self.roots = [np.array([number[r[7]] for r in x]) for x in sides]
            self.sizes = [np.array([r[8] for r in x], np.int64) for x in sides]
            self.bands = [np.array([r[9] for r in x], np.int64) for x in sides]

    def partners(self, x: int, percent: int) -> np.ndarray:
        """Right members of other components and of a fitting size whose first band
        shared with left member ``x`` is this one; of a pair in one block, the later."""
        n, other = self.sizes[0][x], self.sizes[1]
        fit = (self.roots[1] != self.roots[0][x]) & (100 * np.minimum(other, n) >= percent * np.maximum(other, n))
        if self.same:
            fit[: x + 1] = False
        at = np.flatnonzero(fit)
        shared = self.bands[1][at] == self.bands[0][x]
        return at[shared.any(axis=1) & (self.bands[0][x][shared.argmax(axis=1)] == self.key)]


def _mark(most: int, percent: int):
    """Members with their fine sketch to those that have a close partner in their block."""

    def run(batches):
        import pyarrow as pa

        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.list_(pa.int64())]
        names = [*KEYS, "side", "node", "root", "n", "bands"]
        for rows in _groups(batches, 5):
            block = _Block(rows)
            if not block.several:
                continue
            sides = (block.left, block.right)
            left, right = (np.frombuffer(b"".join(r[10] for r in x), U64).reshape(len(x), -1) for x in sides)
            close = [np.zeros(len(x), bool) for x in sides]
            if block.same:
                close[1] = close[0]
            for x in range(len(left)):
                at = block.partners(x, percent)
                if len(at):
                    near = at[np.bitwise_count(left[x] ^ right[at]).sum(axis=1, dtype=np.int64) <= most]
                    close[0][x] |= len(near) > 0
                    close[1][near] = True
            out = [r[:10] for side, marks in zip(sides[: 1 if block.same else 2], close, strict=False) for r, m in zip(side, marks, strict=True) if m]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

    return run


def _join_components(percent: int):
    """Members with their sets to links (a, b) whose sets reach the threshold, as many
    as it takes to join the components of a block."""

    def run(batches):
        import pyarrow as pa

        for rows in _groups(batches, 5):
            block = _Block(rows)
            if not block.several:
                continue
            sides = (block.left,) if block.same else (block.left, block.right)
            values = [np.frombuffer(r[10], U64) for x in sides for r in x]
            distinct, flat = np.unique(np.concatenate(values), return_inverse=True)
            cuts = np.cumsum([len(v) for v in values])
            sets = np.split(flat, cuts[:-1])
            left, right = sets[: len(block.left)], sets if block.same else sets[len(block.left) :]
            seen = np.zeros(len(distinct), bool)
            links = []
            for x, own in enumerate(left):
                at = block.partners(x, percent)
                if not len(at):
                    continue
                seen[own] = True
                sizes = block.sizes[1][at]
                common = np.add.reduceat(seen[np.concatenate([right[y] for y in at])].astype(np.int64), np.concatenate(([0], np.cumsum(sizes)[:-1])))
                seen[own] = False
                for y in at[100 * common >= percent * (len(own) + sizes - common)]:
                    old, new = block.roots[1][y], block.roots[0][x]
                    if old != new:
                        links.append(sorted((block.left[x][6], block.right[y][6])))
                        for roots in block.roots:
                            roots[roots == old] = new
            if links:
                yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in links], pa.binary()) for k in (0, 1)], ["a", "b"])

    return run


def _sets(size: int):
    """(node, text) to (node, the set's bytes)."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            for i, j, data, starts in text_blocks(b.column(1)):
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array([v.tobytes() for v in shingle_sets(data, starts, size)], pa.binary())], ["node", "values"])

    return run


def _placed(mixed: DataFrame, percent: int) -> DataFrame:
    """Members (key, node, root, n) in each block comparison that they take part in."""
    step = 100 / percent
    cls = F.floor(F.log(F.col("n")) / math.log(step)).cast("int") if step > 1 else F.col("n").cast("int")
    classed = mixed.withColumn("cls", cls)
    # sizes of a bucket's classes: a map of at most 80 entries, as classes are powers of the step
    counts = classed.groupBy("key", "cls").agg(F.count(F.lit(1)).alias("members"), F.max("n").alias("largest"))
    fit = F.greatest(F.lit(1), F.least(F.lit(BLOCK), F.floor(F.lit(BLOCK_BYTES) / (8 * F.col("largest")))))
    blocks = F.ceil(F.col("members") / fit).cast("int")
    sizes = counts.groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("cls", F.struct("members", blocks.alias("blocks"))))).alias("sizes"))
    met = classed.join(exchanged(sizes, "key"), "key")

    def blocks_of(c: Column) -> Column:
        return F.coalesce(F.col("sizes")[c]["blocks"], F.lit(0))

    none = F.array().cast("array<struct<cls:int,cross:int,i:int,j:int,side:int>>")

    def places(count: Column, make) -> Column:
        return F.when(count > 0, F.transform(F.sequence(F.lit(0), count - 1), make)).otherwise(none)

    def place(c: Column, cross: int, i: Column, j: Column, side: Column) -> Column:
        return F.named_struct(F.lit("cls"), c, F.lit("cross"), F.lit(cross), F.lit("i"), i, F.lit("j"), j, F.lit("side"), side)

    block, own = F.col("block"), F.col("cls")
    zero, one = F.lit(0), F.lit(1)
    met = met.withColumn("block", F.pmod(F.xxhash64("node"), blocks_of(own)).cast("int"))
    alone = F.col("sizes")[own]["members"] < 2
    same = places(F.when(alone, zero).otherwise(blocks_of(own)), lambda o: place(own, 0, F.least(block, o), F.greatest(block, o), (block > o).cast("int")))
    up = places(blocks_of(own + 1), lambda o: place(own, 1, block, o, zero))
    down = places(blocks_of(own - 1), lambda o: place(own - 1, 1, o, block, one))
    spread = met.select("key", "node", "root", "n", F.explode(F.concat(same, up, down)).alias("p"))
    return spread.select("key", "p.cls", "p.cross", "p.i", "p.j", "p.side", "node", "root", "n")


def _texts(used: DataFrame, docs: DataFrame, nodes: DataFrame, size: int) -> DataFrame:
    """One text (node, text) of each node in ``used``."""
    lows = nodes.join(used, "node", "left_semi").select("low").distinct()
    texts = docs.join(lows, docs["id"].eqNullSafe(lows["low"]), "left_semi").select("text").mapInArrow(_keyed(size), "node binary, text string")
    return materialize(texts.where("node IS NOT NULL").groupBy("node").agg(F.any_value("text").alias("text")), "texts")


def _links(pairs: DataFrame, docs: DataFrame, nodes: DataFrame, size: int, percent: int) -> DataFrame:
    """The (a, b) of ``pairs`` whose full sets reach the threshold."""
    pairs = materialize(pairs, "pairs")
    texts = _texts(pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct(), docs, nodes, size)
    met = pairs.join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b").join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")
    links = materialize(met.select("a", "b", "text_a", "text_b").mapInArrow(_confirm(size, percent), "a binary, b binary"), "links")
    release(texts)
    release(pairs)
    return links


def _merge(roots: DataFrame | None, links: DataFrame) -> DataFrame:
    """Roots (node, root) after joining the components of ``links``."""
    if roots is None:
        found = connected_components(links)
        merged = materialize(found, "roots")
        release(found)
        return merged

    def side(name: str) -> DataFrame:
        return roots.select(F.col("node").alias(name), F.col("root").alias(f"root_{name}"))

    lifted = links.join(side("a"), "a", "left").join(side("b"), "b", "left").select(F.coalesce("root_a", "a").alias("a"), F.coalesce("root_b", "b").alias("b"))
    found = connected_components(lifted)
    top = found.select(F.col("node").alias("old"), F.col("root").alias("top"))
    moved = roots.join(top, roots["root"] == top["old"], "left").select("node", F.coalesce("top", "root").alias("root"))
    fresh = found.join(roots, "node", "left_anti").select("node", "root")
    merged = materialize(moved.union(fresh), "roots")
    release(found)
    release(roots)
    return merged


def near_components(docs: DataFrame, shingle: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, text_key (hash of the text), n_shingles, node (digest of the
    set, null where empty), component (smallest digest of the component; ids may
    repeat, digests do not), component_id (smallest id of the component)."""
    rows = band_rows(percent)
    slim = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("text_key"), F.col(text_col).alias("text"))
    id_type = dict(slim.dtypes)["id"]
    sketched = materialize(slim.mapInArrow(_sketcher(shingle, rows), f"id {id_type}, text_key long, n_shingles long, node binary, bands array<bigint>, sketch array<bigint>"), "sketches")
    nodes = materialize(sketched.where("node IS NOT NULL").groupBy("node").agg(F.min("id").alias("low"), F.any_value("n_shingles").alias("n"), F.any_value("bands").alias("bands"), F.any_value("sketch").alias("sketch")), "nodes")
    source = slim.select("id", "text")

    # buckets with two members or more
    banded = nodes.select("node", F.explode("bands").alias("key"))
    leads = banded.groupBy("key").agg(F.min("node").alias("lead"), F.count(F.lit(1)).alias("members")).where("members > 1")
    buckets = materialize(banded.join(exchanged(leads, "key"), "key").select("key", "node", "lead"), "buckets")
    near = most_odd_bits(percent, STAR_MARGIN)
    sketch_a, sketch_b = nodes.select(F.col("node").alias("a"), F.col("sketch").alias("sketch_a")), nodes.select(F.col("node").alias("b"), F.col("sketch").alias("sketch_b"))
    roots, mixed = None, buckets
    for turn in range(STAR_ROUNDS):
        stars = mixed.where("node != lead").select(F.col("lead").alias("a"), F.col("node").alias("b")).distinct()
        close = stars.join(sketch_b, "b").join(sketch_a, "a").where(_xor_bits("sketch_a", "sketch_b") <= near).select("a", "b")
        links = _links(close, source, nodes, shingle, percent)
        roots = _merge(roots, links)
        release(links)
        # what is left: buckets of several components, and their next leads
        tagged = mixed.select("key", "node").join(roots, "node", "left").select("key", "node", F.coalesce("root", "node").alias("root"))
        shares = tagged.groupBy("key", "root").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(F.xxhash64("node", F.lit(turn)).alias("draw"), "node")).alias("drawn"))
        heads = shares.groupBy("key").agg(F.max(F.struct("n", "root", "drawn.node")).alias("head"), F.count(F.lit(1)).alias("roots")).where("roots > 1")
        rest = tagged.join(exchanged(heads, "key"), "key").select("key", "node", F.when(F.col("root") == F.col("head.root"), F.col("node")).otherwise(F.col("head.node")).alias("lead"), "root")
        rest = materialize(rest, "mixed")
        release(mixed)
        mixed = rest

    # members of one bucket in different components, block against block
    texts = _texts(mixed.select("node").distinct(), source, nodes, shingle)
    fine = materialize(texts.mapInArrow(_fine(shingle), "node binary, fine binary"), "fine")
    release(texts)
    sized = mixed.select("key", "node", "root").join(nodes.select("node", "n"), "node")
    placed = _placed(sized, percent).join(fine, "node").join(nodes.select("node", "bands"), "node")
    rows = placed.select(*KEYS, "side", "node", "root", "n", "bands", "fine").repartition(*KEYS).sortWithinPartitions(*KEYS)
    most = most_odd_bits(percent, FINE_MARGIN, FINE_SAMPLES, FINE_BITS)
    marked = materialize(rows.mapInArrow(_mark(most, percent), PLACE), "marked")
    texts = _texts(marked.select("node").distinct(), source, nodes, shingle)
    sets = texts.mapInArrow(_sets(shingle), "node binary, values binary")
    rows = marked.join(sets, "node").select(*KEYS, "side", "node", "root", "n", "bands", "values").repartition(*KEYS).sortWithinPartitions(*KEYS)
    links = materialize(rows.mapInArrow(_join_components(percent), "a binary, b binary").distinct(), "links")
    for x in (mixed, fine, marked, texts):
        release(x)
    roots = _merge(roots, links)
    release(links)
    labels = nodes.select("node", "low").join(roots, "node", "left").select("node", "low", F.coalesce("root", "node").alias("top"))
    least = labels.groupBy("top").agg(F.min("low").alias("component_id"))
    labels = labels.join(least, "top").select("node", F.col("top").alias("component"), "component_id")
    rows = sketched.select("id", "text_key", "n_shingles", "node").join(labels, "node", "left")
    out = rows.select(F.col("id").alias(id_col), "text_key", "n_shingles", "node", "component", F.coalesce("component_id", "id").alias("component_id"))
    return result(out, "components", sketched, nodes, roots)


def near_dedup(docs: DataFrame, shingle: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component, that of the smallest id, with all columns; rows
    without words all stay. Of rows that repeat its id and text the one whose columns
    hash lowest stays."""
    found = near_components(docs, shingle, percent, id_col, text_col)
    held = F.struct(F.col(id_col).alias("held_id"), F.col("text_key").alias("held_key"))
    kept = found.where("node IS NOT NULL").groupBy("component").agg(F.min(F.when(F.col(id_col).eqNullSafe(F.col("component_id")), held)).alias("kept")).select("kept.*")
    solid = F.coalesce(F.col(text_col), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    rest = [c for c in docs.columns if c not in (id_col, text_col)]
    key = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    keyed = docs.where(solid).select(whole_row(docs).alias("row"), F.col(id_col).alias("row_id"), key.alias("row_key"), (row_tie(rest) if rest else F.lit(0)).alias("tie"))
    rows = keyed.join(kept, F.col("row_id").eqNullSafe(F.col("held_id")) & (F.col("row_key") == F.col("held_key")))
    first = F.row_number().over(Window.partitionBy("row_id", "row_key").orderBy("tie"))
    return rows.withColumn("place", first).where("place = 1").select("row.*").union(docs.where(~solid))
