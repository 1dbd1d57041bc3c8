"""Exact de-duplication by Patricia-trie owners.

Rows are dealt by (length, content hash) to partitions, which insert whole texts, as
bytes, into a compressed radix trie. Its terminal nodes hold the smallest and largest
identifier and the number of rows. Every node knows the bytes below it. Once a trie
exceeds its budget it spills by subtree: from the root it follows the heaviest branch
down to a subtree of at most half the budget, gives out that subtree's terminals and
cuts it off, until half the budget is free; the rest of the trie stays.

Tasks first fold their own rows in this way, so a text reaches the shuffle once per
task and spill, however hot it is; what they give out is partial and may name a text
again. After the shuffle rows come sorted by (length, content hash). There a spilled
terminal is final, as its text cannot come again: only terminals of the present
(length, hash) are held back. Memory is the budget plus one text.

Nulls count as empty texts; empty texts are equal to each other. Identifiers may be
of any type that can be ordered; null ones lose against any other. Repeated rows
(same identifier and text) count in the group, and exactly one of them is kept: that
whose columns hash lowest. An empty table has no groups and no members. Only the
named columns are read, and ``exact_dedup`` carries all others along, whatever their
names.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import row_tie, utf8_length, whole_row

#: Bytes of text that one trie may hold before it spills subtrees.
TRIE_BYTES = 48 << 20
#: What a node costs besides its label.
NODE_BYTES = 200


class Trie:
    """Compressed radix trie over byte strings; a node is [label, children, terminal,
    bytes held by the node and all below it]. A terminal is [low, n_low, high, n_high,
    rows, tag]."""

    def __init__(self) -> None:
        self.root: list = [b"", {}, None, 0]

    @property
    def held(self) -> int:
        return self.root[3]

    def insert(self, key: bytes, tag, low, n_low: int, high, n_high: int, rows: int) -> None:
        node, at, path, grown = self.root, 0, [self.root], 0
        while at < len(key):
            child = node[1].get(key[at])
            if child is None:
                child = [key[at:], {}, None, 0]
                node[1][key[at]] = child
                grown += len(key) - at + NODE_BYTES
                node, at = child, len(key)
            elif key.startswith(child[0], at):
                node, at = child, at + len(child[0])
            else:
                label = child[0]
                cut = _shared(key, at, label)
                upper = [label[:cut], {label[cut]: child}, None, child[3] + NODE_BYTES]
                child[0], child[3] = label[cut:], child[3] - cut
                node[1][key[at]] = upper
                for above in path:
                    above[3] += NODE_BYTES
                node, at = upper, at + cut
            path.append(node)
        for above in path:
            above[3] += grown
        if node[2] is None:
            node[2] = [low, n_low, high, n_high, rows, tag]
            return
        t = node[2]
        t[4] += rows
        if low is not None:
            if t[0] is None or low < t[0]:
                t[0], t[1] = low, n_low
            elif low == t[0]:
                t[1] += n_low
            if t[2] is None or high > t[2]:
                t[2], t[3] = high, n_high
            elif high == t[2]:
                t[3] += n_high
        elif t[0] is None:
            t[1] += n_low
            t[3] += n_high

    def terminals(self, prefix: bytes = b"", top: list | None = None) -> Iterator[tuple[bytes, list]]:
        """(key, terminal) of a subtree; ``prefix`` stands above it."""
        stack = [(prefix, self.root if top is None else top)]
        while stack:
            above, node = stack.pop()
            key = above + node[0]
            if node[2] is not None:
                yield key, node[2]
            stack.extend((key, x) for x in node[1].values())

    def heaviest(self, most: int) -> tuple[bytes, list, list[list]]:
        """The subtree to spill: the heaviest branch, followed until it holds at most
        ``most`` bytes or does not branch. Its prefix, its root, and the nodes above."""
        prefix, node, path = b"", self.root, []
        while node[1] and (node is self.root or (node[3] > most and node[2] is None)):
            prefix += node[0]
            path.append(node)
            node = max(node[1].values(), key=lambda x: x[3])
        return prefix, node, path

    def spill(self, budget: int, keep_tag=None) -> Iterator[tuple[bytes, list]]:
        """Give out and cut off heavy subtrees until half the budget is free. Terminals
        tagged ``keep_tag`` go back in."""
        back = []
        while self.root[1] and self.held > budget // 2:
            prefix, node, path = self.heaviest(budget // 2)
            for key, terminal in self.terminals(prefix, node):
                if keep_tag is not None and terminal[5] == keep_tag:
                    back.append((key, terminal))
                else:
                    yield key, terminal
            del path[-1][1][node[0][0]]
            for above in path:
                above[3] -= node[3]
        for key, (low, n_low, high, n_high, rows, tag) in back:
            self.insert(key, tag, low, n_low, high, n_high, rows)


def _shared(key: bytes, at: int, label: bytes) -> int:
    """Length of the common prefix of ``key[at:]`` and ``label``, by halving."""
    lo, hi = 0, min(len(label), len(key) - at)
    while lo < hi:
        mid = (lo + hi + 1) // 2
        if key.startswith(label[:mid], at):
            lo = mid
        else:
            hi = mid - 1
    return lo


def _owners(first: bool, budget: int):
    def run(batches):
        import pyarrow as pa

        trie, kinds = Trie(), None

        def pack(found):
            """Terminals as batches of about 8 MB; texts go along before the shuffle only."""
            cols: list[list] = [[] for _ in kinds]
            size = 0
            for key, (low, n_low, high, n_high, rows, (h, digest)) in found:
                for c, v in zip(cols, (len(key), h, key if first else None, digest, low, n_low, high, n_high, rows), strict=True):
                    c.append(v)
                size += len(key) + NODE_BYTES
                if size > 8 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], NAMES)
                    cols, size = [[] for _ in kinds], 0
            if cols[0]:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], NAMES)

        for b in batches:
            ident = b.schema.field(4).type
            kinds = [pa.int64(), pa.int64(), pa.binary(), pa.string(), ident, pa.int64(), ident, pa.int64(), pa.int64()]
            text = b.column(2).cast(pa.binary())
            rest = [b.column(i).to_pylist() for i in (1, 3, 4, 5, 6, 7, 8)]
            for i, (h, digest, low, n_low, high, n_high, rows) in enumerate(zip(*rest, strict=True)):
                tag = (h, digest)
                if trie.held > budget:
                    yield from pack(trie.spill(budget, None if first else tag))
                trie.insert(text[i].as_py(), tag, low, n_low, high, n_high, rows)
        if kinds is not None:
            yield from pack(trie.terminals())

    return run


NAMES = ["n_bytes", "h", "text", "text_sha256", "low", "n_low", "high", "n_high", "rows"]


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min", trie_bytes: int = TRIE_BYTES) -> DataFrame:
    """Groups of identical texts: n_bytes, text_sha256, keep_id, n_keep (rows that
    carry keep_id), group_size. ``keep`` is ``min`` or ``max``. An empty table has no groups."""
    if keep not in ("min", "max"):
        raise ValueError("keep must be 'min' or 'max'")
    text = F.coalesce(F.col(text_col), F.lit(""))
    one = F.lit(1).cast("long")
    ident = F.col(id_col)
    rows = docs.select(utf8_length(text).alias("n_bytes"), F.xxhash64(text).alias("h"), text.alias("text"), F.sha2(text.cast("binary"), 256).alias("text_sha256"), ident.alias("low"), one.alias("n_low"), ident.alias("high"), one.alias("n_high"), one.alias("rows"))
    id_type = dict(rows.dtypes)["low"]
    owners = f"n_bytes long, h long, text binary, text_sha256 string, low {id_type}, n_low long, high {id_type}, n_high long, rows long"
    local = rows.mapInArrow(_owners(True, trie_bytes), owners)
    dealt = local.repartition("n_bytes", "h").sortWithinPartitions("n_bytes", "h")
    whole = dealt.mapInArrow(_owners(False, trie_bytes), owners)
    kept, n_kept = ("low", "n_low") if keep == "min" else ("high", "n_high")
    return whole.select("n_bytes", "text_sha256", F.col(kept).alias("keep_id"), F.col(n_kept).alias("n_keep"), F.col("rows").alias("group_size"))


def exact_membership(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min", trie_bytes: int = TRIE_BYTES) -> DataFrame:
    """One row per input row: the id column, keep_id, group_size, kept, text_sha256.

    Members are counted per (digest, id) before they meet their group, so the
    join sees a repeated row once; a hot digest is split by the skew join.
    """
    groups = exact_groups(docs, id_col, text_col, keep, trie_bytes)
    digest = F.sha2(F.coalesce(F.col(text_col), F.lit("")).cast("binary"), 256)
    members = docs.select(F.col(id_col).alias("id"), digest.alias("text_sha256")).groupBy("text_sha256", "id").agg(F.count(F.lit(1)).alias("copies"))
    joined = members.join(groups.select("text_sha256", "keep_id", "group_size"), "text_sha256")
    rows = joined.select("id", "keep_id", "group_size", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy"), "text_sha256")
    kept = F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)
    return rows.select(F.col("id").alias(id_col), "keep_id", "group_size", kept.alias("kept"), "text_sha256")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min", trie_bytes: int = TRIE_BYTES) -> DataFrame:
    """The rows that stay, one per distinct text, with all their columns.

    Rows meet their owner on (digest, identifier), a key without hot values, and
    repeated rows fall together in the same partition.
    """
    owners = exact_groups(docs, id_col, text_col, keep, trie_bytes).select(F.col("text_sha256").alias("digest"), F.col("keep_id").alias("owner"))
    rest = [c for c in docs.columns if c not in (id_col, text_col)]
    digest = F.sha2(F.coalesce(F.col(text_col), F.lit("")).cast("binary"), 256)
    rows = docs.select(whole_row(docs).alias("row"), F.col(id_col).alias("row_id"), digest.alias("row_digest"), (row_tie(rest) if rest else F.lit(0)).alias("tie"))
    met = rows.join(owners, (F.col("row_digest") == F.col("digest")) & F.col("row_id").eqNullSafe(F.col("owner")))
    first = F.row_number().over(Window.partitionBy("row_digest", "row_id").orderBy("tie"))
    return met.withColumn("place", first).where("place = 1").select("row.*")
