"""Sharding by balanced label propagation.

Documents with equal texts are linked (each to its group, never pairwise). Every
document starts in a shard drawn from its identifier. Linked documents of one
group in one start shard form a cell; in each round a cell looks up, by joins
over (group, shard), which of its neighbours' shards holds most of the group and
still has room, and the moves of a shard are accepted in order of gain up to its
quota. A cell moves whole, so a group of several shards' size whose cells no longer
fit anywhere stays where it started. The unlinked documents then fill every shard up to the same size: they are weighed
in ``BALLAST`` hash buckets, a bounded table, and dealt best fit decreasing.

Law ``bytes``: shard sizes are equal up to about one ballast bucket. Size is the
UTF-8 length plus 8; null texts count 8, have no group and no checksum. Empty
texts form one group. Repeated rows of one identifier stay in one shard. Slots
number a shard's rows gaplessly from 0, ordered by bucket, identifier and checksum.
An empty table has no rows. Only the named columns are read, so other columns cannot
clash; identifiers may be of any type that casts to text.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import materialize, release, utf8_length

BALLAST = 16_384
ROUNDS = 8
#: Hash buckets in which the moves into one shard are ranked.
LANES = 256
SLOT_BUCKETS = 512


def _loads(df: DataFrame, by: str, what: str) -> dict[int, int]:
    return {r[by]: r["load"] for r in df.groupBy(by).agg(F.sum(what).alias("load")).collect()}


def propagate(cells: DataFrame, shards: int, capacity: int, rounds: int = ROUNDS) -> DataFrame:
    """Label propagation over cells (g, start, label, rows, bytes) under quotas.

    Per round: the labels of each group are summed, full shards drop out as
    targets, each cell picks the heaviest open label of its group, and moves are
    accepted by gain lane and hash lane until the target's room is used. What the
    driver sees is one number a shard and one a lane.
    """
    spark = cells.sparkSession

    def reserve(weight: str):
        """Large groups leave a tenth of a shard to the small ones."""
        return F.when(F.col(weight) > capacity // 64, F.lit(capacity // 10)).otherwise(F.lit(0))

    for _ in range(rounds):
        load = _loads(cells, "label", "bytes")
        room = [(s, max(0, capacity - load.get(s, 0))) for s in range(shards)]
        open_shards = F.broadcast(spark.createDataFrame(room, "label int, room long"))
        held = cells.groupBy("g", "label").agg(F.sum("bytes").alias("weight"))
        # a label attracts while the cell fits; the heaviest wins, then the smallest label
        offers = held.join(open_shards, "label").select("g", F.col("label").alias("target"), "weight", "room")
        pulled = cells.join(offers, "g").where((F.col("label") == F.col("target")) | (F.col("room") - reserve("weight") >= F.col("bytes")))
        best = pulled.groupBy("g", "start", "label", "rows", "bytes").agg(F.max(F.struct("weight", (-F.col("target")).alias("order"))).alias("best"))
        wish = best.select("g", "start", "label", "rows", "bytes", (-F.col("best.order")).cast("int").alias("target"), F.col("best.weight").alias("gain"))
        # of two shards of equal weight only the larger label yields, so rounds end
        lane = F.pmod(F.xxhash64("g", "start"), F.lit(LANES)).cast("int")
        rank = (F.lit(63) - F.floor(F.log2(F.greatest(F.lit(1), F.col("gain"))))).cast("int")
        wish = materialize(wish.withColumns({"lane": lane, "rank": rank}), "wish")
        ahead = Window.partitionBy("target").orderBy("rank", "lane")
        lanes = wish.where("target != label").groupBy("target", "rank", "lane").agg(F.sum("bytes").alias("bytes"))
        taken = lanes.withColumn("until", F.sum("bytes").over(ahead)).join(open_shards.withColumnRenamed("label", "target"), "target").where(F.col("until") <= F.col("room") - reserve("bytes")).select("target", "rank", "lane", F.lit(True).alias("ok"))
        taken = materialize(taken, "taken")
        moved = wish.join(F.broadcast(taken), ["target", "rank", "lane"], "left").select("g", "start", F.when(F.col("ok") & (F.col("target") != F.col("label")), F.col("target")).otherwise(F.col("label")).alias("label"), "rows", "bytes")
        n_moves = taken.count()
        after = materialize(moved, "cells")
        for x in (wish, taken, cells):
            release(x)
        cells = after
        if not n_moves:
            break
    return cells


def deal_ballast(buckets: list[tuple[int, int]], loads: dict[int, int], shards: int) -> dict[int, int]:
    """Best fit decreasing: each bucket (number, bytes) to the emptiest shard."""
    heap = [(loads.get(s, 0), s) for s in range(shards)]
    heapq.heapify(heap)
    out = {}
    for b, size in sorted(buckets, key=lambda x: (-x[1], x[0])):
        load, s = heapq.heappop(heap)
        out[b] = s
        heapq.heappush(heap, (load + size, s))
    return out


def balanced_shards(docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text", ballast: int = BALLAST) -> DataFrame:
    """Per row: id column, size, text_crc32, shard, slot, under law ``bytes``."""
    spark = docs.sparkSession
    text = F.col(text_col)
    ident = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    base = docs.select(
        F.col(id_col).alias("id"),
        (F.coalesce(utf8_length(text), F.lit(0)) + 8).alias("size"),
        F.crc32(text.cast("binary")).alias("crc"),
        F.when(text.isNotNull(), F.xxhash64(text, F.octet_length(text))).alias("g"),
        F.pmod(F.xxhash64(ident, F.lit("start")), F.lit(shards)).cast("int").alias("start"),
        F.pmod(F.xxhash64(ident, F.lit("ballast")), F.lit(ballast)).cast("int").alias("bucket"),
    )
    base = materialize(base, "sizes")
    total = base.agg(F.sum("size")).first()[0] or 0
    capacity = -(-total // shards)

    # cells of groups with two rows or more
    cells = base.where("g IS NOT NULL").groupBy("g", "start").agg(F.count(F.lit(1)).alias("rows"), F.sum("size").alias("bytes"))
    linked = cells.groupBy("g").agg(F.sum("rows").alias("n")).where("n > 1").select("g")
    cells = materialize(cells.join(linked, "g").select("g", "start", F.col("start").alias("label"), "rows", "bytes"), "cells")
    cells = propagate(cells, shards, capacity)

    placed = base.join(cells.select("g", "start", "label"), ["g", "start"], "left")
    single = placed.where("label IS NULL").groupBy("bucket").agg(F.sum("size").alias("bytes"))
    weights = [(r["bucket"], r["bytes"]) for r in single.collect()]  # at most ``ballast`` rows
    dealt = deal_ballast(weights, _loads(cells, "label", "bytes"), shards)
    ballast_table = F.broadcast(spark.createDataFrame(sorted(dealt.items()), "bucket int, ballast int"))
    sharded = placed.join(ballast_table, "bucket", "left").select("id", "size", "crc", F.coalesce("label", "ballast").alias("shard"), F.pmod(F.xxhash64("id", "crc", "size"), F.lit(SLOT_BUCKETS)).cast("int").alias("part"))
    sharded = materialize(sharded, "sharded")
    numbered = number_rows(sharded, ["shard"], ["id", "crc", "size"])
    return numbered.select(F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def number_rows(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """Gapless ``slot`` from 0 within ``by``: parts are counted, their offsets
    summed over at most ``SLOT_BUCKETS`` parts, and rows numbered within a part."""
    counts = df.groupBy(*by, "part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy(*by).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("offset", F.coalesce(F.sum("n").over(before), F.lit(0)).cast("long")).drop("n")
    within = Window.partitionBy(*by, "part").orderBy(*order)
    return df.withColumn("at", F.row_number().over(within)).join(offsets, [*by, "part"]).withColumn("slot", (F.col("offset") + F.col("at") - 1).cast("long")).drop("offset", "at", "part")
