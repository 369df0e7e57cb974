"""Balanced sharding by label propagation, with DataFrame and SQL functions only.

Documents with one text are linked. Every document starts in a shard that its id and text decide.
In each round the documents of a group that started in one part of a shard, a block, look where
most of their linked documents are and ask to move there; a shard admits blocks while its quota
lasts, so sizes stay even. Groups too large for a shard fill one shard after another. Blocks are
counts, not documents: a group of any size has at most PIECES for each shard. A last step places the documents,
spills what is over a shard's share and pours it into what is left of the others.

Order numbers never come from one task: rows are counted in chunks of bounded size, and a row's
number is what the chunks before hold plus its number within its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import drop_table, materialize, text_key

SHARDS, MAX_ROUNDS = 24, 12
#: Rows of a chunk that are numbered in one task.
CHUNK_ROWS = 20_000
#: Parts in which a group can leave a shard, so that large groups pack well.
PIECES = 4
#: Buckets of blocks for which a shard's quota is dealt out as a whole first.
BUCKETS = 1024


def numbered(rows: DataFrame, part: str, order: list[str], out: str) -> DataFrame:
    """``rows`` with a gapless number from 0 in each ``part``, by chunk and then by ``order``.

    ``rows`` has a column ``chunk`` that comes first in the order; chunks should be of bounded size.
    """
    sizes = rows.groupBy(part, "chunk").agg(F.count("*").alias("n"))
    before = sizes.select(F.col(part).alias("p"), F.col("chunk").alias("c"), (F.sum("n").over(W.partitionBy(part).orderBy("chunk")) - F.col("n")).alias("before"))
    own = rows.withColumn("own", F.row_number().over(W.partitionBy(part, "chunk").orderBy(*order)))
    joined = own.join(before, (F.col(part) == F.col("p")) & (F.col("chunk") == F.col("c")))
    return joined.withColumn(out, F.col("before") + F.col("own") - 1).drop("p", "c", "own", "before")


def _admitted(asks: DataFrame, room: DataFrame) -> DataFrame:
    """The asked moves (key, home, goal, n) that fit into each goal's room, bucket after bucket."""
    asks = asks.withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(BUCKETS)))
    sizes = asks.groupBy("goal", "bucket").agg(F.sum("n").alias("m"))
    whole = sizes.select("goal", "bucket", (F.sum("m").over(W.partitionBy("goal").orderBy("bucket")) - F.col("m")).alias("before"))
    whole = whole.join(F.broadcast(room.withColumnRenamed("shard", "goal")), "goal").where("before < room")
    within = F.sum("n").over(W.partitionBy("goal", "bucket").orderBy("key", "home"))
    return asks.join(whole, ["goal", "bucket"]).withColumn("upto", F.col("before") + within).where("upto <= room").select("key", "home", "goal")


def propagated(blocks: DataFrame, quota: DataFrame, max_rounds: int = MAX_ROUNDS) -> DataFrame:
    """Move blocks (key, home, n) towards their groups' shards; adds ``shard``. ``quota`` has shard, share."""
    now = materialize(blocks.withColumn("shard", (F.col("home") / PIECES).cast("int")), "blocks")
    for _ in range(max_rounds):
        load = now.groupBy("shard").agg(F.sum("n").alias("load"))
        room = materialize(quota.join(load, "shard", "left").select("shard", (F.col("share") - F.coalesce("load", F.lit(0))).alias("room")), "room")
        # each block's best shard among those that hold more of its group and have room for it;
        # ties go to a hash, so that goals spread
        held = now.groupBy("key", "shard").agg(F.sum("n").alias("held")).withColumn("weight", F.struct("held", F.xxhash64("key", "shard").alias("h")))
        here = now.join(held.select("key", "shard", F.col("weight").alias("own")), ["key", "shard"])
        there = held.join(F.broadcast(room), "shard").where("room > 0").select("key", F.col("shard").alias("goal"), "weight", "room")
        asks = here.join(there, "key").where("goal <> shard and room >= n and weight > own")
        asks = asks.groupBy("key", "home", "n").agg(F.max(F.struct("weight", "goal"))["goal"].alias("goal"))
        moved = materialize(_admitted(asks, room), "moves")
        if moved.isEmpty():
            drop_table(moved)
            break
        after = materialize(now.join(moved, ["key", "home"], "left").select("key", "home", "n", F.coalesce("goal", "shard").alias("shard")), "blocks")
        for old in (now, moved, room):
            drop_table(old)
        now = after
    return now


def sharded(docs: DataFrame, id: str = "doc_id", text: str = "text", shards: int = SHARDS, max_rounds: int = MAX_ROUNDS, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Columns id, size, text_crc32, shard, slot: a shard from 0 and a place in it for each row of ``docs``.

    Law ``rows``: the shards' row counts are at most one apart. Documents with one text go to one
    shard where the shares allow it; texts that fill more than a shard's share fill shards one
    after another. ``size`` is the text's UTF-8 bytes plus 8. Null texts count as empty and are
    one group with them; null ids and repeated rows are rows like others; an empty table gives an
    empty result; other columns are ignored.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(id).alias("id"), (F.octet_length(t) + 8).cast("long").alias("size"), F.crc32(t.cast("binary")).alias("crc"), text_key(t).alias("key"))
    rows = materialize(rows.withColumn("home", F.pmod(F.xxhash64("id", "key"), F.lit(shards * PIECES)).cast("int")), "rows")
    total = rows.count()
    spark = docs.sparkSession
    quota = spark.range(shards).select(F.col("id").cast("int").alias("shard"), (F.lit(total // shards) + (F.col("id") < total % shards).cast("long")).alias("share"))

    sizes = rows.groupBy("key", "home").agg(F.count("*").alias("n"))
    groups = sizes.groupBy("key").agg(F.sum("n").alias("members")).where("members > 1")
    blocks = materialize(sizes.join(groups, "key"), "groups")
    moved = propagated(blocks.select("key", "home", "n"), quota, max_rounds)
    placed = blocks.select("key", "home", "members").join(moved.select("key", "home", "shard"), ["key", "home"])

    # grouped documents come first in a shard, so what spills are single ones while there are any
    chunks = max(1, -(-total // (shards * chunk_rows)))
    both = rows.join(placed, ["key", "home"], "left")
    parts = F.greatest(F.lit(1), F.ceil(F.coalesce("members", F.lit(1)) / chunk_rows))
    salt = F.pmod(F.xxhash64("id", F.lit(7)), parts)
    chunk = F.struct(F.col("members").isNull().cast("int").alias("a"), F.pmod(F.xxhash64("key"), F.lit(chunks)).alias("b"), salt.alias("c"))
    both = materialize(both.select("id", "size", "crc", "key", F.coalesce("shard", (F.col("home") / PIECES).cast("int")).alias("want"), chunk.alias("chunk")), "wants")
    order = ["key", F.asc_nulls_first("id"), "size"]
    for old in (rows, blocks, moved):
        drop_table(old)
    ranked = materialize(numbered(both, "want", order, "place"), "ranked")
    drop_table(both)
    ranked = ranked.join(F.broadcast(quota.withColumnRenamed("shard", "want")), "want")
    stays = ranked.where("place < share").select("id", "size", "crc", F.col("want").alias("shard"), F.col("place").alias("slot"))

    held = ranked.groupBy("want").agg(F.count("*").alias("held"))
    gaps = quota.join(held, F.col("shard") == F.col("want"), "left").select("shard", F.coalesce("held", F.lit(0)).alias("held"), "share").where("held < share")
    upto = F.sum(F.col("share") - F.col("held")).over(W.orderBy("shard"))
    gaps = materialize(gaps.select("shard", "held", (upto - F.col("share") + F.col("held")).alias("low"), upto.alias("high")), "gaps")
    spilled = ranked.where("place >= share").select("id", "size", "crc", "key", F.struct("want", "chunk").alias("chunk"), F.lit(0).alias("all"))
    poured = numbered(spilled, "all", order, "number")
    # at most one row a shard, so the range join is a broadcast of ``shards`` rows
    poured = poured.join(F.broadcast(gaps), (F.col("number") >= F.col("low")) & (F.col("number") < F.col("high")))
    poured = poured.select("id", "size", "crc", "shard", (F.col("held") + F.col("number") - F.col("low")).alias("slot"))
    out = stays.union(poured)
    return out.select(F.col("id").alias(id), "size", F.col("crc").alias("text_crc32"), "shard", F.col("slot").cast("long").alias("slot"))


def cut_links(placed: DataFrame, group: Column | str) -> DataFrame:
    """One row: links in all and those cut, where each group's documents are linked in a chain that visits a shard once."""
    per = placed.groupBy(F.expr(group) if isinstance(group, str) else group).agg(F.count("*").alias("n"), F.countDistinct("shard").alias("s"))
    return per.agg(F.sum(F.col("n") - 1).alias("links"), F.sum(F.col("s") - 1).alias("cut"))
