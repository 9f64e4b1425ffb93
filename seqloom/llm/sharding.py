"""Weighted rendezvous sharding by stable record keys, with gapless slots.

A record's shard is the one with the least ``-ln(u) / weight`` where ``u`` comes from a digest of the key
and the shard's number. A further shard draws its own numbers and leaves all others alone, so records
move only into it. Slots number each shard's rows in the order of a digest: rows are dealt by (shard, digest
prefix), numbered inside these small ranges, and shifted by the running count of the ranges before;
the table of counts has at most shards x 4096 rows whatever the input, so it is broadcast unless the shards are very many.

Defined results: a null key is the empty key; repeated keys land in one shard with separate slots;
a null text counts as empty; an empty table gives an empty result; input columns named shard, slot or grown_shard are replaced,
others may have any name and are kept.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import apart, column, others, text_or_empty

#: Hex digits of a digest that become the uniform number, and that name a range of slots.
DIGITS, PREFIX = 13, 3
BROADCAST_ROWS = 200_000


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """The shard number, 0 to len(weights) - 1, of a string key."""
    if not weights or min(weights) <= 0:
        raise ValueError("weights must be positive")

    def cost(shard: int, weight: float) -> Column:
        digest = F.md5(F.concat(key, F.lit(f"#{shard}")))
        unit = (F.conv(F.substring(digest, 1, DIGITS), 16, 10).cast("double") + 1) / float(16**DIGITS + 1)
        return F.struct((-F.log(unit) / float(weight)).alias("cost"), F.lit(shard).alias("shard"))

    costs = [cost(s, w) for s, w in enumerate(weights)]
    return (F.least(*costs) if len(costs) > 1 else costs[0])["shard"]


def sharded(docs: DataFrame, weights: Sequence[float] = (1.0,) * 8, key: str = "doc_id", grown_weight: float = 1.0, spread: Sequence[str] = ()) -> DataFrame:
    """``docs`` plus ``shard``, ``slot`` and ``grown_shard`` (the shard if one more of ``grown_weight`` joined).

    ``spread`` names columns that tell rows of one key apart: they take part in the ranges, so that a key of very many rows has many.
    """
    own = apart(docs)
    name = F.coalesce(column(key).cast("string"), F.lit(""))
    apart_by = [F.coalesce(column(c).cast("string"), F.lit("")) for c in spread]
    place = F.substring(F.md5(F.concat_ws("/", name, *apart_by)), 1, PREFIX)
    names = [column(c) for c in others(docs, "shard", "slot", "grown_shard")]
    known = [name.alias(own + "name"), F.struct(*apart_by).alias(own + "rest")] if spread else [name.alias(own + "name")]
    placed = docs.select(*names, *known, rendezvous(name, weights).alias("shard"), rendezvous(name, [*weights, grown_weight]).alias("grown_shard"), place.alias(own + "range"))
    counts = docs.select(rendezvous(name, weights).alias("shard"), place.alias(own + "range")).groupBy("shard", own + "range").agg(F.count(F.lit(1)).alias(own + "n"))
    before = Window.partitionBy("shard").orderBy(own + "range").rowsBetween(Window.unboundedPreceding, -1)
    shifts = counts.select("shard", own + "range", F.coalesce(F.sum(own + "n").over(before), F.lit(0)).alias(own + "shift"))
    if len(weights) * 16**PREFIX <= BROADCAST_ROWS:
        shifts = F.broadcast(shifts)
    inside = F.row_number().over(Window.partitionBy("shard", own + "range").orderBy(F.md5(own + "name"), own + "name", *([own + "rest"] if spread else [])))
    numbered = placed.withColumn(own + "inside", inside).join(shifts, ["shard", own + "range"])
    return numbered.select(*names, "shard", (F.col(own + "shift") + F.col(own + "inside") - 1).cast("long").alias("slot"), "grown_shard")


def op6_sharding(spark, sf_dir):
    text = text_or_empty()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).cast("long").alias("text_crc32"))
    return sharded(docs, spread=["text_crc32"]).select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def _sql(shards: int = 8) -> str:
    """CRC-32 is folded over the bytes by a table that its polynomial makes."""

    def least(n: int) -> str:
        return f"list_transform(range({n}), lambda s: -ln((('0x' || md5(name || '#' || s)[1:{DIGITS}])::BIGINT + 1)::DOUBLE / {16**DIGITS + 1}::DOUBLE))"

    return f"""
    WITH t AS (SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS steps),
    d AS (SELECT doc_id, coalesce(doc_id::VARCHAR, '') AS name, hex(encode(coalesce(text, ''))) AS h FROM documents),
    c AS (
      SELECT doc_id, name, (length(h) // 2 + 1)::BIGINT AS size,
             xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(h, '..'), lambda b: ('0x' || b)::BIGINT)), lambda c, b: xor(c >> 8, steps[(xor(c, b) & 255) + 1])), 4294967295)::BIGINT AS text_crc32
      FROM d, t),
    s AS (SELECT *, {least(shards)} AS now, {least(shards + 1)} AS later FROM c),
    p AS (SELECT *, list_position(now, list_min(now)) - 1 AS shard, list_position(later, list_min(later)) - 1 AS grown, md5(name || '/' || text_crc32)[1:{PREFIX}] AS place FROM s)
    SELECT doc_id, size, text_crc32, 'key' AS law, shard::INTEGER AS shard,
           (row_number() OVER (PARTITION BY shard ORDER BY place, md5(name), name, text_crc32::VARCHAR) - 1)::BIGINT AS slot, grown::INTEGER AS grown_shard
    FROM p"""


SQL = _sql()
