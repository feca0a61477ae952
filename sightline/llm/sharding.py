"""Sharding by a hierarchical weighted hash tree."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import draw, looked_up, written

#: Rows that one task numbers, on average.
RUN = 2000


@dataclass(frozen=True)
class Leaf:
    region: int
    rack: int
    shard: int
    weight: float = 1.0


def even_tree(shards: int, per_rack: int = 2, racks: int = 2) -> list[Leaf]:
    """Shards 0.. in racks of two, racks in regions of two; the first shards keep their place when more follow."""
    return [Leaf(s // (per_rack * racks), s // per_rack, s) for s in range(shards)]


def walked(key: Column, tree: list[Leaf], seed: int = 5) -> Column:
    """The shard of a key: from the root the region, then its rack, then its shard with the smallest weighted draw.

    A node's draw is exponential in its weight, the sum of the weights of the shards below, -ln(u) / weight with u hashed from
    seed, key, level and node.  Only the children of the node chosen so far are drawn.  So weight that moves between
    the shards of a rack, or the racks of a region, moves rows only there, and a new region takes rows only into itself.
    A change of a region's sum moves rows between regions, and in the region that grows these go to any shard.
    Shards of weight 0 get nothing.
    """
    tree = [x for x in tree if x.weight > 0]
    if not tree:
        raise ValueError("no shard has a positive weight")

    def chosen(level: str, nodes: list[tuple[tuple[int, ...], float]], below) -> Column:
        """What ``below`` gives for the node drawn, of nodes (name, weight)."""
        if len(nodes) == 1:
            return below(nodes[0][0])
        draws = [F.struct((-F.ln(F.lit(1.0) - draw(seed, key, level, *name)) / weight).alias("draw"), F.lit(i).alias("at")) for i, (name, weight) in enumerate(nodes)]

        def descend(at: Column) -> Column:
            way = F.when(at == 0, below(nodes[0][0]))
            for i, (name, _) in enumerate(nodes[1:], 1):
                way = way.when(at == i, below(name))
            return way

        return F.transform(F.array(F.array_min(F.array(*draws))["at"]), descend)[0]  # binds the choice once

    def weights(depth: int, inside: tuple[int, ...] = ()) -> list[tuple[tuple[int, ...], float]]:
        sums: dict[tuple[int, ...], list[float]] = {}
        for x in tree:
            name = (x.region, x.rack, x.shard)[:depth]
            if name[: len(inside)] == inside:
                sums.setdefault(name, []).append(x.weight)
        return [(name, math.fsum(w)) for name, w in sorted(sums.items())]

    shard = lambda rack: chosen("shard", weights(3, rack), lambda leaf: F.lit(leaf[2]))
    rack = lambda region: chosen("rack", weights(2, region), shard)
    return chosen("region", weights(1), rack)


def sharded(docs: DataFrame, shard: Column, id_col: str = "doc_id", text_col: str = "text", more: dict[str, Column] | None = None, run_rows: int = RUN) -> DataFrame:
    """(id, size, text_crc32, shard, slot and ``more``) for every row; slots number a shard's rows from 0 without gaps.

    Runs of about ``run_rows`` rows of a shard, by a hash of the identifier, are numbered apart and start where the runs before
    them end, so no task holds a shard.  A null text has no bytes: size 1, checksum 0.  Rows with the same identifier
    (null is one) share shard and run and get slots of their own; an identifier of more rows than a run, and more than
    a 10,000th of all, is dealt over several runs by the rows' places in the input.
    """
    rows = docs.select(
        F.col(id_col).alias("id"),
        (F.coalesce(F.octet_length(text_col), F.lit(0)) + 1).cast("long").alias("size"),
        F.coalesce(F.crc32(F.encode(F.col(text_col), "UTF-8")), F.lit(0)).cast("long").alias("text_crc32"),
        shard.alias("shard"),
        *((c.alias(name)) for name, c in (more or {}).items()),
    )
    total = docs.count()
    runs, most = max(1, total // run_rows), max(run_rows, total // 10_000)
    hot = docs.groupBy(F.col(id_col).alias("hot_id")).agg(F.count("*").alias("copies")).where(F.col("copies") > most)  # 10,000 rows at most
    rows = rows.join(F.broadcast(hot), F.col("id").eqNullSafe(F.col("hot_id")), "left").withColumn("place", F.monotonically_increasing_id())
    rows = rows.withColumn("run", F.pmod(F.conv(F.substring(F.md5(F.coalesce(F.col("id").cast("string"), F.lit("null"))), 1, 8), 16, 10).cast("long"), F.lit(runs)).cast("int"))
    rows = rows.withColumn("part", F.when(F.col("copies").isNull(), 0).otherwise(F.pmod(F.xxhash64("place"), F.ceil(F.col("copies") / run_rows)))).drop("hot_id", "copies", "place")
    rows = written(rows, "placed")
    sizes = rows.groupBy("shard", "run", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("run", "part").rowsBetween(Window.unboundedPreceding, -1)
    starts = written(sizes.select("shard", "run", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start")), "starts")
    own = Window.partitionBy("shard", "run", "part").orderBy("id", "text_crc32", "size")
    numbered = looked_up(rows.withColumn("turn", F.row_number().over(own)), starts, ["shard", "run", "part"])
    return numbered.select(
        F.col("id").alias(id_col), "size", "text_crc32", "shard", (F.col("start") + F.col("turn") - 1).alias("slot"), *(more or {})
    )


def op9_hash_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight even shards; the law is ``key``, as doc_id and the tree decide alone."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    return sharded(docs, walked(key, even_tree(8)), more={"law": F.lit("key"), "grown_shard": walked(key, even_tree(9))})


def _drawn(level: str, nodes: list[tuple[int, ...]], weights: list[int]) -> str:
    """The place, from 0, of the least draw of the nodes, in SQL."""
    u = lambda name: f"('0x' || substr(md5('5/' || doc_id || '/{level}/{'/'.join(map(str, name))}'), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE"
    draws = f"[{', '.join(f'-ln(1.0::DOUBLE - {u(n)}) / {w}' for n, w in zip(nodes, weights, strict=True))}]"
    return f"list_position({draws}, list_min({draws})) - 1"


def _rack_sql(region: int) -> str:
    racks = [2 * region, 2 * region + 1]
    shards = " ".join(f"WHEN {i} THEN {2 * rack} + {_drawn('shard', [(region, rack, 2 * rack), (region, rack, 2 * rack + 1)], [1, 1])}" for i, rack in enumerate(racks))
    return f"CASE {_drawn('rack', [(region, r) for r in racks], [2, 2])} {shards} END"


def _crc_table() -> list[int]:
    """The CRC-32 of four bits."""
    out = []
    for c in range(16):
        for _ in range(4):
            c = c >> 1 ^ (0xEDB88320 if c & 1 else 0)
        out.append(c)
    return out


_T = f"({_crc_table()}::BIGINT[])"
_LOW = f"xor({_T}[(xor(c, b) & 15) + 1], c >> 4)"
SQL = f"""
WITH d AS (SELECT doc_id, text, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: ('0x' || h)::BIGINT) AS bytes FROM documents),
c AS (SELECT doc_id, strlen(coalesce(text, '')) + 1 AS size,
  CASE WHEN len(bytes) = 0 THEN 0 ELSE xor(list_reduce(bytes, lambda c, b: xor({_T}[(xor({_LOW}, b >> 4) & 15) + 1], {_LOW} >> 4), 4294967295), 4294967295) END AS text_crc32 FROM d),
s AS (SELECT *, CASE {_drawn("region", [(0,), (1,)], [4, 4])} WHEN 0 THEN {_rack_sql(0)} ELSE {_rack_sql(1)} END::INTEGER AS shard,
  {_drawn("region", [(0,), (1,), (2,)], [4, 4, 1])} AS grown, ('0x' || substr(md5(doc_id::VARCHAR), 1, 8))::BIGINT % greatest(1, (SELECT count(*) FROM documents) // {RUN}) AS run FROM c)
SELECT doc_id, size, text_crc32, 'key' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY run, doc_id, text_crc32, size) - 1 AS slot,
  CASE WHEN grown = 2 THEN 8 ELSE shard END::INTEGER AS grown_shard FROM s
"""
