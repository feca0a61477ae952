"""Conversation prefix trie: every distinct beginning of the conversations is a node, with counts over its subtree.

A node is a depth and a chained SHA-256 digest of the turns so far.  The job, each step a written table:

1. *Turns.* A range partitioning by conversation and turn numbers the turns: places within a range, plus the counts of the ranges before.
   So one conversation may be spread over many tasks.  Only digests and word counts of texts are carried.
2. *Prefixes.* Each conversation's turns, dealt in blocks of bounded length, give a digest for every prefix, chained within the block; the
   blocks' last digests are chained in turn.  One row a prefix.
3. *Nodes.* Prefixes are grouped by depth and digest.  A node belongs to its smallest member, so what a conversation owns is the
   end of its path: a node's children and descendants by the same owner are that conversation's next rows.
4. *Subtrees.* Every node's value goes to all its ancestors: along its owner's prefixes, summed from the end within each
   conversation first, so there is one row a prefix and not one a pair of nodes; then they are grouped by node.
5. *Ends.* The members that end at a node are range-partitioned by node and identifier and packed in chunks, whose bytes are hashed in order.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import looked_up, partitions, written

#: Turns of a conversation that one task chains and sums at once.
BLOCK = 4096
#: Identifiers in a chunk.
CHUNK = 65_536
_NOTHING = hashlib.sha256(b"").hexdigest()


def turns(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((conv, pos from 0, print, words), (conv, turns)) of rows (conv_id, turn, role, text).

    Turns are in the order of ``turn``, null first; those that tie in the order of role and then of the text's SHA-256.  A null role or text is
    empty; repeated rows are repeated turns.  Rows without a conv_id belong to no conversation and take no part.  Other columns are not read.
    """
    spark, text = conversations.sparkSession, F.coalesce("text", F.lit(""))
    rows = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.unhex(F.sha2(text, 256)).alias("print"),
        F.size(F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")).cast("long").alias("words"), F.monotonically_increasing_id().alias("place"),
    )
    order = ["conv", F.col("turn").asc_nulls_first(), "role", "print", "place"]
    rows = rows.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order)
    both = F.concat(F.encode(F.concat(F.octet_length("role"), F.lit(":"), "role"), "UTF-8"), "print")
    rows = rows.select("conv", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at"), F.unhex(F.sha2(both, 256)).alias("print"), "words")
    rows = written(rows, "turns")
    runs = rows.groupBy("conv", "part").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    before = Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    runs = written(runs.withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0))), "runs")
    placed = looked_up(rows, runs, ["conv", "part"]).select("conv", (F.col("at") - F.col("first") + F.col("start")).alias("pos"), "print", "words")
    return placed, runs.groupBy("conv").agg(F.sum("n").alias("turns"))


def rebuilt(placed: DataFrame, sizes: DataFrame, group: int = 20, longest: int = 4) -> tuple[DataFrame, DataFrame]:
    """((conv, depth from 1, print, words), (conv, length)): conversations that begin as the first of their group does.

    With h = crc32(decimal conv) % longest, the first h turns are those of conversation conv - conv % group (all if it has fewer, none if it doesn't
    exist), and then come the conversation's own turns after its first h.  A conversation may be left without turns.
    """
    borrows = F.pmod(F.crc32(F.col("conv").cast("string")), F.lit(longest))
    convs = sizes.select("conv", "turns", borrows.alias("h"), (F.col("conv") - F.col("conv") % group).alias("base"))
    convs = looked_up(written(convs, "sizes"), written(sizes.select(F.col("conv").alias("base"), F.col("turns").alias("base_turns")).where(F.col("base") % group == 0), "bases"), ["base"], "left")
    convs = convs.withColumn("borrowed", F.least("h", F.coalesce("base_turns", F.lit(0))))
    convs = written(convs.withColumn("length", F.col("borrowed") + F.greatest(F.col("turns") - F.col("h"), F.lit(0))), "convs")
    own = looked_up(placed, convs.select("conv", "h", "borrowed"), ["conv"]).where("pos >= h")
    own = own.select("conv", (F.col("borrowed") + F.col("pos") - F.col("h") + 1).alias("depth"), "print", "words")
    heads = placed.where((F.col("conv") % group == 0) & (F.col("pos") < longest - 1)).withColumnRenamed("conv", "base")
    heads = looked_up(convs.where("h > 0").select("conv", "h", "base"), written(heads, "heads"), ["base"]).where("pos < h")
    heads = heads.select("conv", (F.col("pos") + 1).alias("depth"), "print", "words")
    return own.unionByName(heads), convs.select("conv", "length")


def _chained(batches):
    """Rows (conv, block, depth, words, print) in this order to rows (conv, block, depth, words, inner): the digest of the block so far."""
    last, inner = None, b""
    for batch in batches:
        out = []
        for conv, block, own in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(4).to_pylist(), strict=True):
            inner = hashlib.sha256((inner if (conv, block) == last else b"") + own).digest()
            last = conv, block
            out.append(inner)
        yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(out, pa.binary())], names=["conv", "block", "depth", "words", "inner"])


def _chained_blocks(batches):
    """Rows (conv, block, inner) of full blocks, in this order, to rows (conv, block, outer): the digest of all turns before that block."""
    last, outer = None, b""
    for batch in batches:
        out = []
        for conv, own in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
            outer = hashlib.sha256(outer + own).digest() if conv == last else own
            last = conv
            out.append(outer)
        following = pa.array([b + 1 for b in batch.column(1).to_pylist()], pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0), following, pa.array(out, pa.binary())], names=["conv", "block", "outer"])


def prefixes(path: DataFrame, lengths: DataFrame, block: int = BLOCK) -> DataFrame:
    """(conv, depth, length, digest, words): every prefix of every conversation, the empty one included, and the words of its last text."""
    rows = path.select("conv", F.expr(f"(depth - 1) div {block}").alias("block"), "depth", "words", "print")
    rows = rows.repartition("conv", "block").sortWithinPartitions("conv", "block", "depth")
    inner = written(rows.mapInArrow(_chained, "conv long, block long, depth long, words long, inner binary"), "chained")
    ends = written(inner.where(F.col("depth") % block == 0).select("conv", "block", "inner"), "ends")
    outer = ends.repartition("conv").sortWithinPartitions("conv", "block").mapInArrow(_chained_blocks, "conv long, block long, outer binary")
    rows = looked_up(inner, written(outer, "outer"), ["conv", "block"], "left")
    digest = F.when(F.col("outer").isNull(), F.col("inner")).otherwise(F.unhex(F.sha2(F.concat("outer", "inner"), 256)))
    rows = rows.select("conv", "depth", digest.alias("digest"), "words")
    rows = rows.unionByName(lengths.select("conv", F.lit(0).cast("long").alias("depth"), F.lit(b"").alias("digest"), F.lit(0).cast("long").alias("words")))
    return written(looked_up(rows, lengths, ["conv"]), "prefixes")


def _packed(chunk: int):
    """Rows (depth, digest, conv) in this order to rows (depth, digest, first, ids): the decimal identifiers of a node, comma-joined, in chunks."""

    def run(batches):
        node, first, ids = None, 0, []
        names = ["depth", "digest", "first", "ids"]
        types = [pa.int64(), pa.binary(), pa.int64(), pa.binary()]
        for batch in batches:
            out = []
            for depth, digest, conv in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if node != (depth, digest) or len(ids) == chunk:
                    if ids:
                        out.append((*node, first, ",".join(ids).encode()))
                    node, first, ids = (depth, digest), conv, []
                ids.append(str(conv))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), types, strict=True)], names=names)
        if ids:
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((*node, first, ",".join(ids).encode()), types, strict=True)], names=names)

    return run


def _hashed(batches):
    """Rows (depth, digest, first, ids) in this order to rows (depth, digest, ends): SHA-256 over a node's chunks, comma-joined."""
    node, state, names = None, None, ["depth", "digest", "ends"]
    schema = pa.schema([("depth", pa.int64()), ("digest", pa.binary()), ("ends", pa.string())])
    for batch in batches:
        out = []
        for depth, digest, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3), strict=True):
            if node == (depth, digest):
                state.update(b",")
            else:
                if node:
                    out.append((*node, state.hexdigest()))
                node, state = (depth, digest), hashlib.sha256()
            state.update(ids.as_buffer())
        yield pa.RecordBatch.from_pylist([dict(zip(names, x, strict=True)) for x in out], schema=schema)
    if node:
        yield pa.RecordBatch.from_pylist([dict(zip(names, (*node, state.hexdigest()), strict=True))], schema=schema)


def ends(found: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(depth, digest, ends): for nodes at which conversations end, SHA-256 of their identifiers, ascending and comma-joined.

    SHA-256 reads bytes in order, so one task hashes the chunks of a node; it streams them and makes no identifier's text itself.
    """
    order = ["depth", "digest", "conv"]
    rows = found.where("depth = length").select(order).repartitionByRange(partitions(found.sparkSession), *order).sortWithinPartitions(*order)
    packed = written(rows.mapInArrow(_packed(chunk), "depth long, digest binary, first long, ids binary"), "packed")
    packed = packed.repartition("depth", "digest").sortWithinPartitions("depth", "digest", "first")
    return packed.mapInArrow(_hashed, "depth long, digest binary, ends string")


def trie(path: DataFrame, lengths: DataFrame, block: int = BLOCK, chunk: int = CHUNK) -> DataFrame:
    """The nodes of the trie of ``path`` (conv, depth, print, words) and ``lengths`` (conv, length), which has every conversation.

    One row a node: conv_id, the smallest member; depth; parent_conv_id, the parent's conv_id (null for the root); n_convs, members;
    n_children; n_leaves, childless nodes in the subtree (a node is in its own); saved_tokens, over the subtree, (n_convs - 1) times
    the words of the node's last text; ends_sha256.  Conversations without turns are members of the root; without conversations there is no node.
    """
    found = prefixes(path, lengths, block)
    shared = found.groupBy("depth", "digest").agg(F.count("*").alias("members"), F.min("conv").alias("owner"), F.max("length").alias("deepest")).where("members > 1")
    rows = looked_up(found, written(shared, "shared"), ["depth", "digest"], "left")
    of = lambda c, alone: F.coalesce(F.col(c), alone)
    rows = rows.select(
        "conv", "depth", "digest", "length", F.expr(f"depth div {block}").alias("block"), of("owner", F.col("conv")).alias("owner"),
        ((of("members", F.lit(1)) - 1) * F.col("words")).alias("saved"), (of("deepest", F.col("length")) == F.col("depth")).cast("int").alias("leaf"),
    )
    own = F.col("owner") == F.col("conv")
    rows = rows.withColumn("own", own.cast("int")).withColumn("saved", F.when(own, F.col("saved")).otherwise(0)).withColumn("leaf", F.when(own, F.col("leaf")).otherwise(0))
    rows = written(rows, "owned")
    # What lies in other blocks of a long conversation.
    long = rows.where(F.col("length") >= block).groupBy("conv", "block")
    long = long.agg(F.sum("saved").alias("b_saved"), F.sum("leaf").alias("b_leaf"), F.max_by("owner", "depth").alias("b_owner"), F.min_by("own", "depth").alias("b_own"))
    whole = Window.partitionBy("conv").orderBy("block")
    after = whole.rowsBetween(1, Window.unboundedFollowing)
    long = long.select("conv", "block", F.sum("b_saved").over(after).alias("b_saved"), F.sum("b_leaf").over(after).alias("b_leaf"), F.lag("b_owner").over(whole).alias("b_owner"), F.lead("b_own").over(whole).alias("b_own"))
    rows = looked_up(rows, written(long, "blocks"), ["conv", "block"], "left")
    up, down = (Window.partitionBy("conv", "block").orderBy(F.col("depth").desc() if d else F.col("depth")) for d in (True, False))
    so_far: Column = lambda c: F.sum(c).over(up.rowsBetween(Window.unboundedPreceding, Window.currentRow)) + F.coalesce(F.col(f"b_{c}"), F.lit(0))
    rows = rows.select(
        "conv", "depth", "digest", so_far("saved").alias("saved"), so_far("leaf").alias("leaf"),
        F.coalesce(F.lead("own").over(down), "b_own", F.lit(0)).alias("child"), F.when(own, F.coalesce(F.lag("owner").over(down), "b_owner")).alias("parent"),
    )
    nodes = rows.groupBy("depth", "digest").agg(
        F.min("conv").alias("conv_id"), F.max("parent").alias("parent_conv_id"), F.count("*").alias("n_convs"), F.sum("child").cast("long").alias("n_children"),
        F.sum("leaf").cast("long").alias("n_leaves"), F.sum("saved").cast("long").alias("saved_tokens"),
    )
    return nodes.join(ends(found, chunk), ["depth", "digest"], "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends", F.lit(_NOTHING)).alias("ends_sha256")
    )


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of all conversations, rebuilt by groups of twenty; odd rows as in ``turns``."""
    return trie(*rebuilt(*turns(spark.read.parquet(f"{sf_dir}/conversations.parquet"))))


def _crc_table() -> list[int]:
    """The CRC-32 of one byte."""
    out = []
    for c in range(256):
        for _ in range(8):
            c = c >> 1 ^ (0xEDB88320 if c & 1 else 0)
        out.append(c)
    return out


SQL = rf"""
WITH b AS (SELECT DISTINCT conv_id FROM conversations WHERE conv_id IS NOT NULL),
h AS (SELECT conv_id, xor(list_reduce(list_transform(string_split(conv_id::VARCHAR, ''), lambda s: ascii(s)::BIGINT), lambda c, x: xor(({_crc_table()}::BIGINT[])[(xor(c, x) & 255) + 1], c >> 8), 4294967295), 4294967295) % 4 AS h FROM b),
o AS (SELECT conv_id, list({{'role': coalesce(role, ''), 'text': coalesce(text, '')}} ORDER BY turn NULLS FIRST, coalesce(role, ''), sha256(coalesce(text, ''))) AS t FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
r AS (SELECT h.conv_id, list_concat(coalesce(f.t[1:h.h], []), o.t[h.h + 1:]) AS t FROM h JOIN o ON o.conv_id = h.conv_id LEFT JOIN o f ON f.conv_id = h.conv_id - h.conv_id % 20),
p AS (SELECT conv_id, len(t) AS length, unnest(range(0, len(t) + 1)) AS depth, t FROM r),
n AS MATERIALIZED (SELECT depth, t[1:depth] AS path, min(conv_id) AS conv_id, count(*) AS n_convs,
  sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE length = depth), '')) AS ends_sha256 FROM p GROUP BY depth, path),
w AS MATERIALIZED (SELECT *, (n_convs - 1) * CASE WHEN depth = 0 THEN 0 ELSE len(regexp_extract_all(path[depth].text, '[^\x20\x09-\x0D]+')) END AS saved,
  (SELECT count(*) FROM n c WHERE c.depth = n.depth + 1 AND c.path[1:n.depth] = n.path) AS n_children FROM n)
SELECT a.conv_id, a.depth, q.conv_id AS parent_conv_id, a.n_convs, a.n_children, count(*) FILTER (WHERE d.n_children = 0) AS n_leaves, sum(d.saved)::BIGINT AS saved_tokens, a.ends_sha256
FROM w a JOIN w d ON d.depth >= a.depth AND d.path[1:a.depth] = a.path LEFT JOIN w q ON q.depth = a.depth - 1 AND a.path[1:a.depth - 1] = q.path GROUP BY ALL
"""
