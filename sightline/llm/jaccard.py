"""N-gram Jaccard join with PartEnum signatures.

The job in four steps, each a written table:

1. *Sets.* Every whole text becomes its set of distinct shingle hashes.  Equal sets form one class.  Packed blocks of
   hashes, each hash once a block, dealt by hash, show for each class how many of its shingles other classes have.  A class
   linked to another shares at least 3/4 of its shingles, so one below that can have no link, nor can one of
   under three shingles; nothing else is left out.
2. *Signatures.* PartEnum over the remaining classes: sets in bands of sizes, a partitioned feature domain,
   and signatures over two of every three parts, none of them empty (see ``signatures``).  All linked pairs share a signature.
3. *Hoods.* The classes that share a signature gather round the smallest of them (by a hash), the hub, so a pair that shares
   a signature lies in one hood.  Hoods are dealt as blocks of bounded size, each with the hub; each block compares exactly, only
   across what is not yet connected, and returns a spanning forest of its links.  Classes first compare in one hood each; hoods'
   blocks that are connected after that need no more.
4. *Rest.* Hoods of several blocks that are not yet in one component compare the few outside their largest component with all
   their blocks.  Where these are more than a block, as with texts that share much but not enough, the hood's classes gather anew by
   their rare shingles (see ``_by_rare_shingles``), and only what meets there is compared.

Groups of near copies thus cost blocks, not pairs, texts that only look alike cost what they have rarely in common, and no row is left out.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, looked_up, small_batches, trim, trimmed, written
from .words import SHINGLE, mix, shingle_sets

#: Similarity as a fraction.
NUM, DEN = 75, 100
#: Classes, and shingles, that a block of a hood holds on average at most.
BLOCK_ROWS, BLOCK_SHINGLES = 512, 1_000_000
#: Of them so many are compared with the block at a time.
ROWS = 256
#: Groups of the domain, over half of the differences to survive; and independent partitions of it to try.
GROUPS, SEEDS = 1.2, 6
#: Owner of a hash that several sets of its block have.
SEVERAL = 65_535
#: Texts' bytes for one bucket of packed hashes.
BUCKET_BYTES = 16 << 20

_U = np.uint64


def _blocks(buckets: int, width: int):
    """Rows of documents (65,534 a batch at most) to a row of digests for each block, and a row of packed hashes for each block and bucket.

    Of equal sets in a block one sends its hashes.  A hash goes once a block, with its set, or marked if several have it; then
    it counts for each of them at once.
    """

    def run(batches):
        task = TaskContext.get().partitionId()
        for number, batch in enumerate(batches):
            if not batch.num_rows:
                continue
            name = f"{task}-{number}"  # a task that runs again gives its blocks the same names
            sets = list(shingle_sets(batch.column(1), width))
            sizes = np.array([len(x) for x in sets], np.int64)
            one = np.concatenate(sets)
            owner = np.repeat(np.arange(len(sets), dtype=np.int64), sizes)
            ends = np.concatenate([[0], np.cumsum(sizes)])
            total = lambda x: np.diff(np.concatenate([np.zeros(1, _U), np.cumsum(x, dtype=_U)])[ends])  # noqa: B023, E731
            digest = np.stack([total(mix(one ^ _U(0x5851F42D4C957F2D))), total(mix(one ^ _U(0x14057B7EF767814F)))])
            ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            sends = np.zeros(len(sets), bool)
            sends[np.unique(np.stack([sizes.view(_U), *digest]), axis=1, return_index=True)[1]] = True
            one, owner = one[sends[owner]], owner[sends[owner]]
            bucket = (one >> _U(40)) % _U(buckets)
            order = np.argsort(bucket << _U(32) | one & _U(0xFFFFFFFF), kind="stable")
            one, owner, bucket = one[order].astype(np.uint32), owner[order], bucket[order].astype(np.int64)
            first = np.ones(len(one), bool)
            first[1:] = (one[1:] != one[:-1]) | (bucket[1:] != bucket[:-1])
            times = np.diff(np.append(np.flatnonzero(first), len(one)))
            several = np.repeat(times > 1, times)
            head = np.concatenate([ids.view(_U), sizes.view(_U), digest[0], digest[1], np.bincount(owner[several], minlength=len(sets)).astype(_U)]).tobytes()
            owner = np.where(several, SEVERAL, owner)[first].astype(np.uint16)
            one, bucket = one[first], bucket[first]
            cuts = np.searchsorted(bucket, np.arange(buckets + 1))
            names, keys, owners, hashes, classes = [name], [-1 - int(ids[0]) % buckets], [head], [b""], [b""]
            for b in range(buckets):
                if cuts[b + 1] > cuts[b]:
                    own = slice(cuts[b], cuts[b + 1])
                    there = np.unique(owner[own])
                    names.append(name)
                    keys.append(b)
                    owners.append(owner[own].tobytes())
                    hashes.append(one[own].tobytes())
                    classes.append(digest[0][there[there < SEVERAL]].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(keys, pa.int32()), *(pa.array(x, pa.binary()) for x in (owners, hashes, classes))], names=["block", "bucket", "owners", "hashes", "classes"])

    return run


def _repeated(table: pa.Table) -> pa.Table:
    """For a bucket: of each block, its sets and how many of their hashes sets of other classes have too.  Digests pass."""
    if table.column("bucket")[0].as_py() < 0:
        empty = pa.array([None] * table.num_rows, pa.binary())
        return pa.table([table.column("block"), table.column("owners"), empty, empty], names=["block", "head", "owners", "counts"])
    hashes = [np.frombuffer(x.as_buffer(), np.uint32) for x in table.column("hashes")]
    owners = [np.frombuffer(x.as_buffer(), np.uint16) for x in table.column("owners")]
    kinds = []
    for own, x in zip(owners, table.column("classes"), strict=True):
        there = np.unique(own)
        of = np.append(np.frombuffer(x.as_buffer(), _U), _U(0))  # the last for SEVERAL
        kinds.append(of[np.minimum(np.searchsorted(there, own), len(of) - 1)])
    one, kind, several = np.concatenate(hashes), np.concatenate(kinds), np.concatenate(owners) == SEVERAL
    order = np.argsort(one, kind="stable")
    ranked = one[order]
    cuts = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))
    kind = kind[order]
    shared = (np.minimum.reduceat(kind, cuts) != np.maximum.reduceat(kind, cuts)) | np.maximum.reduceat(several[order], cuts)
    twice = np.zeros(len(one), bool)
    twice[order] = np.repeat(shared, np.diff(np.append(cuts, len(one))))
    twice &= ~several
    out, at = ([], []), 0
    for own in owners:
        there, counts = np.unique(own[twice[at : at + len(own)]], return_counts=True)
        out[0].append(there.tobytes())
        out[1].append(counts.astype(np.int32).tobytes())
        at += len(own)
    del one, order, ranked, kind, several, shared, twice, hashes, kinds
    trim()
    return pa.table([table.column("block"), pa.array([None] * len(owners), pa.binary()), pa.array(out[0], pa.binary()), pa.array(out[1], pa.binary())], names=["block", "head", "owners", "counts"])


def _summed(table: pa.Table) -> pa.Table:
    """A block's documents with their digests and counts."""
    head = np.frombuffer(next(x for x in table.column("head") if x.is_valid).as_buffer(), _U).reshape(5, -1)
    shared = head[4].view(np.int64).copy()
    for own, counts in zip(table.column("owners"), table.column("counts"), strict=True):
        if own.is_valid:
            shared[np.frombuffer(own.as_buffer(), np.uint16)] += np.frombuffer(counts.as_buffer(), np.int32)
    return pa.table([*(head[i].view(np.int64) for i in range(4)), shared], names=["id", "n", "h1", "h2", "shared"])


def digests(rows: DataFrame, width: int = SHINGLE) -> DataFrame:
    """(id, n, h1, h2, shared) for rows (id, text): set size, 128-bit digest of the set, and for one row at least of each class how many
    shingles other classes have (at least)."""
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(8, math.ceil(size / BUCKET_BYTES))
    packed = rows.mapInArrow(trimmed(_blocks(buckets, width)), "block string, bucket int, owners binary, hashes binary, classes binary")
    counted = packed.groupBy("bucket").applyInArrow(_repeated, "block string, head binary, owners binary, counts binary")
    return counted.groupBy("block").applyInArrow(_summed, "id long, n long, h1 long, h2 long, shared long")


def _band(size: int) -> int:
    """Bands of sizes [low, 4/3 low): b for low = ceil((4/3) ** b)."""
    b = max(0, int(math.log(size) / math.log(DEN / NUM)))
    while math.ceil((DEN / NUM) ** b) > size:
        b -= 1
    while math.ceil((DEN / NUM) ** (b + 1)) <= size:
        b += 1
    return b


def signatures(items: np.ndarray, band: int, seed: int = 0, empty: bool = False) -> tuple[np.ndarray, bool]:
    """PartEnum signatures of a set for pairs whose smaller set lies in the band, and whether they are sure to meet any partner's.

    Such a pair with sizes a <= b has b <= 4a/3, and similarity 3/4 means a symmetric difference of at most (a + b) / 7,
    so at most k = high / 3 for the band's largest size.  The domain is hashed to groups of three parts; the projection of the set
    on two of the three is a signature.  A group of which two parts or more hold shingles has an agreeing projection that is not
    empty unless two differences fall into it, one with a single such part unless one does.  So where these numbers add up
    to more than k, some agreeing projection is not empty, whatever the partner.  Then no empty one is needed; nor is it for the partner,
    which has the same projection there.  Two sets of which neither is sure meet in another partition of the domain (``seed``).
    """
    high = math.ceil((DEN / NUM) ** (band + 1)) - 1
    k = high // 3
    n1 = max(1, math.ceil(GROUPS * (k + 1) / 2))
    spread = mix(items ^ _U(0xA0761D6478BD642F + band + (seed << 20)))
    part = ((spread >> _U(20)) % _U(3 * n1)).astype(np.int64)
    sums, full = np.zeros(3 * n1, _U), np.bincount(part, minlength=3 * n1).reshape(n1, 3) > 0
    np.add.at(sums, part, spread)
    sums = sums.reshape(n1, 3)
    out = []
    group = np.arange(n1, dtype=np.uint64) * _U(8) + _U((band << 40) + (seed << 50))
    for s, (a, b) in enumerate(((0, 1), (0, 2), (1, 2))):
        x = mix(mix(group + _U(s)) ^ (sums[:, a] + mix(sums[:, b])))
        out.append(x if empty else x[full[:, a] | full[:, b]])
    return np.concatenate(out), bool(np.minimum(full.sum(axis=1), 2).sum() > k)


def all_signatures(items: np.ndarray, band: int) -> np.ndarray:
    """Signatures by one partition of the domain after the other until they are sure to meet every partner's; few sets need a second.

    One that SEEDS partitions leave unsure, about one in a million, has its empty projections too.
    """
    out = []
    for seed in range(SEEDS):
        found, sure = signatures(items, band, seed)
        if not sure and seed == SEEDS - 1:
            found, _ = signatures(items, band, seed, empty=True)
        out.append(found)
        if sure:
            break
    return np.concatenate(out)


def _signed(batches):
    """Rows (id, set) to rows (sig, space, id, n): each set in its own band and, as the larger of a pair, in the one below."""
    names = ["sig", "space", "id", "n"]
    for batch in batches:
        sigs, spaces, ids, ns = [], [], [], []
        for key, items in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            items = items.values.to_numpy().view(_U)
            own = _band(len(items))
            for band in (own, own - 1):
                if band >= 0:
                    x = all_signatures(items, band)
                    sigs.append(x)
                    spaces.append(np.full(len(x), band, np.int32))
                    ids.append(np.full(len(x), key, np.int64))
                    ns.append(np.full(len(x), len(items), np.int32))
            if sum(map(len, sigs)) > 200_000:
                yield pa.RecordBatch.from_arrays([np.concatenate(sigs).view(np.int64), *map(np.concatenate, (spaces, ids, ns))], names=names)
                sigs, spaces, ids, ns = [], [], [], []
        if sigs:
            yield pa.RecordBatch.from_arrays([np.concatenate(sigs).view(np.int64), *map(np.concatenate, (spaces, ids, ns))], names=names)


def _sets(width: int):
    def run(batches):
        for batch in batches:
            sets = list(shingle_sets(batch.column(1), width))
            ends = np.concatenate([[0], np.cumsum([len(x) for x in sets])]).astype(np.int32)
            values = np.concatenate([*sets, np.zeros(0, _U)]).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(values))], names=["id", "items"])

    return run


def _sized(width: int):
    """Rows (id, text) to rows (id, n_shingles)."""

    def run(batches):
        for batch in batches:
            sizes = pa.array([len(x) for x in shingle_sets(batch.column(1), width)], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), sizes], names=["id", "n_shingles"])

    return run


def linked(left: list[np.ndarray], right: list[np.ndarray], left_of: np.ndarray, right_of: np.ndarray, left_id: np.ndarray, right_id: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest, over components *_of, of the links between two lists of sets; counts of common shingles are exact."""
    sizes = [np.array([len(x) for x in side], np.int64) for side in (left, right)]
    one = [np.concatenate([*side, np.zeros(0, _U)]) for side in (left, right)]
    common = np.intersect1d(one[0], one[1])
    found = np.zeros((len(left), len(right)), np.float32)
    owner, column = [], []
    for side, n in zip(one, sizes, strict=True):
        at = np.searchsorted(common, side)
        at[at == len(common)] = 0
        hit = common[at] == side if len(common) else np.zeros(len(side), bool)
        owner.append(np.repeat(np.arange(len(n)), n)[hit])
        column.append(at[hit])
    order = [np.argsort(c, kind="stable") for c in column]
    step = 4096
    for low in range(0, len(common), step):
        dense = []
        for side, n in enumerate((len(left), len(right))):
            c = column[side][order[side]]
            a, b = np.searchsorted(c, [low, low + step])
            x = np.zeros((n, min(step, len(common) - low)), np.float32)
            x[owner[side][order[side]][a:b], c[a:b] - low] = 1
            dense.append(x)
        found += dense[0] @ dense[1].T
    found = np.rint(found).astype(np.int64)
    union = sizes[0][:, None] + sizes[1][None, :] - found
    rows, cols = np.nonzero((DEN * found >= NUM * union) & (left_of[:, None] != right_of[None, :]))
    parent: dict[int, int] = {}

    def root(x):
        while parent.get(x, x) != x:
            parent[x] = parent.get(parent[x], parent[x])
            x = parent[x]
        return x

    out = []
    for i, j in zip(rows.tolist(), cols.tolist(), strict=True):
        a, b = root(int(left_of[i])), root(int(right_of[j]))
        if a != b:
            parent[a] = b
            out.append((int(left_id[i]), int(right_id[j])))
    return out


def _compared(table: pa.Table) -> pa.Table:
    """The links within a block, or between its two sides where ``side`` says so."""
    ids, of = table.column("id").to_numpy(), table.column("component").to_numpy()
    items = [x.values.to_numpy().view(_U) for x in table.column("items")]
    side = table.column("side").to_numpy()
    if side.any():  # 1: left, 2: right
        a, b = np.flatnonzero(side == 1), np.flatnonzero(side == 2)
    else:  # what lies outside the largest component, with all
        names, counts = np.unique(of, return_counts=True)
        a, b = np.flatnonzero(of != names[counts.argmax()]), np.arange(len(of))
    edges = []
    for low in range(0, len(a) if len(b) else 0, ROWS):
        own = a[low : low + ROWS]
        edges += linked([items[i] for i in own], [items[i] for i in b], of[own], of[b], ids[own], ids[b])
    edges = np.array(edges, np.int64).reshape(-1, 2)
    if len(ids) > ROWS // 2:
        del items
        trim()
    return pa.table([edges[:, 0], edges[:, 1]], names=["a", "b"])


def _compared_in(placed: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b): links between different components within each block."""
    return placed.join(sets, "id").groupBy("space", "hub", "block").applyInArrow(_compared, "a long, b long").distinct()


def _placed(hoods: DataFrame, block_rows: int, block_shingles: int) -> DataFrame:
    """Hoods (space, hub, id, n) of more than one class, dealt in blocks: with blocks and block."""
    volume = hoods.groupBy("space", "hub").agg(F.greatest(F.ceil(F.count("*") / block_rows), F.ceil(F.sum("n") / block_shingles)).cast("int").alias("blocks"), F.count("*").alias("members"))
    volume = written(volume.where("members > 1").select("space", "hub", "blocks"), "volume")
    return looked_up(hoods, volume, ["space", "hub"]).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))


def _known(rows: DataFrame, reached: DataFrame) -> DataFrame:
    """``rows`` (id, ...) with their component so far."""
    return looked_up(rows, reached.withColumnRenamed("node", "id"), ["id"], "left").withColumn("component", F.coalesce("component", "id"))


def _still_open(inner: DataFrame) -> DataFrame:
    """The blocks (space, hub, block) that hold several components."""
    key = ["space", "hub", "block"]
    open_ = inner.groupBy(*key).agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high")
    return inner.join(open_.drop("low", "high"), key, "left_semi")


def _apart(placed: DataFrame, reached: DataFrame, block_rows: int) -> tuple[DataFrame, DataFrame]:
    """Members of hoods of several blocks and components, with the largest component and how many lie outside; and the classes (id) in hoods where these are more than a block."""
    wide = written(_known(placed.where("blocks > 1").select("space", "hub", "block", "blocks", "id"), reached), "wide")
    parts = wide.groupBy("space", "hub", "component").agg(F.count("*").alias("size"))
    main = parts.groupBy("space", "hub").agg(F.max_by("component", F.struct("size", "component")).alias("main"), (F.sum("size") - F.max("size")).alias("odd")).where("odd > 0")
    apart = written(looked_up(wide, written(main, "main"), ["space", "hub"]), "apart")
    return apart, apart.where(F.col("odd") > block_rows).select("id").distinct()


def _across(apart: DataFrame, sets: DataFrame, block_rows: int) -> DataFrame:
    """(a, b): links between what lies outside a hood's largest component, in chunks of a block, and all of the hood, block by block."""
    rows = apart.withColumn("chunks", F.ceil(F.col("odd") / block_rows).cast("int"))
    key, one = ["space", "hub", "block", "chunk"], lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = rows.where("component <> main").withColumn("chunk", F.pmod(F.xxhash64("id", F.lit(1)), F.col("chunks")).cast("int")).withColumn("block", one("blocks"))
    sides = [x.select(*key, "id", "component", F.lit(i).alias("side")) for i, x in ((1, left), (2, rows.withColumn("chunk", one("chunks"))))]
    return sides[0].unionByName(sides[1]).join(sets, "id").groupBy(*key).applyInArrow(_compared, "a long, b long").distinct()


def _by_rare_shingles(ids: DataFrame, sets: DataFrame, block_rows: int, block_shingles: int) -> DataFrame:
    """Hoods of those classes, dealt in blocks, in which any two linked ones meet: round the smallest of all that have a rare shingle in common.

    Of linked sets each has 3/4 of its shingles in the other, so whatever the order of shingles, the first quarter and one more of either hold
    a common one.  Rare ones come first, by their counts among these classes; one of a single class is no place to meet.  So texts that share
    what many share, but are not linked, part here.
    """
    tokens = written(looked_up(sets, ids, ["id"]).select("id", F.size("items").alias("n"), F.explode("items").alias("token")), "tokens")
    counts = tokens.groupBy("token").agg(F.count("*").alias("times")).where("times > 1")
    met = looked_up(tokens, written(counts, "counts"), ["token"])
    first = met.groupBy("id", "n").agg(F.array_sort(F.collect_list(F.struct("times", "token"))).alias("common"))
    lone = F.col("n") - F.size("common")
    length = F.greatest(F.lit(0), F.col("n") - F.ceil(F.col("n") * NUM / DEN).cast("int") + 1 - lone)
    rare = written(first.select("id", "n", F.explode(F.slice("common", 1, length)).alias("t")).select("id", "n", "t.token"), "rare")
    rank = F.struct(F.xxhash64("id").alias("rank"), F.col("id").alias("hub"))
    hubs = rare.groupBy("token").agg(F.min(rank)["hub"].alias("hub"), F.count("*").alias("members")).where("members > 1").select("token", "hub")
    hoods = looked_up(rare, written(hubs, "hubs"), ["token"]).select(F.lit(-1).alias("space"), "hub", "id", "n").distinct()
    return _placed(written(hoods, "hoods"), block_rows, block_shingles)


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = SHINGLE, block_rows: int = BLOCK_ROWS, block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """(id, n_shingles, component_id) for every row: the smallest identifier that links reach.

    Texts link when the Jaccard similarity of their sets of word shingles is 3/4 or more (in whole numbers,
    100 * common >= 75 * union).  A null or empty text, or one without words, has the empty set and no link.  Identifiers
    are longs; rows with a null identifier are returned with their own set size and no component.  Rows of one
    identifier are taken one by one.  Sets are compared by 64-bit hashes of shingles.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(text_col, F.lit("")).alias("text"))
    known = written(digests(rows.where("id IS NOT NULL"), width), "digests")
    classes = known.where("n > 0").groupBy("n", "h1", "h2").agg(F.min("id").alias("class_id"), F.max("shared").alias("shared"))
    classes = written(classes, "classes")
    live = classes.where((F.col("n") > 2) & (F.col("shared") * DEN >= F.col("n") * NUM)).select(F.col("class_id").alias("id"), "n", "h1", "h2")
    texts = looked_up(rows, live.select("id").distinct(), ["id"])
    sets = written(texts.mapInArrow(trimmed(_sets(width)), "id long, items array<long>").where(F.size("items") > 0), "sets")

    signed = written(sets.mapInArrow(trimmed(_signed), "sig long, space int, id long, n int"), "signed")
    rank = F.struct(F.xxhash64("id").alias("rank"), F.col("id").alias("hub"))
    hubs = signed.groupBy("sig").agg(F.min(rank).alias("hub"), F.count("*").alias("members")).where("members > 1").select("sig", F.col("hub.hub").alias("hub"))
    hoods = written(signed.join(hubs, "sig").select("space", "hub", "id", "n").distinct(), "hoods")
    placed = written(_placed(hoods, block_rows, block_shingles), "placed")
    # A block's comparisons include the hub, so that near copies in great number mostly meet there, whatever their block.
    with_hubs = lambda rows: rows.union(rows.select("space", "hub", "block", F.col("hub").alias("id"))).distinct()

    # First each class in one hood only, that of the smallest hub.
    rank = F.struct(F.xxhash64("hub").alias("rank"), "space", "hub", "block")
    single = with_hubs(placed.groupBy("id").agg(F.min(rank).alias("at")).select("at.space", "at.hub", "at.block", "id")).select("*", F.lit(0).alias("side"), F.col("id").alias("component"))
    edges = written(_compared_in(single, sets), "links")
    reached = components(edges, spark)
    # Then all hoods' blocks that still hold several components.
    inner = _known(with_hubs(placed.select("space", "hub", "block", "id")), reached).select("space", "hub", "block", "id", F.lit(0).alias("side"), "component")
    inner = _still_open(written(inner, "inner"))
    edges = edges.union(written(_compared_in(inner, sets), "links"))
    reached = components(edges, spark)

    # Hoods of several blocks: the few that lie outside the largest component against all blocks.  Where they are more than a block the hood says
    # little of its members, so these gather anew by their rare shingles; what is wide and apart even there is compared block by block.
    apart, crowded = _apart(placed, reached, block_rows)
    more = [written(_across(apart.where(F.col("odd") <= block_rows), sets, block_rows), "links")]
    if crowded.limit(1).count():
        again = written(_by_rare_shingles(crowded, sets, block_rows, block_shingles), "again")
        inner = _known(with_hubs(again.select("space", "hub", "block", "id")), reached).select("space", "hub", "block", "id", F.lit(0).alias("side"), "component")
        more.append(written(_compared_in(_still_open(written(inner, "inner")), sets), "links"))
        if again.where("blocks > 1").limit(1).count():
            apart, _ = _apart(again, components(reduce(DataFrame.union, more, edges), spark), block_rows)
            more.append(written(_across(apart, sets, block_rows), "links"))
    found = reduce(DataFrame.union, more)
    if found.limit(1).count():
        reached = components(edges.union(found), spark)

    reached = reached.select(F.col("node").alias("class_id"), F.col("component").alias("reached"))
    final = written(looked_up(classes.select("n", "h1", "h2", "class_id"), reached, ["class_id"], "left"), "final")
    final = final.select("n", "h1", "h2", F.coalesce("reached", "class_id").alias("component_id"))
    full = looked_up(known.where("n > 0").select("id", "n", "h1", "h2"), final, ["n", "h1", "h2"])
    full = full.select("id", F.col("n").alias("n_shingles"), "component_id")
    bare = known.where("n = 0").select("id", F.lit(0).cast("long").alias("n_shingles"), F.col("id").alias("component_id"))
    unnamed = rows.where("id IS NULL").mapInArrow(trimmed(_sized(width)), "id long, n_shingles long").withColumn("component_id", F.lit(None).cast("long"))
    return full.unionByName(bare).unionByName(unnamed).withColumnRenamed("id", id_col)


def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set size and component of every document; nulls, repeats and short texts as in ``near_groups``."""
    return near_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS x FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL),
l AS MATERIALIZED (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
e AS MATERIALIZED (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(doc_id, low) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.low)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, min(r.low) AS component_id FROM documents d JOIN r ON r.doc_id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY d.doc_id, n.n
"""
