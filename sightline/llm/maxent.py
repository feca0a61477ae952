"""Language-model scoring: a hashed maximum-entropy model with a class-factored softmax over n-gram and skip features.

Frequent words are the leaves of a tree of classes with BRANCHES ways at each node, the most frequent ones nearest to the root; all other
words form one class, within which they follow their smoothed frequencies.  P(word | history) is the product of P(branch |
node, history) along the word's path.  Each softmax adds up the log-frequencies of the node's branches and rows of hashed
tables, one for each feature of the history: the word before, the word before that (a skip), and both.

What is learned grows with the input: places by words (up to 4 sqrt(tokens) of them and more), depth by their logarithm, and
table rows by sqrt(tokens).

Four passes read the texts: counts, two rounds of training, and scoring.  Training tasks update a copy of the model on their own
documents by adaptive gradients; the rows they touched are averaged, in two levels, so no task gathers all of them, and
tasks take texts of several times the bytes of their updates.  Counts of words are never gathered whole: frequent ones, of
which there are few by definition, are broadcast; the others meet their occurrences bucket by bucket.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, written
from .words import mix, word_hashes

BRANCHES = 32
#: First branches of the root and their number, and the levels below them; by rank, words fill these in turn.  The last branch is all other words.
TIERS = ((0, 16, 1), (16, 8, 2), (24, 5, 3), (29, 1, 4), (30, 1, 5))
OTHER = BRANCHES - 1
#: A word with more than this share of the tokens is frequent (or 1 / (4 sqrt(tokens)), if that is less); so at most as many are broadcast as this has parts.
FREQUENT = 1 << 18
#: Rows of each of the two tables at least.
ROWS = 1 << 13
RATE, STEP, CHUNK, MANY = 0.15, 4096, 1 << 13, 16
#: The first round learns from this share of the documents, so that tasks begin the second from a common model.
FIRST = 0.125
BUCKET_BYTES, BUCKETS = 16 << 20, 8
COUNTED = 1 << 20  # distinct words that a counting task holds
PART, FAN = 256, 128  # table rows of one packed update; updates that one task adds up
TASK_BYTES, LEARNED = 16 << 20, 8  # text of one training task: so much at least, and so many times the bytes of its update
_U = np.uint64
END, START = _U(0x45C7_1A2B_9E3D_55F1), _U(0x1B87_6E5F_03D2_A94C)


def tokens(column: pa.Array):
    """(first row, end row, words' hashes with an end after each row, bounds of the rows)."""
    for first, end, hashes, bounds in word_hashes(column):
        n = end - first
        out = np.empty(len(hashes) + n, _U)
        ends = bounds[1:] + np.arange(n)
        out[ends] = END
        rest = np.ones(len(out), bool)
        rest[ends] = False
        out[rest] = hashes
        yield first, end, out, bounds + np.arange(n + 1)


def _counts(batches):
    """(hash, n) of a task's words, added up as far as memory goes."""
    kept, size = [], 0

    def added():
        words = np.concatenate([w for w, _ in kept])
        order = np.argsort(words)
        words = words[order]
        cuts = np.flatnonzero(np.concatenate([[True], words[1:] != words[:-1]]))
        return words[cuts], np.add.reduceat(np.concatenate([n for _, n in kept])[order], cuts)

    for batch in batches:
        for _, _, found, _ in tokens(batch.column(0)):
            kept.append(np.unique(found, return_counts=True))
            size += len(kept[-1][0])
            if size > COUNTED:
                kept = [added()]
                size = len(kept[0][0])
                if size > COUNTED // 2:
                    yield pa.RecordBatch.from_arrays([kept[0][0].view(np.int64), kept[0][1].astype(np.int64)], names=["hash", "n"])
                    kept, size = [], 0
    if kept:
        words, n = added()
        yield pa.RecordBatch.from_arrays([words.view(np.int64), n.astype(np.int64)], names=["hash", "n"])


def table_rows(total: int) -> int:
    """Rows of a table: the power of two next to the square root of the tokens."""
    return max(ROWS, 1 << math.ceil(math.log2(max(total, 1)) / 2))


def _ordered(flat: np.ndarray) -> np.ndarray:
    """A stable order of numbers below 2**32, 16 bits at a time."""
    order = np.argsort(flat.astype(np.uint16), kind="stable")
    if flat.max(initial=0) > 65_535:
        order = order[np.argsort((flat[order] >> 16).astype(np.uint16), kind="stable")]
    return order


class Model:
    """The words that have a place, the tree of their classes, and the tables."""

    def __init__(self, words: np.ndarray, counts: np.ndarray, total: int, distinct: int):
        order = np.argsort(words)
        self.words, self.counts = words[order], counts[order]
        n = len(words)
        by_rank = np.lexsort((self.words, -self.counts))
        depth = 1 + max((t[2] for t, low in zip(TIERS, self._lows(), strict=True) if n > low), default=0)
        # Of each word and level: the node, and the branch out of it; -1 below its leaf.  Node 0 is the root.
        self.node, self.branch = np.full((depth, n), -1, np.int32), np.zeros((depth, n), np.int8)
        nodes = 1
        for (first, count, more), low in zip(TIERS, self._lows(), strict=True):
            own = by_rank[low : low + count * BRANCHES**more]
            q = np.arange(len(own))
            self.node[0, own], self.branch[0, own] = 0, first + q // BRANCHES**more
            for level in range(1, more + 1) if len(own) else ():
                up = q // BRANCHES ** (more - level + 1)
                self.node[level, own], self.branch[level, own] = nodes + up, q // BRANCHES ** (more - level) % BRANCHES
                nodes += int(up[-1]) + 1
        # Log-frequencies of the branches of each node; what has no word has no chance.
        mass = np.zeros((nodes, BRANCHES))
        for level in range(depth):
            there = self.node[level] >= 0
            np.add.at(mass, (self.node[level][there], self.branch[level][there]), self.counts[there] + 0.1)
        rest = total - int(self.counts.sum()) + 0.1 * (distinct - n + 1)
        self.rest = math.log10(rest)
        mass[0, OTHER] = rest
        with np.errstate(divide="ignore"):
            self.prior = np.maximum(np.log(mass / np.maximum(mass.sum(axis=1, keepdims=True), 1e-300)), -1e9).astype(np.float32)
        self.rows = table_rows(total)
        self.tables = np.zeros((2 * self.rows, BRANCHES), np.float32)

    @staticmethod
    def _lows() -> list[int]:
        """The first rank of each tier."""
        return [0, *np.cumsum([count * BRANCHES**more for _, count, more in TIERS])[:-1].tolist()]

    def looked_up(self, found: np.ndarray) -> np.ndarray:
        """Index of each token among the frequent words, or -1."""
        if not len(self.words):
            return np.full(len(found), -1)
        at = np.searchsorted(self.words, found)
        at[at == len(self.words)] = 0
        return np.where(self.words[at] == found, at, -1)

    def history(self, found: np.ndarray, bounds: np.ndarray) -> list[np.ndarray]:
        """Hashes of the three features of each token's history; histories don't reach past a text's beginning."""
        one, two = np.empty_like(found), np.empty_like(found)
        one[1:], two[2:] = found[:-1], found[:-2]
        begins = bounds[:-1]
        one[begins], two[begins] = START, START
        second = begins[begins + 1 < bounds[1:]] + 1
        two[second] = START
        two[:1], two[1:2] = START, START
        return [mix(one ^ _U(0x3C6EF372FE94F82B)), mix(two ^ _U(0xA54FF53A5F1D36F1)), mix(one * _U(0x9E3779B97F4A7C15) + two)]

    def levels(self, at: np.ndarray, features: list[np.ndarray]):
        """For each level: the tokens that have a branch there, their nodes and branches, and their rows of the tables.

        The root has the first table for itself, the other nodes share the second.
        """
        bits = _U(64 - int(self.rows).bit_length() + 1)
        branch = np.where(at >= 0, self.branch[0][at] if len(self.words) else OTHER, OTHER)
        yield np.arange(len(at)), None, branch, np.stack([(f >> bits).astype(np.int32) for f in features])
        live = np.flatnonzero(at >= 0)
        for level in range(1, len(self.node)):
            live = live[self.node[level][at[live]] >= 0]
            node = self.node[level][at[live]]
            salt = node.astype(_U) * _U(0xD1342543DE82EF95)
            yield live, node, self.branch[level][at[live]], np.stack([(((f[live] + salt) * _U(0x9E3779B97F4A7C15)) >> bits).astype(np.int32) for f in features])

    def sums(self, node: np.ndarray | None, rows: np.ndarray) -> np.ndarray:
        """What the softmax at each node is of; node None: the root."""
        own = self.tables[: self.rows] if node is None else self.tables[self.rows :]
        x = own[rows[0]]
        x += self.prior[0] if node is None else self.prior[node]
        for r in rows[1:]:
            x += own[r]
        x -= x.max(axis=1, keepdims=True)
        return x

    def logs(self, found: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index among the frequent words, log10 of the probability of the word, or of all other words) for each token."""
        features, at = self.history(found, bounds), self.looked_up(found)
        out = np.zeros(len(found))
        for low in range(0, len(found), CHUNK):
            own = slice(low, min(low + CHUNK, len(found)))
            for live, node, branch, rows in self.levels(at[own], [f[own] for f in features]):
                if len(live):
                    x = self.sums(node, rows)
                    right = x[np.arange(len(live)), branch]
                    out[low + live] += (right - np.log(np.exp(x, out=x) @ np.ones(BRANCHES, np.float32))) / math.log(10)
        return at, out

    def learn(self, found: np.ndarray, bounds: np.ndarray, squares: np.ndarray, touched: np.ndarray) -> None:
        """One pass of adaptive gradient steps over a run of texts."""
        features, at = self.history(found, bounds), self.looked_up(found)
        for low in range(0, len(found), STEP):
            own = slice(low, low + STEP)
            for live, node, branch, rows in self.levels(at[own], [f[own] for f in features]):
                if len(live):
                    e = self.sums(node, rows)
                    np.exp(e, out=e)
                    e /= (e @ np.ones(BRANCHES, np.float32))[:, None]
                    e[np.arange(len(live)), branch] -= 1
                    self._moved(rows, e, 0 if node is None else self.rows, squares, touched)

    def _moved(self, rows: np.ndarray, e: np.ndarray, base: int, squares: np.ndarray, touched: np.ndarray) -> None:
        """Each table row used moves against the sum of its gradients."""
        flat = rows.ravel()
        order = _ordered(flat)
        flat = flat[order]
        cuts = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1]]))
        uses = np.diff(np.append(cuts, len(flat)))
        order %= len(e)
        grad = e[order[cuts]]
        # Rows with few uses take their second uses at once, then their third, ...; the others each add up their own.
        live = np.flatnonzero((uses > 1) & (uses <= MANY))
        for k in range(1, MANY):
            if not len(live):
                break
            grad[live] += e[order[cuts[live] + k]]
            live = live[uses[live] > k + 1]
        for i in np.flatnonzero(uses > MANY):
            grad[i] = e[order[cuts[i] : cuts[i] + uses[i]]].sum(axis=0)
        own = flat[cuts] + base
        squares[own] += np.einsum("nb,nb->n", grad, grad) / BRANCHES
        self.tables[own] -= grad * (RATE / np.sqrt(squares[own]))[:, None]
        touched[own] += uses


def _trained(shared):
    """A task's documents to its packed updates: of each table row that it used the place, the change times the number of its uses, and that number."""

    def run(batches):
        model: Model = shared.value
        before = model.tables
        model.tables = before.copy()
        squares, touched = np.full(len(before), 1.0, np.float32), np.zeros(len(before))
        for batch in batches:
            for _, _, found, bounds in tokens(batch.column(0)):
                model.learn(found, bounds, squares, touched)
        change = (model.tables - before) * touched[:, None].astype(np.float32)
        model.tables = before
        task = TaskContext.get().partitionId()
        used = np.flatnonzero(touched)
        cuts = np.searchsorted(used, np.arange(0, len(before) + PART, PART))
        parts = np.flatnonzero(np.diff(cuts))
        for some in np.array_split(parts, max(1, len(parts) // 64)) if len(parts) else ():
            packed = [_packed(used[cuts[p] : cuts[p + 1]] - p * PART, change[used[cuts[p] : cuts[p + 1]]], touched[used[cuts[p] : cuts[p + 1]]]) for p in some]
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array([task // FAN] * len(some), pa.int32()), pa.array(packed, pa.binary())], names=["part", "fan", "packed"])

    return run


def _packed(rows: np.ndarray, change: np.ndarray, uses: np.ndarray) -> bytes:
    return np.column_stack([rows, uses, change]).astype(np.float32).tobytes()


def _added(table: pa.Table) -> pa.Table:
    total = np.zeros((PART, 1 + BRANCHES))
    for x in table.column("packed"):
        one = np.frombuffer(x.as_buffer(), np.float32).reshape(-1, 2 + BRANCHES)
        total[one[:, 0].astype(np.int64)] += one[:, 1:]
    used = np.flatnonzero(total[:, 0])
    return pa.table([table.column("part").slice(0, 1), table.column("fan").slice(0, 1), pa.array([_packed(used, total[used, 1:], total[used, 0])], pa.binary())], names=["part", "fan", "packed"])


def trained(rows: DataFrame, counts: DataFrame, total: int, distinct: int, size: int) -> Model:
    """The model learned from rows (text, u), u a number in [0, 1) that deals documents to rounds; size: the texts' bytes."""
    spark = rows.sparkSession
    parts = max(FREQUENT, math.ceil(4 * math.sqrt(total)))
    few = counts.where(F.col("n") * parts > total).toPandas()  # fewer than parts, as their counts sum to total at most
    model = Model(few.hash.to_numpy(np.int64).view(_U), few.n.to_numpy(np.int64), total, distinct)
    tasks = max(1, size // max(TASK_BYTES, LEARNED * 4 * (2 + BRANCHES) * len(model.tables)))
    schema = "part int, fan int, packed binary"
    for slice_ in (F.col("u") < FIRST, F.col("u") >= FIRST):
        shared = spark.sparkContext.broadcast(model)
        packed = rows.where(slice_).select("text").coalesce(tasks).mapInArrow(_trained(shared), schema).groupBy("part", "fan").applyInArrow(_added, schema)
        packed = packed.withColumn("fan", F.lit(0)).groupBy("part", "fan").applyInArrow(_added, schema)
        tables = model.tables.copy()
        for r in packed.toLocalIterator():  # one model, which grows as the square root of the input
            x = np.frombuffer(r["packed"], np.float32).reshape(-1, 2 + BRANCHES)
            tables[r["part"] * PART + x[:, 0].astype(np.int64)] += x[:, 2:] / x[:, 1:2]
        model.tables = tables
    return model


def _scored(shared, buckets: int):
    """Rows (id, held, text) to a row of sums for each block of texts, and rows of other words' occurrences by bucket."""

    def run(batches):
        model: Model = shared.value
        task, number = TaskContext.get().partitionId(), 0
        logs = np.log10(model.counts + 0.1) if len(model.counts) else np.zeros(1)
        for batch in batches:
            for first, end, found, bounds in tokens(batch.column(2)):
                name, n = f"{task}-{number}", end - first
                number += 1
                at, score = model.logs(found, bounds)
                own = np.where(at >= 0, logs[at], 0.0)
                score += np.where(at < 0, -model.rest, 0.0)  # and log10(c + 0.1) of other words, where their counts are
                begins = bounds[:-1]
                sums = [np.diff(bounds), np.add.reduceat((at >= 0).astype(np.int64), begins), np.add.reduceat(own, begins), np.add.reduceat(score, begins)]
                rare = np.flatnonzero(at < 0)
                owner = (np.searchsorted(bounds, rare, side="right") - 1).astype(np.int32)
                words = found[rare]
                bucket = ((words >> _U(40)) % _U(buckets)).astype(np.int32)
                order = np.argsort(bucket, kind="stable")
                cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
                names, keys = [name], [-1 - number % buckets]
                ids, helds = [batch.column(0).slice(first, n)], [batch.column(1).slice(first, n)]
                packed, owners = [np.stack(sums).astype(np.float64).tobytes()], [b""]
                for b in np.flatnonzero(np.diff(cuts)):
                    part = order[cuts[b] : cuts[b + 1]]
                    names.append(name)
                    keys.append(int(b))
                    packed.append(words[part].tobytes())
                    owners.append(owner[part].tobytes())
                lists = [pa.ListArray.from_arrays(pa.array([0] + [n] * len(names), pa.int32()), x[0].cast(k)) for x, k in ((ids, pa.int64()), (helds, pa.bool_()))]
                yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(keys, pa.int32()), pa.array(owners, pa.binary()), pa.array(packed, pa.binary()), *lists], names=["block", "bucket", "owners", "packed", "ids", "held"])

    return run


_PACKED = "block string, bucket int, owners binary, packed binary, ids array<long>, held array<boolean>"


def _met(table: pa.Table, counts: pa.Table) -> pa.Table:
    """A bucket's occurrences with its counts: of each block and text, how many words are known and the sum of log10(c + 0.1).  Blocks' sums pass."""
    if table.num_rows and table.column("bucket")[0].as_py() < 0:
        return table
    words = counts.column("hash").to_numpy().view(_U)
    order = np.argsort(words)
    words, logs = words[order], np.log10(counts.column("n").to_numpy()[order] + 0.1)
    out = []
    for owners, packed in zip(table.column("owners"), table.column("packed"), strict=True):
        owner, found = np.frombuffer(owners.as_buffer(), np.int32), np.frombuffer(packed.as_buffer(), _U)
        known = np.zeros(len(found), bool)
        value = np.full(len(found), -1.0)  # log10(0.1)
        if len(words):
            at = np.searchsorted(words, found)
            at[at == len(words)] = 0
            known = words[at] == found
            value[known] = logs[at[known]]
        out.append(np.stack([np.bincount(owner, known), np.bincount(owner, value)]).tobytes())
    none = pa.array([None] * len(out), pa.list_(pa.int64()))
    return pa.table([table.column("block"), table.column("bucket"), pa.array([None] * len(out), pa.binary()), pa.array(out, pa.binary()), none, none.cast(pa.list_(pa.bool_()))], names=["block", "bucket", "owners", "packed", "ids", "held"])


def _summed(table: pa.Table) -> pa.Table:
    """A block's texts with all their sums."""
    head = next(i for i, b in enumerate(table.column("bucket").to_pylist()) if b < 0)
    sums = np.frombuffer(table.column("packed")[head].as_buffer(), np.float64).reshape(4, -1).copy()
    order = np.argsort(table.column("bucket").to_numpy(), kind="stable")
    for i in order.tolist():
        if i != head:
            x = np.frombuffer(table.column("packed")[i].as_buffer(), np.float64).reshape(2, -1)
            n = x.shape[1]
            sums[1, :n] += x[0]
            sums[2:, :n] += x[1]
    ids, held = (table.column(c)[head].values for c in ("ids", "held"))
    return pa.table([ids, held, sums[0].astype(np.int64), np.rint(sums[1]).astype(np.int64), sums[2], sums[3]], names=["id", "held", "n_tokens", "n_known", "base", "score"])


def scored(docs: DataFrame, held: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row of ``docs``; the rest of the rows is learned from.

    Words are runs of bytes other than white space after lower-casing A-Z, by 64-bit hash, and every text ends with an end
    token.  base_score is the text's log10 probability under smoothed word frequencies (0.1 added to each count and one
    unknown word), score that under the model.  A null text is empty: one end.  Identifiers are cast to long and may repeat or
    be null; a null condition counts as not held.  With nothing to learn from all words are unknown.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(held, F.lit(False)).alias("held"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    learn = rows.where("NOT held").select("text", (F.pmod(F.xxhash64("id", F.lit("round")), F.lit(1 << 20)) / (1 << 20)).alias("u"))
    counts = learn.select("text").mapInArrow(_counts, "hash long, n long").groupBy("hash").agg(F.sum("n").alias("n"))
    counts = written(counts, "counts")
    known = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.count("*").alias("distinct")).first()
    total, distinct = known["total"], known["distinct"]
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    model = trained(learn, counts, total, distinct, size)
    buckets = max(BUCKETS, math.ceil(size / BUCKET_BYTES))
    packed = rows.mapInArrow(_scored(spark.sparkContext.broadcast(model), buckets), _PACKED)
    other = counts.where(F.col("n") * max(FREQUENT, math.ceil(4 * math.sqrt(total))) <= total).withColumn("bucket", F.pmod(F.shiftrightunsigned("hash", 40), F.lit(buckets)).cast("int"))
    met = packed.groupBy("bucket").cogroup(other.groupBy("bucket")).applyInArrow(_met, _PACKED)
    sums = met.groupBy("block").applyInArrow(_summed, "id long, held boolean, n_tokens long, n_known long, base double, score double")
    return sums.select(
        F.col("id").alias(id_col), F.col("held").alias("held_out"), "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") - F.col("n_tokens") * F.lit(math.log10(total + 0.1 * (distinct + 1)))).alias("base_score"), "score",
    )


def op7_maxent_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents, learned from nine tenths of them; nulls, repeats and an empty table as in ``scored``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return scored(docs, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 == 0)
