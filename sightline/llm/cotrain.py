"""Quality classification by co-training a text view and a page-metadata view."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import draw, looked_up, small_batches, written
from .words import PIECE, buffers, runs, word_hashes

#: Hashed byte trigrams of the text view; of the page view hashed metadata, and the measures of the page's shape that follow them.
GRAMS = 1 << 14
META, SHAPES = 1 << 12, 10
#: Labelled documents of a class that the fit expects at most (thinned by a hash), and pseudo-labels of a class that a view gives in a round.
PER_CLASS, PSEUDO = 1000, 300
ROUNDS, SURE = 2, 0.95
EPOCHS, BATCH, RATE, L2, SCALE = 15, 32, 0.3, 1e-4, 40.0
KEEP = 0.5

_kinds = np.zeros((6, 256), np.uint8)
_kinds[0, 65:91] = 1
_kinds[1, 48:58] = 1
_kinds[2, [i for i in range(33, 127) if not chr(i).isalnum() and chr(i) not in ".,;:'\"-()"]] = 1
_kinds[3, [0x20, 9, 10, 11, 12, 13]] = 1
_kinds[4, 10] = 1
_kinds[5, [ord(c) for c in "/@:"]] = 1


def _pieces(column: pa.Array):
    """(first row, offsets, bytes, trigram buckets) of runs of rows; a very long text comes in several, which overlap by two bytes."""
    data, offsets = buffers(column)
    for first, end in runs(offsets):
        low, high = int(offsets[first]), int(offsets[end])
        step = high - low if end - first > 1 else PIECE
        for at in range(low, max(high, low + 1), max(step, 1)):
            part = data[at : min(at + step + 2, high)].astype(np.uint32)
            code = part[:-2] | part[1:-1] << np.uint32(8) | part[2:] << np.uint32(16) if len(part) > 2 else np.zeros(0, np.uint32)
            yield first, np.clip(offsets[first : end + 1] - at, 0, len(part)), part[: min(step, high - at)], (code * np.uint32(0x9E3779B1)) >> np.uint32(18)


def _sums(values: np.ndarray, offsets: np.ndarray, short: int = 0) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values, dtype=np.float64)])
    begin = np.minimum(offsets[:-1], len(values))
    return total[np.clip(offsets[1:] - short, begin, len(values))] - total[begin]


def shapes(column: pa.Array) -> np.ndarray:
    """Measures of each page's shape, about between 0 and 1: kinds of signs, lines, signs of links, length, and how words repeat; nothing of what it says."""
    n = len(column)
    sizes = np.diff(buffers(column)[1])
    counts, words, distinct = np.zeros((6, n)), np.zeros(n), np.zeros(n)
    for first, offsets, part, _ in _pieces(column):
        for k in range(len(_kinds)):
            counts[k, first : first + len(offsets) - 1] += _sums(_kinds[k][part], offsets)
    for first, _, hashes, bounds in word_hashes(column):
        for i, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
            words[first + i] = b - a
            distinct[first + i] = len(np.unique(hashes[a:b]))
    share = counts / np.maximum(sizes, 1)
    mean = (sizes - counts[3]) / np.maximum(words, 1)
    return np.stack([share[0], share[1], 4 * share[2], share[3], np.log1p(sizes) / 12, np.sqrt(words / np.maximum(distinct, 1)) / 4, distinct / np.maximum(words, 1), np.minimum(mean, 30) / 15, np.minimum(20 * share[4], 2), np.minimum(20 * share[5], 2)], axis=1)


def text_vectors(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """(features, values) of each text: shares of trigrams."""
    n = len(column)
    counts: list = [0] * n
    for first, offsets, _, grams in _pieces(column):
        for i in range(len(offsets) - 1):
            own = grams[offsets[i] : max(offsets[i + 1] - 2, offsets[i])]
            counts[first + i] = counts[first + i] + np.bincount(own, minlength=GRAMS)
    out = []
    for c in counts:
        c = c + np.zeros(GRAMS)
        hit = np.flatnonzero(c)
        out.append((hit.astype(np.int32), (SCALE * c[hit] / max(c.sum(), 1)).astype(np.float32)))
    return out


def text_logits(column: pa.Array, weights: np.ndarray) -> np.ndarray:
    """weights (features and a bias) applied to the vectors of ``text_vectors``, which need not be made for that."""
    sums, grams_of = np.zeros(len(column)), np.zeros(len(column))
    for first, offsets, _, grams in _pieces(column):
        own = slice(first, first + len(offsets) - 1)
        sums[own] += _sums(weights[:GRAMS][grams], offsets, 2)
        grams_of[own] += np.clip(np.diff(np.minimum(offsets, len(grams) + 2)) - 2, 0, None)
    return SCALE * sums / np.maximum(grams_of, 1) + weights[-1]


def page_vectors(column: pa.Array, metas: list[list[int]], shape: bool = True) -> list[tuple[np.ndarray, np.ndarray]]:
    """(features, values) of each page: its hashed metadata, then its shape if wanted."""
    if not shape:
        return [(np.array(m, np.int32), np.ones(len(m), np.float32)) for m in metas]
    return [(np.concatenate([m, META + np.arange(SHAPES)]).astype(np.int32), np.concatenate([np.ones(len(m)), own]).astype(np.float32)) for m, own in zip(metas, shapes(column), strict=True)]


def page_logits(column: pa.Array, metas: pa.Array, weights: np.ndarray) -> np.ndarray:
    if not len(column):
        return np.zeros(0)
    return weights[metas.flatten().to_numpy()].reshape(len(column), -1).sum(axis=1) + shapes(column) @ weights[META:-1] + weights[-1]


def fitted(features: list[np.ndarray], values: list[np.ndarray], y: np.ndarray, weight: np.ndarray, size: int) -> np.ndarray:
    """Logistic regression by adaptive gradients; classes weigh alike.  The last weight is the bias."""
    w, squares = np.zeros(size + 1), np.full(size + 1, 1e-3)
    if not 0 < y.sum() < len(y):
        return w
    weight = weight * np.where(y > 0, len(y) / (2 * y.sum()), len(y) / (2 * (len(y) - y.sum())))
    random = np.random.Generator(np.random.PCG64(5))
    for _ in range(EPOCHS):
        for rows in np.array_split(random.permutation(len(y)), max(1, math.ceil(len(y) / BATCH))):
            own, v = np.concatenate([features[r] for r in rows]), np.concatenate([values[r] for r in rows])
            at = np.repeat(np.arange(len(rows)), [len(features[r]) for r in rows])
            x = np.bincount(at, w[own] * v, len(rows)) + w[-1]
            g = (1 / (1 + np.exp(-np.clip(x, -30, 30))) - y[rows]) * weight[rows] / len(rows)
            grad = np.bincount(own, g[at] * v, size + 1)
            grad[-1] = g.sum()
            grad += L2 * w
            squares += grad**2
            w -= RATE * grad / np.sqrt(squares)
    return w


def _calibration(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights of a logistic regression on few columns and a bias, by Newton's method with a small ridge; classes weigh alike."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    w[:-1] = 1.0 / (x.shape[1] - 1)
    if not 0 < y.sum() < len(y):
        return w
    weight = np.where(y > 0, len(y) / (2 * y.sum()), len(y) / (2 * (len(y) - y.sum())))
    start = w.copy()
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (weight * (p - y)) + 0.5 * (w - start)
        w = w - np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + 0.5 * np.eye(len(w)), gradient)
    return w


def _vectors(shape: bool):
    """Rows (view, id, y, weight, text, meta) to rows (view, y, weight, features, values)."""

    def run(batches):
        for batch in batches:
            views, metas = batch.column(0).to_pylist(), batch.column(5).to_pylist()
            rows = [t if v == "text" else m for v, t, m in zip(views, text_vectors(batch.column(4)), page_vectors(batch.column(4), metas, shape), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), batch.column(3), pa.array([f for f, _ in rows], pa.list_(pa.int32())), pa.array([x for _, x in rows], pa.list_(pa.float32()))], names=["view", "id", "y", "weight", "features", "values"])

    return run


def _fit(table: pa.Table) -> pa.Table:
    view = table.column("view")[0].as_py()
    table = table.sort_by([("id", "ascending"), ("y", "ascending"), ("weight", "ascending")])
    arrays = [[x.values.to_numpy() for x in table.column(c)] for c in ("features", "values")]
    w = fitted(*arrays, table.column("y").to_numpy(), table.column("weight").to_numpy(), GRAMS if view == "text" else META + SHAPES)
    return pa.table([pa.array([view]), pa.array([w.tobytes()], pa.binary())], names=["view", "w"])


def metadata(*columns: Column) -> Column:
    """Hashed features of a page's metadata: each column's value; a null is a value of its own."""
    return F.array(*(F.pmod(F.xxhash64(F.lit(i), F.coalesce(c.cast("string"), F.lit("\u0000"))), F.lit(META)).cast("int") for i, c in enumerate(columns)))


def co_trained(docs: DataFrame, labels: DataFrame, meta: Column, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS, shape: bool = True) -> DataFrame:
    """(id, text_score, meta_score, score, kept) for every row of ``docs``.

    ``labels`` has rows (id, good boolean).  About PER_CLASS labelled documents of each class, taken by a hash, teach a classifier
    on what the whole text says (trigrams of bytes) and one on the page: its metadata and the shape of the whole page (see ``shapes``; not with ``shape`` false).  In each of ``rounds`` rounds both score all documents, and
    each gives the other the PSEUDO of each class of which it is surest (SURE at least, calibrated) as pseudo-labels of half weight.  A
    fifth of the labelled documents is left out to calibrate either view and their combination; scores are
    probabilities for classes of equal size, and ``kept`` is a score of KEEP or more.

    Every round so scores all documents: what a view is surest of is known only then.  The text view has no part of the metadata or
    the shape, and the page view no word of the text.  An identifier that is taught, held out or given a pseudo-label counts once, by
    the row whose text sorts first by hash, so lessons and held-out rows are as many as labels at most, whatever repeats.

    A null text is empty.  Labels that are null, or contradict each other, are left out.  Rows may repeat and identifiers be null
    (those are scored, never taught).  Without documents of both classes every score is 1/2 and every row is kept.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), meta.alias("meta"))
    known = labels.where("id IS NOT NULL AND good IS NOT NULL").groupBy("id").agg(F.min("good").alias("good"), F.max("good").alias("top")).where("good = top").drop("top")
    known = written(known, "labels")
    sizes = {r["good"]: r["n"] for r in known.groupBy("good").agg(F.count("*").alias("n")).collect()}
    share = F.when(F.col("good"), PER_CLASS / max(1, sizes.get(True, 0))).otherwise(PER_CLASS / max(1, sizes.get(False, 0)))
    u = draw("quality", F.col("id"))
    taught = known.where(u < share).select("id", F.col("good").cast("double").alias("y"), F.lit(1.0).alias("weight"), (draw("held", F.col("id")) < 0.2).alias("held"))
    taught = written(taught, "taught")  # about 2 * PER_CLASS rows
    base = taught.where("NOT held").drop("held").withColumn("view", F.explode(F.array(F.lit("text"), F.lit("meta"))))
    kind = docs.schema[id_col].dataType.simpleString()
    line = lambda c, w: F.col(c) * float(w[0]) + float(w[1])
    pseudo = None
    for number in range(rounds + 1):
        lessons = base if pseudo is None else base.unionByName(pseudo)
        lessons = written(lessons, "lessons")  # 2 * PER_CLASS labels about, and 4 * PSEUDO at most, for each view
        own = looked_up(rows, lessons.select("id").distinct(), ["id"], "left_semi")
        own = own.groupBy("id").agg(F.min_by(F.struct("text", "meta"), F.struct(F.xxhash64("text"), "meta")).alias("row")).select("id", "row.text", "row.meta")
        lessons = own.join(lessons, "id").select("view", "id", "y", "weight", "text", "meta")
        models = lessons.mapInArrow(_vectors(shape), f"view string, id {kind}, y double, weight double, features array<int>, values array<float>").groupBy("view").applyInArrow(_fit, "view string, w binary")
        weights = {"text": np.zeros(GRAMS + 1), "meta": np.zeros(META + SHAPES + 1)}
        weights |= {r["view"]: np.frombuffer(r["w"], np.float64) for r in models.collect()}  # two models
        shared = spark.sparkContext.broadcast(weights)

        def score(batches, shared=shared):
            w = shared.value
            for batch in batches:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(text_logits(batch.column(1), w["text"])), pa.array(page_logits(batch.column(1), batch.column(2), w["meta"]))], names=["id", "text_logit", "meta_logit"])

        scored = written(rows.select("id", "text", "meta").mapInArrow(score, f"id {kind}, text_logit double, meta_logit double"), "scored")
        test = looked_up(scored, taught.where("held").select("id", "y"), ["id"]).groupBy("id", "y").agg(F.min(F.struct("text_logit", "meta_logit")).alias("l"))  # a row for each held label
        test = test.select("y", "l.text_logit", "l.meta_logit").orderBy("y", "text_logit", "meta_logit").toPandas()
        y = test.y.to_numpy()
        ways = {c: _calibration(test[[c]].to_numpy(), y) for c in ("text_logit", "meta_logit")}
        if number == rounds:
            break
        free = scored.where("id IS NOT NULL").join(known.select("id"), "id", "left_anti")
        sure = math.log(SURE / (1 - SURE))
        picks = []
        for giver, taker in (("text_logit", "meta"), ("meta_logit", "text")):
            for sign, y in ((1, 1.0), (-1, 0.0)):
                chance = line(giver, ways[giver]) * sign
                best = free.where(chance >= sure).groupBy("id").agg(F.max(chance).alias("sure")).orderBy(F.desc("sure"), F.xxhash64("id"), "id").limit(PSEUDO)
                picks.append(best.select("id", F.lit(y).alias("y"), F.lit(0.5).alias("weight"), F.lit(taker).alias("view")))
        pseudo = picks[0]
        for p in picks[1:]:
            pseudo = pseudo.unionByName(p)
        pseudo = written(pseudo.distinct(), "pseudo")
    t, m = ways["text_logit"], ways["meta_logit"]
    both = _calibration(np.column_stack([test.text_logit * t[0] + t[1], test.meta_logit * m[0] + m[1]]), y)
    chance = lambda x: 1 / (1 + F.exp(-x))
    out = scored.withColumn("t", line("text_logit", t)).withColumn("m", line("meta_logit", m))
    out = out.withColumn("score", chance(F.col("t") * float(both[0]) + F.col("m") * float(both[1]) + float(both[2])))
    return out.select(F.col("id").alias(id_col), chance(F.col("t")).alias("text_score"), chance(F.col("m")).alias("meta_score"), "score", (F.col("score") >= KEEP).alias("kept"))


def op10_co_training(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of all documents; good: of quality 1 and not toxic.  The page view sees source, language and the page's shape."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    labels = labels.select(F.col("doc_id").alias("id"), ((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0)).alias("good"))
    return co_trained(docs, labels, metadata(F.col("source"), F.col("lang"), F.concat_ws("/", "source", "lang")))
