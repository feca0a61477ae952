"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams."""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .chargrams import gram_buckets, sums_by_row
from .common import draw, looked_up, small_batches, trimmed, written

BITS = 15
ORDERS = (1, 2, 3)
#: Labelled texts that the fit expects at most, of a language and of all; more are thinned by a hash of language and text.
PER_LANGUAGE, SAMPLE = 1000, 50_000
EPOCHS = 4
BATCH = 32
#: Follow-the-regularised-leader: step, smoothing, and the two penalties of the elastic net.
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.02, 0.5
#: TF-IDF rows sum to about this much, so that steps and penalties have a fixed meaning.
SCALE = 40.0
UND = "und"
_sign = re.compile(r"[^\W\d_]")


def has_letter(text: str | None) -> bool:
    """Whether a text holds a character of the general category L; numbers as signs (², ½, Ⅷ, ①) are none."""
    return text is not None and any(m.group().isalpha() for m in _sign.finditer(text))


def softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(axis=1, keepdims=True))
    return x / x.sum(axis=1, keepdims=True)


def _document_counts(batches):
    """In how many texts of the partition each bucket occurs; the number of texts stands under bucket -1."""
    seen, n = np.zeros(1 << BITS, np.int64), 0
    mask = np.zeros(1 << BITS, bool)
    for batch in batches:
        row = -1
        for rows, buckets in gram_buckets(batch.column(0).to_pylist(), ORDERS, BITS):
            cuts = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
            for a, b in zip(cuts, [*cuts[1:], len(rows)], strict=True):
                if rows[a] != row:  # a long text goes on in the next piece
                    seen += mask
                    mask[:] = False
                    row = rows[a]
                mask[buckets[a:b]] = True
        seen += mask
        mask[:] = False
        n += batch.num_rows
    own = np.flatnonzero(seen)
    if n:
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([[-1], own]).astype(np.int32)), pa.array(np.concatenate([[n], seen[own]]))], names=["bucket", "df"])


def _vectors(batches):
    """(lang, u, buckets, shares): a text's distinct buckets and the share of its n-grams that each has."""
    for batch in batches:
        texts, parts = batch.column(1).to_pylist(), {}
        for rows, buckets in gram_buckets(texts, ORDERS, BITS):
            cuts = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
            for a, b in zip(cuts, [*cuts[1:], len(rows)], strict=True):
                parts.setdefault(int(rows[a]), []).append(np.bincount(buckets[a:b], minlength=1 << BITS))
        own, shares = [], []
        for i in range(len(texts)):
            counts = sum(parts.pop(i))
            hit = np.flatnonzero(counts)
            own.append(hit.astype(np.int32))
            shares.append((counts[hit] / counts.sum()).astype(np.float32))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(own, pa.list_(pa.int32())), pa.array(shares, pa.list_(pa.float32()))], names=["lang", "u", "buckets", "shares"])


def fitted(labels: list[str], u: np.ndarray, buckets: list[np.ndarray], shares: list[np.ndarray], idf: np.ndarray, classes: list[str]) -> tuple[np.ndarray, np.ndarray, float]:
    """(weights, bias, temperature).  Of 50 texts and more, every fifth, by u, is left for the temperature, if these are 20; else it follows the texts learned."""
    place = {c: i for i, c in enumerate(classes)}
    y = np.array([place[x] for x in labels])
    k = len(classes)
    values = [s * idf[b] * SCALE for b, s in zip(buckets, shares, strict=True)]
    z, n = np.zeros((len(idf) + 1, k)), np.zeros((len(idf) + 1, k))  # the last row is the bias
    w = np.zeros_like(z)
    held = (np.floor(u * 1e6).astype(np.int64) % 5 == 0) if len(u) >= 50 else np.zeros(len(u), bool)
    learn = np.flatnonzero(~held)
    rate = np.bincount(y[learn], minlength=k).clip(1)
    weight = len(learn) / (k * rate)  # languages weigh alike
    random = np.random.Generator(np.random.PCG64(11))

    def logits(rows):
        out = np.empty((len(rows), k))
        for i, r in enumerate(rows):
            out[i] = values[r] @ w[buckets[r]] + w[-1]
        return out

    for _ in range(EPOCHS):
        for rows in np.array_split(random.permutation(learn), max(1, math.ceil(len(learn) / BATCH))):
            g = softmax(logits(rows))
            g[np.arange(len(rows)), y[rows]] -= 1
            g *= weight[y[rows]][:, None]
            own = np.concatenate([*(buckets[r] for r in rows), [len(idf)]])
            flow = np.concatenate([*(values[r][:, None] * g[i] for i, r in enumerate(rows)), g.sum(axis=0, keepdims=True)])
            order = np.argsort(own, kind="stable")
            cuts = np.flatnonzero(np.concatenate([[True], np.diff(own[order]) != 0]))
            touched, grad = own[order][cuts], np.add.reduceat(flow[order], cuts, axis=0) / len(rows)
            after = n[touched] + grad**2
            z[touched] += grad - (np.sqrt(after) - np.sqrt(n[touched])) / ALPHA * w[touched]
            n[touched] = after
            shrunk = np.sign(z[touched]) * np.maximum(np.abs(z[touched]) - L1 / len(rows), 0)
            w[touched] = -shrunk / ((BETA + np.sqrt(after)) / ALPHA + L2 / len(rows))
    test = np.flatnonzero(held) if held.sum() >= 20 else learn
    x, best = logits(test), (math.inf, 1.0)
    for t in np.geomspace(0.05, 20, 121):
        p = softmax(x / t)[np.arange(len(test)), y[test]]
        best = min(best, (float(-np.log(np.maximum(p, 1e-12)).mean()), float(t)))
    return w[:-1], w[-1], best[1]


def identified(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", keep: bool = False) -> DataFrame:
    """(id, learned, lang_pred, score, languages) for every row of ``docs``; the model learns where ``learn`` holds and lang is not null.

    Document frequencies count every text that may be learned from, repeated ones too; the fit itself takes about PER_LANGUAGE
    different texts of every language that occurs, fewer if that made more than SAMPLE in all, chosen by a hash of language and
    text, and runs in one task, which takes 1 MB a language; what tasks that predict get is 128 kB a language.  Prediction
    reads the whole text and nothing else.  ``score`` is the calibrated probability of lang_pred; how sure the model may be is
    read from texts left out of the fit, or from all if there are under 50.  A null text, one without a letter, and any text if
    nothing could be learned get ``und`` and score 0.  ``languages`` is the number learned.  With ``keep`` the columns of ``docs``
    (any names) come along as a struct ``row``, so that a decision needs no join.  Ties go to the language that sorts first.  Rows may repeat and identifiers be null.
    """
    spark = docs.sparkSession
    small_batches(spark)
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns)) if keep else F.struct(F.lit(0).alias("none"))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), F.coalesce(learn, F.lit(False)).alias("learn"), whole.alias("row"))
    known = rows.where("learn AND lang IS NOT NULL AND text IS NOT NULL")
    known = known.withColumn("print", F.xxhash64("text"))
    sizes = written(known.groupBy("lang", "print").agg(F.count("*").alias("n")).groupBy("lang").agg(F.count("*").alias("texts")), "languages")
    classes = sorted(r["lang"] for r in sizes.select("lang").collect())  # a row for each language
    weights, bias, temperature = np.zeros((1 << BITS, len(classes)), np.float32), np.zeros(len(classes)), 1.0
    if classes:
        counts = known.select("text").mapInArrow(trimmed(_document_counts), "bucket int, df long").groupBy("bucket").agg(F.sum("df").alias("df")).toPandas()  # at most 2**BITS + 1 rows
        total = int(counts.df[counts.bucket == -1].sum())
        df = np.zeros(1 << BITS)
        own = counts[counts.bucket >= 0]
        df[own.bucket] = own.df
        idf = np.log((1 + total) / (1 + df)) + 0.1
        wanted = min(PER_LANGUAGE, max(1, SAMPLE // len(classes)))
        u = draw("langid", F.col("lang"), F.col("print"))
        sample = looked_up(known, sizes, ["lang"]).withColumn("u", u).where(F.col("u") * F.col("texts") < wanted)
        sample = sample.groupBy("lang", "print").agg(F.first("text").alias("text"), F.first("u").alias("u"))  # each text once
        sample = sample.select("lang", "text", "u").mapInArrow(trimmed(_vectors), "lang string, u double, buckets array<int>, shares array<float>")

        def fit(table: pa.Table) -> pa.Table:
            table = table.sort_by("u")
            arrays = [[x.values.to_numpy() for x in table.column(c)] for c in ("buckets", "shares")]
            w, b, t = fitted(table.column("lang").to_pylist(), table.column("u").to_numpy(), *arrays, idf, classes)
            return pa.table([pa.array([(w * idf[:, None] * SCALE).astype(np.float32).tobytes()], pa.binary()), pa.array([b.tolist()]), [t]], names=["weights", "bias", "t"])

        model = sample.withColumn("model", F.lit(0)).groupBy("model").applyInArrow(fit, "weights binary, bias array<double>, t double").collect()  # 2**BITS weights a language
        if model:
            weights = np.frombuffer(model[0]["weights"], np.float32).reshape(1 << BITS, -1)
            bias, temperature = np.array(model[0]["bias"]), model[0]["t"]
    shared = spark.sparkContext.broadcast((weights, bias, temperature))

    def predict(batches):
        weights, bias, temperature = shared.value
        for batch in batches:
            texts = batch.column(1).to_pylist()
            n = len(texts)
            sums, grams = np.zeros((n, max(1, len(classes)))), np.zeros(n)
            if classes:
                for r, b in gram_buckets(texts, ORDERS, BITS):
                    sums += sums_by_row(r, weights[b], n)
                    grams += np.bincount(r, minlength=n)
            p = softmax((sums / np.maximum(grams, 1)[:, None] + (bias if classes else 0)) / temperature)
            best = p.argmax(axis=1)
            out = [bool(classes) and has_letter(t) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array([classes[i] if ok else UND for i, ok in zip(best, out, strict=True)]), pa.array([float(p[j, i]) if ok else 0.0 for j, (i, ok) in enumerate(zip(best, out, strict=True))])],
                names=["id", "learn", "lang_pred", "score"],
            ).append_column("row", batch.column(3))

    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("learn", T.BooleanType()), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), rows.schema["row"]])
    done = rows.select("id", "text", "learn", "row").mapInArrow(trimmed(predict), schema).withColumn("languages", F.lit(len(classes)))
    return (done if keep else done.drop("row")).withColumnsRenamed({"id": id_col, "learn": "learned"})


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from those that are not held out; nulls and repeats as in ``identified``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return identified(docs, ~held_out()).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
