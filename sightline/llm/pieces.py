"""SentencePiece encoding and decoding: sampled segmentations by forward filtering and backward sampling."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import small_batches, trimmed
from .words import _power, mix

#: Vocabulary file; a parameter of every function here.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE, LITERAL = 0x2581, 0x110000  # the mark of a space, and what stands for that character in a text
#: Characters worked on at a time; a longer text is cut at beginnings of words.
PIECE = 1 << 20
_U = np.uint64
_BASE, _INVERSE = _U(0x9E3779B97F4A7C15), _U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_CHAR, _TABLE = _U(0xD6E8FEB86659FD93), 17


@dataclass
class Vocabulary:
    """What tasks need of a model: the bytes of every piece, and hashed pieces with their log-probabilities."""

    content: list[bytes]
    byte_ids: np.ndarray
    single: np.ndarray
    slots: np.ndarray
    hashes: np.ndarray
    ids: np.ndarray
    logs: np.ndarray
    longest: int


def _prefix(codes: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(codes) + 1, _U)
    np.cumsum(mix(codes.astype(_U) * _CHAR) * _power(_BASE, len(codes))[: len(codes)], out=sums[1:])
    return sums


def _places(h: np.ndarray) -> list[np.ndarray]:
    return [(h >> _U(64 - _TABLE)).astype(np.int64), ((h * _CHAR) >> _U(64 - _TABLE)).astype(np.int64) + (1 << _TABLE)]


def vocabulary(path: str = MODEL) -> Vocabulary:
    """Reads a model on the driver; tasks get it by broadcast (about 2 MB), so they need no file.

    A model with log-probabilities is taken as it is.  One of merges holds only ranks; there a piece of rank r has the
    Zipf log-probability -ln(r + 2) less a constant.  Characters without a piece of their own become bytes.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    n = model.get_piece_size()
    scores = np.array([model.get_score(i) for i in range(n)])
    usual = [i for i in range(n) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
    ranked = all(float(scores[i]).is_integer() for i in usual)
    content, byte_ids = [], np.zeros(256, np.int32)
    for i in range(n):
        piece = model.id_to_piece(i)
        if model.is_byte(i):
            byte_ids[int(piece[3:5], 16)] = i
            content.append(bytes([int(piece[3:5], 16)]))
        else:
            content.append(b"" if model.is_control(i) or model.is_unknown(i) else piece.replace("▁", " ").encode())
    codes = {i: np.frombuffer(model.id_to_piece(i).encode("utf-32-le"), np.uint32) for i in usual}
    single = np.zeros(LITERAL + 1, bool)
    single[[int(c[0]) for c in codes.values() if len(c) == 1]] = True
    # Runs of spaces begin a word, so no piece may hold a space after another character; such pieces are left out.
    fit = [i for i in usual if single[codes[i]].all() and not np.any((codes[i][1:] == SPACE) & (codes[i][:-1] != SPACE))]
    hashes = np.array([_prefix(codes[i])[-1] for i in fit], _U)
    logs = -np.log(-np.minimum(scores[fit], 0) + 2) if ranked else scores[fit].copy()
    logs -= np.log(np.exp(logs - logs.max()).sum()) + logs.max()
    slots = np.full(2 << _TABLE, -1, np.int32)
    first, second = _places(hashes)
    for k in range(len(fit)):  # a cuckoo table: every hash in one of two places
        item, at = k, int(first[k])
        for _ in range(500):
            item, slots[at] = int(slots[at]), item
            if item < 0:
                break
            at = int(first[item]) + int(second[item]) - at
        else:
            raise ValueError("the pieces can't be placed")
    return Vocabulary(content, byte_ids, single, slots, hashes, np.array(fit, np.int32), logs, max(len(codes[i]) for i in fit))


def _found(v: Vocabulary, h: np.ndarray) -> np.ndarray:
    """Index of the piece of each hash, or -1."""
    out = v.slots[(h >> _U(64 - _TABLE)).view(np.int64)]
    bad = np.flatnonzero((v.hashes[out] != h) | (out < 0))
    h = h[bad]
    k = v.slots[((h * _CHAR) >> _U(64 - _TABLE)).view(np.int64) + (1 << _TABLE)]
    out[bad] = np.where((v.hashes[k] == h) & (k >= 0), k, -1)
    return out


def _lattice(v: Vocabulary, codes: np.ndarray, ends: np.ndarray, sharpness: float):
    """Forward filtering over distinct words, laid end to end: each node's first edge, and (bounds, from-node, piece) of the edges, sorted by the node they end in.

    Word w has the nodes ends[w] + w .. ends[w + 1] + w + 1.  bounds are the cumulated probability of a node's edges.
    """
    sizes = np.diff(ends)
    word = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
    at = np.arange(len(codes), dtype=np.int32)
    left = ends[1:].astype(np.int32)[word] - at
    sums, inverse = _prefix(codes), _power(_INVERSE, len(codes))
    starts, lengths, pieces = [], [], []
    for n in range(1, min(v.longest, int(sizes.max(initial=0))) + 1):
        at = at[left[at] >= n] if n > 1 else at
        k = _found(v, (sums[at + n] - sums[at]) * inverse[at])
        hit = np.flatnonzero(k >= 0)
        starts.append(at[hit])
        lengths.append(np.full(len(hit), n, np.int32))
        pieces.append(k[hit])
    start, length, piece = np.concatenate(starts), np.concatenate(lengths), np.concatenate(pieces)
    order = np.argsort(start + word[start] + length, kind="stable")
    start, length, piece = start[order], length[order], piece[order]
    source = start + word[start]
    target = source + length
    depth = start - ends[:-1].astype(np.int32)[word[start]] + length
    deepest = int(sizes.max(initial=0))
    order = np.argsort(depth.astype(np.uint16 if deepest < 1 << 16 else np.int64), kind="stable")
    cuts = np.searchsorted(depth[order], np.arange(1, deepest + 2))
    weight = v.logs[piece] * sharpness
    alpha = np.zeros(len(codes) + len(sizes))
    chance = np.empty(len(order))
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        own = order[a:b]
        to = target[own]
        fresh = np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1]]))
        value = alpha[source[own]] + weight[own]
        total = np.logaddexp.reduceat(value, fresh)
        alpha[to[fresh]] = total
        chance[own] = np.exp(value - np.repeat(total, np.diff(np.append(fresh, b - a))))
    fresh = np.flatnonzero(np.concatenate([[True], target[1:] != target[:-1]]))
    counts = np.diff(np.append(fresh, len(target)))
    run = np.cumsum(chance)
    bounds = run - np.repeat((run - chance)[fresh], counts)
    bounds[fresh + counts - 1] = 1.0
    first = np.zeros(len(alpha), np.int32)
    first[target[fresh]] = fresh
    return first, bounds, source, piece


def _encoded(v: Vocabulary, texts: list[str], keys: np.ndarray, sharpness: float) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all pieces, the rows' bounds) of some texts; keys: a uint64 for each row."""
    parts = [np.frombuffer((" " + t).encode("utf-32-le", "surrogatepass"), np.uint32) for t in texts]
    sizes = np.array([len(p) for p in parts], np.int64)
    codes = np.concatenate(parts).copy() if parts else np.zeros(0, np.uint32)
    codes[codes == SPACE] = LITERAL
    codes[codes == 0x20] = SPACE
    rows = np.concatenate([[0], np.cumsum(sizes)])
    owner = np.repeat(np.arange(len(texts), dtype=np.int32), sizes)
    known = v.single[codes]
    new = np.ones(len(codes), bool)
    new[1:] = ~known[1:] | ~known[:-1] | ((codes[1:] == SPACE) & (codes[:-1] != SPACE))
    new[rows[:-1]] = True
    begin = np.flatnonzero(new)
    size = np.diff(np.append(begin, len(codes)))
    plain = known[begin]
    begin, size = begin[plain], size[plain]
    # One lattice for each distinct word.
    sums, inverse = _prefix(codes), _power(_INVERSE, len(codes))
    h = mix((sums[begin + size] - sums[begin]) * inverse[begin]) ^ (size.astype(_U) * _CHAR)
    _, first, kind = np.unique(h, return_index=True, return_inverse=True)
    ends = np.concatenate([[0], np.cumsum(size[first])])
    take = np.repeat(begin[first] - ends[:-1], size[first]) + np.arange(ends[-1])
    chosen = np.full(len(codes), -1, np.int32)
    if len(first):
        edges_of, bounds, source, piece = _lattice(v, codes[take], ends, sharpness)
        base = (ends[:-1] + np.arange(len(first))).astype(np.int32)[kind]  # the first node of each word's lattice
        node, at = base + size.astype(np.int32), begin.astype(np.int32) - base
        salt = keys - rows[:-1].astype(_U) * _BASE  # draws depend on the place in the row
        salt = salt[owner[begin]]
        while len(node):
            u = (mix(salt + (node + at).astype(_U) * _BASE) >> _U(11)).astype(np.float64) / (1 << 53)
            edge = edges_of[node]
            wait = np.flatnonzero(bounds[edge] <= u)
            while len(wait):
                edge[wait] += 1
                wait = wait[bounds[edge[wait]] <= u[wait]]
            node = source[edge]
            chosen[node + at] = v.ids[piece[edge]]
            more = node > base
            node, at, base, salt = node[more], at[more], base[more], salt[more]
    odd = np.flatnonzero(~known)
    real = np.where(codes[odd] == LITERAL, np.uint32(SPACE), codes[odd]).astype(np.uint32)
    count = (chosen >= 0).astype(np.int64)
    count[odd] = 1 + (real > 0x7F) + (real > 0x7FF) + (real > 0xFFFF)
    upto = np.concatenate([[0], np.cumsum(count)])
    out = np.empty(upto[-1], np.int32)
    out[upto[:-1][chosen >= 0]] = chosen[chosen >= 0]
    if len(odd):
        raw = np.frombuffer(real.tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass"), np.uint8)
        spots = np.repeat(upto[odd] - np.concatenate([[0], np.cumsum(count[odd])])[:-1], count[odd]) + np.arange(len(raw))
        out[spots] = v.byte_ids[raw]
    return out, upto[rows]


_word = re.compile(r"(?<! ) ")


def _cut(texts: list[str | None], keys: np.ndarray, piece: int) -> Iterator[tuple[list[int], list[str], np.ndarray]]:
    """Runs of (rows, parts of their texts, keys), of about ``piece`` characters; a part that begins within a row has the key moved on to its place."""
    rows, parts, own, size = [], [], [], 0
    for row, text in enumerate(texts):
        text, at, moved = text or "", 0, 0
        while True:
            next_ = _word.search(text, at + piece) if len(text) - at > piece else None
            part = text[at : next_.start()] if next_ else text[at:]
            if parts and size + len(part) > piece:
                yield rows, parts, np.array(own, _U)
                rows, parts, own, size = [], [], [], 0
            rows.append(row)
            parts.append(part)
            own.append((int(keys[row]) + moved * int(_BASE)) % (1 << 64))
            size += len(part)
            if not next_:
                break
            at, moved = next_.end(), next_.end()  # the space that begins the word is the one put before every part
    if parts:
        yield rows, parts, np.array(own, _U)


def encoded(docs: DataFrame, key: str = "doc_id", text_col: str = "text", seed: int = 3, sharpness: float = 1.0, model: str = MODEL, ids: str = "piece_ids", decode_as: str | None = None, piece: int = PIECE) -> DataFrame:
    """``docs`` with an array of piece ids, one segmentation of each whole text drawn in proportion to its probability.

    A space becomes part of the piece that follows, behind an added space at the beginning.  Forward filtering sums over all ways to
    reach each position of a word; backward sampling then draws pieces from the word's end, each with its share of
    that sum to the power ``sharpness`` of the pieces' probabilities.  Words are independent, as no piece goes past
    a space, so filtering is done once for each distinct word.  The draws depend on seed, row key and position alone: a row is
    cut alike whatever stands beside it, and rows that share key and text alike.  A null text has no pieces (null); an
    empty one has that of the added space.  A null key draws as one value.  An existing column named ``ids`` is replaced.
    Texts are worked on in parts of about ``piece`` characters, cut at beginnings of words; only a single word can be longer.
    ``decode_as`` adds a column with the text that the ids decode to, made in the same worker.
    """
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(vocabulary(model))
    names = [c for c in docs.columns if c.lower() not in (ids.lower(), (decode_as or ids).lower())]
    rows = docs.select(*(F.col(f"`{c}`") for c in names), F.xxhash64(F.lit(seed), F.coalesce(F.col(key).cast("string"), F.lit("null"))).alias("__draw"))

    def run(batches):
        v = shared.value
        for batch in batches:
            texts = batch.column(names.index(text_col)).to_pylist()
            keys = batch.column(len(names)).to_numpy().view(_U)
            all_ids, sizes = [], np.zeros(len(texts), np.int64)
            live = np.array([t is not None for t in texts], bool)
            for owners, parts, own in _cut(texts, keys, piece):
                one, bounds = _encoded(v, parts, own, sharpness)
                counts = np.where(live[owners], np.diff(bounds), 0)
                all_ids.append(one if live[owners].all() else one[np.repeat(live[owners], np.diff(bounds))])
                np.add.at(sizes, owners, counts)
            ends = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
            lists = pa.ListArray.from_arrays(ends, pa.array(np.concatenate([*all_ids, np.zeros(0, np.int32)])), mask=pa.array([t is None for t in texts]))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], lists], names=[*names, ids])

    schema = docs.select(*(F.col(f"`{c}`") for c in names)).schema.add(ids, T.ArrayType(T.IntegerType()))
    if decode_as:
        schema = schema.add(decode_as, T.StringType())
        return rows.mapInArrow(trimmed(lambda batches: _decoded(run(batches), shared.value.content, ids, decode_as)), schema)
    return rows.mapInArrow(trimmed(run), schema)


def _decoded(batches, content: list[bytes], ids: str, text: str):
    """Batches with the text of their piece ids as a last column."""
    for batch in batches:
        lists = (y.values.to_numpy(zero_copy_only=False) if y.is_valid else None for y in batch.column(batch.schema.get_field_index(ids)))
        joined = lambda x: b"".join(b"".join(map(content.__getitem__, x[a : a + PIECE].tolist())) for a in range(0, len(x), PIECE))
        texts = [None if x is None else joined(x)[1:] for x in lists]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.binary()).cast(pa.string())], names=[*batch.schema.names, text])


def decoded(rows: DataFrame, ids: str = "piece_ids", text: str = "decoded", model: str = MODEL) -> DataFrame:
    """``rows`` with the text of their piece ids: exactly what ``encoded`` was given.  Null ids give a null text; ids that the model lacks fail."""
    shared = rows.sparkSession.sparkContext.broadcast(vocabulary(model).content)
    names = [c for c in rows.columns if c.lower() != text.lower()]

    run = lambda batches: _decoded(batches, shared.value, ids, text)
    return rows.select(*(F.col(f"`{c}`") for c in names)).mapInArrow(trimmed(run), rows.select(*(F.col(f"`{c}`") for c in names)).schema.add(text, "string"))


def round_trip(docs: DataFrame) -> DataFrame:
    """(doc_id, n_pieces, piece_ids, pieces_hash, text_sha256, lossless): lossless where decoding gives the text itself (null: null)."""
    sha: Column = F.sha2("decoded", 256)
    rows = encoded(docs.select("doc_id", "text"), decode_as="decoded")
    return rows.select(
        "doc_id",
        F.coalesce(F.size("piece_ids"), F.lit(0)).cast("long").alias("n_pieces"),
        "piece_ids",
        F.xxhash64("piece_ids").alias("pieces_hash"),
        sha.alias("text_sha256"),
        F.col("decoded").eqNullSafe(F.col("text")).alias("lossless"),
    )


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents encoded, with the ids and the digest of what they decode to; nulls and repeats as in ``encoded``."""
    return round_trip(spark.read.parquet(f"{sf_dir}/documents.parquet"))
