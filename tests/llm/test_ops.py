"""The ten operators against brute force, round trips, held-out rows and odd inputs."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from sightline.llm import cotrain, dedup, graph, jaccard, langid, maxent, mixing, pieces, queries, sharding, warc

SF = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, source string, n_chars long, norm string, id long, hub string"
A = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen"


def docs_of(spark, rows):
    """Documents with extra columns whose names clash with inner ones."""
    return spark.createDataFrame([(i, t, la, s, None, "x", 7, "y") for i, t, la, s in rows], DOC)


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, ties and repeated rows."""
    rows = [(1, A, "en", "a"), (2, A.upper(), "en", "a"), (2, A.upper(), "en", "a"), (3, None, None, None), (4, "", "en", "b"), (5, " \t\n", None, "b"), (6, "Ä ä ß", "de", "b"), (7, A + " seventeen", "en", "a")]
    rows += [(8, "word " * 30_000, "en", "a"), (9, "x" * 100_000, "fr", None), (10, "one two", "en", "a"), (11, "ONE  two", "en", "a"), (-3, "a▁b\r\n 漢字😀\0", "es", "a"), (None, A, "en", "a"), (None, None, None, None)]
    return docs_of(spark, rows)


@pytest.fixture(scope="module")
def none(spark):
    return docs_of(spark, [])


def normal(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", normal(t))


def truth(rows):
    """component of each (id, text), by all pairs."""
    sets = []
    for _, t in rows:
        w = words(t)
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        low[root(i)] = min(d, low.get(root(i), d))
    return sorted((d, len(s), low[root(i)]) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True)))


def test_exact_dedup(spark, odd, none):
    got = dedup.exact_groups(odd).collect()
    want = collections.defaultdict(list)
    for r in odd.collect():
        want[normal(r.text)].append(r.doc_id)
    assert len(got) == odd.count() and sum(r.kept for r in got) == len(want)
    by = {hashlib.sha256(t.encode()).hexdigest(): ids for t, ids in want.items()}
    for r in got:
        ids = by[r.text_sha256]
        assert r.group_size == len(ids) and r.keep_id == max((i for i in ids if i is not None), default=None)
        assert not r.kept or r.doc_id == r.keep_id
    assert dedup.exact_groups(none).count() == 0


def test_exact_dedup_splits_a_hot_text(spark):
    docs = docs_of(spark, [(i, "same" if i % 3 else f"text {i}", "en", "a") for i in range(3000)])
    got = dedup.exact_groups(docs).collect()
    assert len(got) == 3000 and {r.group_size for r in got} == {1, 2000} and sum(r.kept for r in got) == 1001


def test_exact_dedup_splits_rows_without_identifiers(spark):
    """A hot text on rows alike in all columns: one stays, and its pieces are even."""
    docs = docs_of(spark, [(None if i % 3 else 7, "same", "en", "a") for i in range(1500)] + [(i, f"text {i}", "en", "a") for i in range(10, 760)]).repartition(4)
    got = dedup.exact_groups(docs).collect()
    hot = [r for r in got if r.group_size == 1500]
    assert len(got) == 2250 and len(hot) == 1500 and {r.keep_id for r in hot} == {7} and sum(r.kept for r in hot) == 1


def test_jaccard_on_odd_rows(spark, odd, none):
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.near_groups(odd.where("doc_id IS NOT NULL")).collect())
    assert got == truth([(r.doc_id, r.text) for r in odd.where("doc_id IS NOT NULL").collect()])
    assert jaccard.near_groups(none).count() == 0


def test_jaccard_keeps_rows_without_an_identifier(spark, odd):
    """Each with the size of its own set, no component, and no part in the others' components."""
    rows = [(r.doc_id, r.n_shingles, r.component_id) for r in jaccard.near_groups(odd).collect()]
    named = odd.where("doc_id IS NOT NULL").collect()
    assert sorted(r for r in rows if r[0] is not None) == truth([(r.doc_id, r.text) for r in named])
    assert sorted((r for r in rows if r[0] is None), key=lambda r: r[1]) == [(None, 0, None), (None, len(words(A)) - 4, None)]
    lone = jaccard.near_groups(odd.where("doc_id IS NULL")).collect()
    assert sorted(r.n_shingles for r in lone) == [0, len(words(A)) - 4]


def test_jaccard_on_documents_and_near_copies(spark):
    random = np.random.default_rng(3)
    rows = [(int(r.doc_id), r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").limit(120).collect()]
    base = A.split() * 4
    for i in range(80):
        w = [x if random.random() > 0.04 else f"w{random.integers(9)}" for x in base]
        rows.append((1000 + i, " ".join(w)))
    docs = docs_of(spark, [(i, t, "en", "a") for i, t in rows])
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.near_groups(docs).collect()) == truth(rows)


@pytest.mark.parametrize("block", [8, 512])
def test_jaccard_in_small_blocks(spark, block):
    """Chains and stars of near copies, exact copies and a passage that many share, over hoods of many blocks: brute force's components."""
    random = np.random.default_rng(block)
    rows, chain = [], A.split() * 3
    for i in range(150):  # each a few words from the one before, so ends of the chain are far apart
        chain = list(chain)
        chain[(7 * i) % len(chain)] = f"c{i}"
        rows.append((i, " ".join(chain)))
    base = [f"b{j}" for j in range(60)]
    for i in range(150):
        w = [x if random.random() > 0.03 else f"w{random.integers(5)}" for x in base]
        rows.append((1000 + i, " ".join(w)))
    rows += [(2000 + i, rows[i % 7][1]) for i in range(40)]
    passage = " ".join(f"p{j}" for j in range(20))
    rows += [(3000 + i, f"x{i} {passage} y{i} z{i}") for i in range(60)]
    rows += [(4000 + i, " ".join(f"s{j}" for j in range(i % 9))) for i in range(20)]
    docs = docs_of(spark, [(i, t, "en", "a") for i, t in rows])
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.near_groups(docs, block_rows=block).collect())
    assert got == truth(rows)


def alike(pools):
    """Short texts that share most of their words with many, though no two are linked by all but a few."""
    return [f"a b c d e x{i} y{j} z{k}" for i in range(pools) for j in range(pools) for k in range(pools)]


@pytest.mark.parametrize("block", [16, 64, 512])
def test_jaccard_of_texts_that_only_look_alike(spark, block):
    """Hoods of many unlinked short sets, with a few near copies among them, long ones of shared passages too: brute force's components at any block size."""
    rows = list(enumerate(alike(7)))
    rows += [(1000 + i, f"a b c d e x{i % 7} y1 z1 q{i % 3} r s t u v") for i in range(40)]
    passages = [" ".join(f"p{k}w{j}" for j in range(30)) for k in range(6)]
    rows += [(2000 + i, " ".join([passages[i % 6], passages[(i // 6) % 6], passages[(i // 36) % 6], f"end{i % 40} of it"])) for i in range(150)]
    docs = docs_of(spark, [(i, t, "en", "a") for i, t in rows])
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.near_groups(docs, block_rows=block).collect())
    assert got == truth(rows)


def test_jaccard_work_grows_with_the_texts(spark, monkeypatch):
    """Of texts that only look alike, eight times as many make about eight times the rows to compare."""
    made, across, compared = [], jaccard._across, jaccard._compared_in
    sizes = "CASE WHEN component <> main THEN blocks ELSE 0 END + ceil(odd / 32)"  # rows that each member becomes
    monkeypatch.setattr(jaccard, "_compared_in", lambda p, sets: (made.append(p.count()), compared(p, sets))[1])
    monkeypatch.setattr(jaccard, "_across", lambda apart, sets, n: (made.append(apart.selectExpr(f"coalesce(sum({sizes}), 0)").first()[0]), across(apart, sets, n))[1])
    work = []
    for pools in (6, 12):
        made.clear()
        texts = alike(pools)
        jaccard.near_groups(docs_of(spark, [(i, t, "en", "a") for i, t in enumerate(texts)]), block_rows=32).count()
        work.append(sum(made) / len(texts))
    assert work[1] < 2 * work[0]


@pytest.mark.parametrize("size", [3, 4, 10, 32, 100, 400])
def test_signatures_meet_only_where_sets_are_near(size):
    """Unrelated sets share no signature that is common; pairs just near enough always share one."""
    random = np.random.default_rng(size)
    fresh = lambda n: random.integers(0, 1 << 63, n).astype(np.uint64)
    band, found = jaccard._band(size), collections.Counter()
    for _ in range(300):
        found.update(set(jaccard.all_signatures(fresh(size), band).tolist()))
    assert max(found.values()) <= 3
    for _ in range(60):
        a = fresh(size)
        more = int(random.integers(0, size // 3 + 1))  # added to a, or taken and added
        cut = int(random.integers(0, size // 4 + 1))
        b = np.concatenate([a[cut:], fresh(more)])
        if 100 * (size - cut) < 75 * (size + more):
            continue
        small = jaccard._band(min(len(a), len(b)))
        assert set(jaccard.all_signatures(a, small).tolist()) & set(jaccard.all_signatures(b, small).tolist())


def test_shared_counts_are_of_other_classes(spark):
    """Exact copies count for nothing, near ones and common shingles do."""
    rows = [(i, A) for i in range(5)] + [(9, A + " more"), (10, "quite another text of eight words in all")] * 2
    found = jaccard.digests(spark.createDataFrame(rows, "id long, text string").repartition(3)).groupBy("h1", "n").agg(F.max("shared").alias("s")).collect()
    n = len(A.split()) - 4
    assert sorted((r.n, r.s) for r in found) == [(4, 0), (n, n), (n + 1, n)]


def test_long_texts_in_pieces_give_what_whole_ones_do(monkeypatch):
    """Words, shingles and n-grams of texts far longer than a piece, by pieces of a few bytes or characters."""
    import pyarrow as pa

    from sightline.llm import chargrams, words as W

    random = np.random.default_rng(6)
    texts = [" ".join(random.choice(["ab", "Ça", "漢字", "x" * 90, "\t\n", "end."], 300)), "", None, "z" * 500, "one two", " ".join(map(str, range(400))), "é" * 77]
    column = pa.array(texts)
    plain = []
    for t in texts:
        w = words(t)
        plain.append(len({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()))
    whole, hashes = [x.tolist() for x in W.shingle_sets(column)], [h.tolist() for *_, h, _ in W.word_hashes(column)]
    assert [len(x) for x in whole] == plain
    monkeypatch.setattr(W, "PIECE", 40)
    runs = W.runs
    monkeypatch.setattr(W, "runs", lambda offsets, limit=40: runs(offsets, limit))
    assert [x.tolist() for x in W.shingle_sets(column)] == whole
    assert sum((h.tolist() for *_, h, _ in W.word_hashes(column)), []) == sum(hashes, [])

    def counts():
        out = np.zeros((len(texts), 1 << 10), np.int64)
        for rows, buckets in chargrams.gram_buckets(texts, (1, 2, 3), 10):
            np.add.at(out, (rows, buckets), 1)
        return out

    before = counts()
    lengths = [len(t or "") + 2 for t in texts]
    assert before.sum(axis=1).tolist() == [3 * n - 3 for n in lengths]
    monkeypatch.setattr(chargrams, "PIECE", 13)
    assert (counts() == before).all()


def test_mixing(spark, odd, none):
    docs = odd.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    rates = mixing.target_rates(docs, total=4000)
    got = mixing.mixed(docs, rates)
    assert got.columns[: len(docs.columns)] == docs.columns
    assert abs(got.count() - 4000) < 400
    counts = collections.Counter(r.doc_id for r in got.collect())
    assert all(r.mix_copies == counts[r.doc_id] for r in got.collect())
    assert mixing.mixed(none, mixing.target_rates(none)).count() == 0
    only = mixing.mixed(docs, mixing.target_rates(docs, weights={"b": 1.0})).select("source").distinct().collect()
    assert [r.source for r in only] == ["b"]


def test_mixing_with_clashing_names_and_many_sources(spark, odd):
    """Inner names as columns, and the path for more sources than are broadcast: the same rows come out."""
    docs = odd
    for c in ("mix_parts", "mix_copies", "mix_sums", "mix_source", "mix_draw", "sums", "key", "row", "content", "parts", "of"):
        docs = docs.withColumn(c, F.lit(1))
    rates = mixing.target_rates(docs, total=400)
    rows = lambda df: sorted((repr(r.doc_id), repr(r.text), r.mix_copy, r.mix_key) for r in df.collect())
    broadcast, salted = (rows(mixing.mixed(docs, rates, few_sources=n)) for n in (10_000, 0))
    assert broadcast == salted and len({r[3] for r in broadcast}) == len(broadcast) > 300


def test_mixing_without_identifiers(spark):
    """A third of the rows without an identifier, a third alike in all columns: all drawn apart, spread over partitions, at their rates."""
    rows = [(None, f"t{i % 7}", "en", "a") for i in range(3000)] + [(1, "same", "en", "b")] * 3000 + [(i, f"t{i}", "en", "c") for i in range(2, 3002)]
    docs = docs_of(spark, rows).repartition(4)
    got = mixing.mixed(docs, mixing.target_rates(docs, weights={"a": 0.5, "b": 0.25, "c": 0.25}, total=18_000))
    sizes = {r.source: r["count"] for r in got.groupBy("source").count().collect()}
    assert all(abs(sizes[s] / n - 1) < 0.05 for s, n in (("a", 9000), ("b", 4500), ("c", 4500)))
    assert got.select("mix_key").distinct().count() == sum(sizes.values())
    spread = [r["count"] for r in got.groupBy(F.pmod(F.hash("mix_key"), F.lit(4))).count().collect()]  # as rows are dealt out
    assert len(spread) == 4 and max(spread) < 1.1 * min(spread)


def test_sharding(spark, odd, none):
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = queries.QUERIES["op9_hash_tree"](spark, SF).collect()
    assert len(rows) == docs.count() and all(r.grown_shard in (r.shard, 8) for r in rows)
    for s in range(8):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert all(r.size == len((texts[r.doc_id] or "").encode()) + 1 and r.text_crc32 == zlib.crc32((texts[r.doc_id] or "").encode()) for r in rows)
    assert sharding.sharded(odd, sharding.walked(key, sharding.even_tree(8))).count() == odd.count()
    assert sharding.sharded(none, sharding.walked(key, sharding.even_tree(8))).count() == 0


def test_sharding_deals_a_hot_identifier(spark):
    """A third of the rows without an identifier: slots stay gapless, and no run holds them all."""
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    docs = docs_of(spark, [(None if i % 3 == 0 else i, f"t{i % 5}", "en", "a") for i in range(3000)])
    rows = sharding.sharded(docs, sharding.walked(key, sharding.even_tree(8)), run_rows=50).collect()
    assert len(rows) == 3000 and len({r.shard for r in rows if r.doc_id is None}) == 1
    for s in range(8):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))


def plain_walk(key, tree, seed=5):
    """The same descent in plain Python."""

    def least(level, names):
        weight = {n: sum(x.weight for x in tree if (x.region, x.rack, x.shard)[: len(n)] == n) for n in names}
        u = lambda n: int(hashlib.md5("/".join(map(str, (seed, key, level, *n))).encode()).hexdigest()[:13], 16) / (1 << 52)
        return min((w for w in names if weight[w] > 0), key=lambda n: -math.log(1 - u(n)) / weight[n])

    region = least("region", sorted({(x.region,) for x in tree}))
    rack = least("rack", sorted({(x.region, x.rack) for x in tree if (x.region,) == region}))
    return least("shard", sorted({(x.region, x.rack, x.shard) for x in tree if (x.region, x.rack) == rack}))[2]


def test_a_descent_follows_the_tree(spark):
    """By a plain descent; two trees over the same shards place rows apart; the shares are those of the weights."""
    leaf = sharding.Leaf
    trees = [sharding.even_tree(9), [leaf(0, 0, s, 1.0 + s) for s in range(9)], [leaf(s % 3, s % 2, s, 0.0 if s == 4 else 1.0) for s in range(9)]]
    rows = spark.range(2000).select("id", *(sharding.walked(F.col("id"), t).alias(f"t{k}") for k, t in enumerate(trees))).collect()
    for k, tree in enumerate(trees):
        assert all(r[f"t{k}"] == plain_walk(r.id, tree) for r in rows[:400])
        total = sum(x.weight for x in tree)
        assert all(abs(sum(r[f"t{k}"] == x.shard for r in rows) - 2000 * x.weight / total) < 90 for x in tree)
    assert sum(r.t0 != r.t2 for r in rows) > 1000


def test_weight_moved_within_a_branch_moves_rows_only_there(spark):
    """By the function that the query calls, on its tree: weight moved within a rack, then between the racks of a region."""
    tree = sharding.even_tree(8)
    changed = lambda w: [sharding.Leaf(x.region, x.rack, x.shard, w.get(x.shard, 1.0)) for x in tree]
    trees = {"a": tree, "rack": changed({4: 0.25, 5: 1.75}), "region": changed({4: 0.5, 5: 0.5, 6: 1.5, 7: 1.5})}
    rows = spark.range(4000).select(*(sharding.walked(F.col("id"), t).alias(n) for n, t in trees.items()), sharding.walked(F.col("id"), sharding.even_tree(9)).alias("grown")).collect()
    assert all(r.a == r.rack or {r.a, r.rack} == {4, 5} for r in rows)
    assert all(r.a == r.region or {r.a, r.region} <= {4, 5, 6, 7} for r in rows)
    assert all(r.grown in (r.a, 8) for r in rows)
    for name, t in trees.items():
        assert all(abs(sum(r[name] == x.shard for r in rows) - 500 * x.weight) < 110 for x in t)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", sharding.walked(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), tree).alias("want"))
    got = queries.QUERIES["op9_hash_tree"](spark, SF).join(docs, "doc_id")
    assert got.where("shard <> want").count() == 0


def test_pieces(spark, odd, none):
    rows = pieces.round_trip(odd).collect()
    assert len(rows) == odd.count() and all(r.lossless for r in rows)
    assert pieces.round_trip(none).count() == 0
    apart = pieces.decoded(pieces.encoded(odd)).select("text", "decoded").collect()
    assert len(apart) == odd.count() and all(r.text == r.decoded for r in apart)
    again = pieces.round_trip(odd.repartition(3)).collect()
    assert sorted(map(repr, rows)) == sorted(map(repr, again))


def test_pieces_follow_their_probabilities():
    v = pieces.vocabulary()
    place = {int(i): k for k, i in enumerate(v.ids)}
    known = {v.content[i]: float(v.logs[k]) for i, k in place.items()}
    whole = b" the"
    ways = collections.Counter()

    def walk(at, done, log):
        if at == len(whole):
            ways[tuple(done)] = math.exp(log)
        for n in range(1, len(whole) - at + 1):
            if whole[at : at + n] in known:
                walk(at + n, [*done, whole[at : at + n]], log + known[whole[at : at + n]])

    walk(0, [], 0.0)
    keys = np.random.default_rng(1).integers(0, 1 << 63, 20_000).astype(np.uint64)
    ids, bounds = pieces._encoded(v, ["the"] * len(keys), keys, 1.0)
    got = collections.Counter(tuple(v.content[i] for i in ids[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True))
    total = sum(ways.values())
    for way, p in ways.items():
        assert abs(got[way] / len(keys) - p / total) < 0.015


def test_pieces_of_words_and_bytes_follow_their_probabilities():
    """Two words, a character without a piece and a run of spaces: all ways to cut the whole, by brute force."""
    v = pieces.vocabulary()
    known = {v.content[i]: float(v.logs[k]) for k, i in enumerate(v.ids.tolist())}
    raw = {bytes([b]): i for b, i in enumerate(v.byte_ids.tolist())}
    text = "an \U0001f980  ox"
    whole, odd = (" " + text).encode(), "\U0001f980".encode()
    ways = collections.Counter()

    def walk(at, done, log):
        if at == len(whole):
            ways[tuple(done)] = math.exp(log)
        elif whole.startswith(odd, at):  # its bytes, one by one
            walk(at + len(odd), [*done, *(raw[odd[i : i + 1]] for i in range(len(odd)))], log)
        for n in range(1, len(whole) - at + 1):
            if whole[at : at + n] in known:
                walk(at + n, [*done, ids_of[whole[at : at + n]]], log + known[whole[at : at + n]])

    ids_of = {v.content[i]: i for i in v.ids.tolist()}
    walk(0, [], 0.0)
    keys = np.random.default_rng(2).integers(0, 1 << 63, 20_000).astype(np.uint64)
    ids, bounds = pieces._encoded(v, [text] * len(keys), keys, 1.0)
    got = collections.Counter(tuple(ids[a:b].tolist()) for a, b in zip(bounds[:-1], bounds[1:], strict=True))
    total = sum(ways.values())
    assert set(got) <= set(ways) and all(abs(got[way] / len(keys) - p / total) < 0.015 for way, p in ways.items())


def test_pieces_of_a_long_text_are_those_of_its_whole(spark, odd):
    """Cut at word starts into pieces of a few characters, each row gets the same ids as in one."""
    more = odd.where("length(text) < 1000 OR text IS NULL").unionByName(docs_of(spark, [(77, "ab  cd e   " * 400 + "x" * 900 + " \U0001f980", "en", "a")]))
    ids = lambda n: sorted((repr(r.doc_id), repr(r.text), r.piece_ids) for r in pieces.encoded(more, piece=n).select("doc_id", "text", "piece_ids").collect())
    assert ids(1 << 20) == ids(50) == ids(400)
    found = queries.QUERIES["op8_sentencepiece"](spark, SF)
    assert dict(found.dtypes)["piece_ids"] == "array<int>" and found.where("NOT lossless OR size(piece_ids) <> n_pieces").count() == 0


def test_warc(spark, tmp_path):
    big = "é" * 600
    rows = [(1, "http://a", big, 0), (2, "http://b\r\nX: y", big, 0), (3, None, big + "WARC/1.1\r\n\r\n", 0), (4, "http://c", None, 0), (5, "http://d", "", 0), (6, "u", "short", 0), (7, "u", "short", 0), (7, "u", big, 1), (7, "u", big, 1), (None, "u", big, 0)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest int")
    pages.write.parquet(f"{tmp_path}/pages.parquet")
    got = queries.QUERIES["op5_warc"](spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    first = {}
    for i, _, h, _ in rows:
        if len((h or "").encode()) >= 1000:
            first[h] = max(first.get(h, -1), i or -1)
    want = []
    for i, _, h, _ in rows:
        b = (h or "").encode()
        again = h in first and i != first[h]
        want.append((i, len(b), hashlib.sha1(b).hexdigest(), "revisit" if again else "response", first[h] if again else None))
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    warc.write_archives(pages, f"{tmp_path}/out")
    one = warc.captures(warc.read_archives(spark, f"{tmp_path}/out")).where("response.type = 'response'").select(F.col("response.block").alias("b"), "requests", "metadata").collect()
    assert all(bytes(r.b).startswith(b"HTTP/1.1 200") and len(r.requests) == len(r.metadata) == 1 for r in one)
    pages.limit(0).write.parquet(f"{tmp_path}/none/pages.parquet")
    assert queries.QUERIES["op5_warc"](spark, f"{tmp_path}/none").count() == 0


def test_warc_reads_members_and_refuses_stumps():
    import gzip

    record = b"WARC/1.0\r\nWARC-Type: resource\r\nContent-Length: 7\r\n\r\na\r\n\r\nbc\r\n\r\n"
    for data in (gzip.compress(record) * 2, gzip.compress(record * 2), record * 2):
        for chunk in (1, 2, 3, 7, 50, 1 << 20):
            assert [b for _, b in warc._parsed(warc._inflated(data, chunk))] == [b"a\r\n\r\nbc"] * 2
    for data in (record[:-10], record[:10], gzip.compress(record)[:-9], b"junk" + record):
        with pytest.raises(ValueError):
            list(warc._parsed(warc._inflated(data, 5)))


def test_warc_with_long_payloads(spark, tmp_path):
    """Payloads of all ranges of sizes, one of 40 MB: no file holds more captures than its range allows, and all come back."""
    sizes = [10, 20_000, 600_000, 40_000_000, 700_000]
    pages = spark.createDataFrame([(i, "http://a", n) for i, n in enumerate(sizes)], "page_id long, url string, n int").withColumn("html", F.expr("repeat(chr(65 + page_id), n)")).drop("n")
    pages.write.parquet(f"{tmp_path}/pages.parquet")
    got = {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type) for r in queries.QUERIES["op5_warc"](spark, str(tmp_path)).collect()}
    assert got == {i: (n, hashlib.sha1(chr(65 + i).encode() * n).hexdigest(), "response") for i, n in enumerate(sizes)}
    warc.write_archives(pages.repartition(1), f"{tmp_path}/out")
    files = collections.defaultdict(list)
    for r in warc.read_archives(spark, f"{tmp_path}/out").where("type = 'response'").select("file", F.octet_length("block").alias("n")).collect():
        files[r.file].append(r.n)
    assert sorted(map(len, files.values())) == [1] * 5


def test_warc_nests_what_is_concurrent(spark):
    """Two requests and three metadata records of one response make one row; those of nothing go."""
    rows = [("f", 0, "response", "r1", None, "u"), ("f", 1, "request", "q1", "r1", "u"), ("f", 3, "request", "q2", "r1", "u"), ("f", 2, "metadata", "m1", "r1", None), ("e", 9, "metadata", "m2", "r1", None), ("f", 4, "metadata", "m3", "r1", None)]
    rows += [("f", 5, "revisit", "r2", None, None), ("f", 6, "request", "q9", "r9", None), ("f", 7, "warcinfo", "w", None, None), ("f", 8, "request", "q8", None, None)]
    records = spark.createDataFrame(rows, "file string, record_no int, type string, record_id string, concurrent_to string, target_uri string").withColumn("requests", F.lit(1))
    got = {r.record_id: ([q.record_id for q in r.requests], [m.record_id for m in r.metadata]) for r in warc.captures(records).collect()}
    assert got == {"r1": (["q1", "q2"], ["m2", "m1", "m3"]), "r2": ([], [])}


def test_language_model(spark, odd, none):
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 == 0
    for docs in (odd, spark.read.parquet(f"{SF}/documents.parquet")):
        rows = docs.collect()
        held_of = {r.doc_id: r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 10 == 0 for r in rows}
        known = collections.Counter(w for r in rows if not held_of[r.doc_id] for w in [*words(r.text), None])
        n, v = sum(known.values()), len(known)
        want = sorted(
            (repr(r.doc_id), len(words(r.text)) + 1, sum(known[w] > 0 for w in [*words(r.text), None]), round(sum(math.log10((known[w] + 0.1) / (n + 0.1 * (v + 1))) for w in [*words(r.text), None]), 6)) for r in rows
        )
        got = maxent.scored(docs, held).collect()
        assert want == sorted((repr(r.doc_id), r.n_tokens, r.n_known, round(r.base_score, 6)) for r in got)
        assert all(r.train_tokens == n and r.score < 0 for r in got)
    out = [r for r in got if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)
    assert maxent.scored(none, held).count() == 0


@pytest.mark.parametrize("n", [0, 1, 40, 700, 9500])
def test_the_model_is_a_distribution(n):
    """Over all words with a place and all others the probabilities add up to one, whatever the tables hold; untrained they are the frequencies."""
    random = np.random.default_rng(n)
    vocabulary = np.unique(random.integers(1, 1 << 62, n).astype(np.uint64))
    counts = random.integers(1, 50, n)
    m = maxent.Model(vocabulary, counts, int(counts.sum()) + 90, n + 30)
    assert len(set(zip(*m.node, *m.branch))) == n  # each word has a path of its own
    for scale in (0, 0.7, 30):
        m.tables = random.normal(0, scale, m.tables.shape).astype(np.float32)
        found = np.concatenate([[k, 9, w] for w in [*vocabulary.tolist(), 5] for k in [7]]).astype(np.uint64)  # the same history before each
        at, log = m.logs(found, np.arange(0, len(found) + 1, 3))
        chance = 10 ** log[2::3]
        assert abs(chance.sum() - 1) < 1e-3
        if not scale:
            total = counts.sum() + 90 + 0.1 * (n + 31)
            assert np.allclose(chance[:-1], (m.counts + 0.1)[at[2::3][:-1]] / total, rtol=1e-3)


def test_steps_are_those_of_plain_gradients():
    """One step over a few tokens, table row by table row in plain Python."""
    random = np.random.default_rng(1)
    vocabulary = np.sort(random.integers(1, 1 << 62, 700).astype(np.uint64))
    m = maxent.Model(vocabulary, random.integers(1, 50, 700), 20_000, 900)
    m.tables = random.normal(0, 0.1, m.tables.shape).astype(np.float32)
    found, bounds = random.choice(vocabulary, 40), np.array([0, 15, 40])
    want, squares, touched = m.tables.astype(float), np.ones(len(m.tables), np.float32), np.zeros(len(m.tables))
    at = m.looked_up(found)
    moves = collections.defaultdict(lambda: np.zeros(maxent.BRANCHES))
    before = want.copy()
    for live, node, branch, rows in m.levels(at, m.history(found, bounds)):
        own = collections.defaultdict(lambda: np.zeros(maxent.BRANCHES))
        for j in range(len(live)):
            base = 0 if node is None else m.rows
            x = m.prior[0 if node is None else node[j]] + sum(before[base + r[j]] for r in rows)
            p = np.exp(x) / np.exp(x).sum()
            p[branch[j]] -= 1
            for r in rows:
                own[base + r[j]] += p
        for r, g in own.items():
            before[r] -= maxent.RATE * g / math.sqrt((1 if r not in moves else moves[r][0]) + (g**2).mean())
            moves[r] = np.array([(1 if r not in moves else moves[r][0]) + (g**2).mean()])
    m.learn(found, bounds, squares, touched)
    assert np.allclose(m.tables, before, atol=1e-5) and touched.sum() == 3 * sum(len(live) for live, *_ in m.levels(at, m.history(found, bounds)))


def test_language_id(spark, odd, none):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r.doc_id: r for r in langid.identified(docs, ~langid.held_out()).collect()}
    held = [r for r in docs.collect() if not got[r.doc_id].learned]
    assert sum(got[r.doc_id].lang_pred == r.lang for r in held) >= 0.98 * len(held)
    rows = langid.identified(odd, F.lit(True)).collect()
    assert len(rows) == odd.count() and all(0 <= r.score <= 1 for r in rows)
    assert [r.lang_pred for r in rows if r.doc_id in (3, 4, 5)] == ["und"] * 3
    assert {r.lang_pred for r in langid.identified(odd, F.lit(False)).collect()} == {"und"}
    assert langid.identified(none, F.lit(True)).count() == 0


def plain_weights(texts, labels, held, idf):
    """The fit's own rule, weight by weight in plain Python: TF-IDF of hashed n-grams, then follow-the-regularised-leader in its batches."""
    vectors = []
    for t in texts:
        count = collections.Counter(b for _, bs in langid.gram_buckets([t], langid.ORDERS, langid.BITS) for b in bs.tolist())
        vectors.append({b: float(np.float32(c / sum(count.values()))) * idf[b] * langid.SCALE for b, c in count.items()} | {-1: 1.0})
    classes = sorted(set(labels))
    y = [classes.index(x) for x in labels]
    learn = [i for i in range(len(texts)) if not held[i]]
    z, n, w = (collections.defaultdict(float) for _ in range(3))
    random = np.random.Generator(np.random.PCG64(11))
    for _ in range(langid.EPOCHS):
        for rows in np.array_split(random.permutation(learn), max(1, math.ceil(len(learn) / langid.BATCH))):
            grad = collections.defaultdict(float)
            for r in rows:
                x = [sum(v * w[b, c] for b, v in vectors[r].items()) for c in range(len(classes))]
                total = sum(math.exp(a - max(x)) for a in x)
                weight = len(learn) / (len(classes) * sum(y[i] == y[r] for i in learn))
                for c in range(len(classes)):
                    g = (math.exp(x[c] - max(x)) / total - (c == y[r])) * weight
                    for b, v in vectors[r].items():
                        grad[b, c] += v * g / len(rows)
            for k, g in grad.items():
                after = n[k] + g * g
                z[k] += g - (math.sqrt(after) - math.sqrt(n[k])) / langid.ALPHA * w[k]
                n[k] = after
                shrunk = math.copysign(max(abs(z[k]) - langid.L1 / len(rows), 0.0), z[k])
                w[k] = -shrunk / ((langid.BETA + math.sqrt(after)) / langid.ALPHA + langid.L2 / len(rows))
    return classes, w


def test_language_weights_are_those_of_a_plain_fit():
    import pyarrow as pa

    random = np.random.default_rng(5)
    texts = [" ".join(random.choice(["der", "die", "und", "nicht", "über"] if i % 3 else ["the", "and", "of", "house"], 6 + i % 4)) for i in range(14)]
    labels = ["de" if i % 3 else "en" for i in range(14)]
    df = np.zeros(1 << langid.BITS)
    for t in texts:
        for b in {b for _, bs in langid.gram_buckets([t], langid.ORDERS, langid.BITS) for b in bs.tolist()}:
            df[b] += 1
    counted = collections.Counter()
    for batch in langid._document_counts([pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])]):
        counted.update(dict(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)))
    assert counted.pop(-1) == 14 and dict(counted) == {int(b): int(df[b]) for b in np.flatnonzero(df)}
    idf = np.log((1 + 14) / (1 + df)) + 0.1
    u = np.linspace(0, 1, 14)
    batch = next(langid._vectors([pa.RecordBatch.from_arrays([pa.array(labels), pa.array(texts), pa.array(u)], names=["lang", "text", "u"])]))
    arrays = [[x.values.to_numpy() for x in batch.column(c)] for c in (2, 3)]
    w, bias, t = langid.fitted(labels, u, *arrays, idf, ["de", "en"])
    classes, want = plain_weights(texts, labels, [False] * 14, idf)
    assert classes == ["de", "en"] and t > 0
    plain = np.zeros((len(df) + 1, 2))
    for (b, c), x in want.items():
        plain[b, c] = x
    assert np.allclose(w, plain[:-1], atol=1e-9) and np.allclose(bias, plain[-1], atol=1e-9) and (w != 0).sum() > 50


def test_language_id_learns_every_label(spark):
    """Far more labels than a plan could chain, one of them on a fifth of all rows as one text."""
    letters = [chr(0x4E00 + 7 * k) for k in range(420)]
    rows = [(6 * k + i, f"{a}{letters[k - 1]} {a}{a} {a}{i}", f"l{k:03}", "a") for k, a in enumerate(letters) for i in range(6)]
    rows += [(None, "immer das eine", "hot", None)] * 500
    got = langid.identified(docs_of(spark, rows), F.lit(True)).collect()
    want = {r[0]: r[2] for r in rows}
    right = sum(r.lang_pred == want[r.doc_id] for r in got)
    assert len(got) == len(rows) and right >= 2500 and len({r.lang_pred for r in got}) > 410  # "hot" has one text, which may be left out to calibrate


def test_quality(spark, odd, none):
    out = queries.QUERIES["op10_co_training"](spark, "/root/testdata/sf0.01").toPandas()
    known = pq.read_table("/root/testdata/sf0.01/labels.parquet").to_pandas().merge(out, on="doc_id")
    good = (known.quality == 1) & (known.toxic == 0)
    assert known[good].kept.mean() > 0.95 and known[~good].kept.mean() < 0.1
    labels = spark.createDataFrame([(1, True), (2, False), (2, True), (4, None), (None, True)], "id long, good boolean")
    meta = cotrain.metadata(F.col("source"), F.col("n_chars"))
    rows = cotrain.co_trained(odd, labels, meta).collect()
    assert len(rows) == odd.count() and all(r.score == 0.5 and r.kept for r in rows)
    assert cotrain.co_trained(none, labels, meta).count() == 0


def test_quality_repeats_count_once_and_views_teach_each_other(spark):
    """Labels say what the text view learns; the metadata view learns a source that no label shows only from pseudo-labels."""
    random = np.random.default_rng(7)
    fine, poor = "clear sober useful careful notes about rivers and bridges".split(), "$$$ !!! win cash now ### click".split()
    rows, labels = [], []
    for i in range(900):
        good = i % 2 == 0
        text = " ".join(random.choice(fine if good else poor, 30))
        source = ("press" if good else "spam") if i < 300 else ("atlas" if good else "offers")  # the latter have no labels
        rows.append((i, text, "en", source))
        if i < 300:
            labels.append((i, good))
    rows += [(0, rows[0][1], "en", "press")] * 600  # a taught row a great many times
    docs, known = docs_of(spark, rows), spark.createDataFrame(labels, "id long, good boolean")
    score = lambda rounds: {(r.doc_id): r for r in cotrain.co_trained(docs, known, cotrain.metadata(F.col("source")), rounds=rounds, shape=False).collect()}
    before, after = score(0), score(2)
    new = lambda found, good: np.mean([found[i].meta_score for i in range(300, 900) if (i % 2 == 0) == good])
    assert abs(new(before, True) - new(before, False)) < 1e-9  # a source never taught says nothing
    assert new(after, True) > 0.8 > 0.2 > new(after, False)
    assert all(after[i].kept == (i % 2 == 0) for i in range(900))


def test_quality_fit_is_that_of_plain_steps():
    """The adaptive gradient steps weight by weight, on a dozen rows."""
    random = np.random.default_rng(1)
    features = [np.sort(random.choice(20, 5, replace=False)).astype(np.int32) for _ in range(12)]
    values = [random.random(5).astype(np.float32) for _ in range(12)]
    y, weight = np.array([1.0, 0.0] * 6), np.array([1.0, 0.5] * 6)
    got = cotrain.fitted(features, values, y, weight, 20)
    w, squares = np.zeros(21), np.full(21, 1e-3)
    scaled = [float(weight[i]) * 12 / (2 * 6) for i in range(12)]
    order = np.random.Generator(np.random.PCG64(5))
    for _ in range(cotrain.EPOCHS):
        for rows in np.array_split(order.permutation(12), 1):
            grad = cotrain.L2 * w
            for r in rows:
                x = sum(w[f] * v for f, v in zip(features[r].tolist(), values[r].tolist(), strict=True)) + w[20]
                g = (1 / (1 + math.exp(-x)) - y[r]) * scaled[r] / 12
                for f, v in zip(features[r].tolist(), values[r].tolist(), strict=True):
                    grad[f] += g * v
                grad[20] += g
            squares += grad**2
            w = w - cotrain.RATE * grad / np.sqrt(squares)
    assert np.allclose(got, w, atol=1e-9)


def test_text_scores_are_those_of_the_vectors():
    import pyarrow as pa

    random = np.random.default_rng(0)
    texts = pa.array(["", None, "ab", "abc", "Hello, HELLO ## 12\n" * 50, "é" * 999, "z" * ((1 << 20) + 77)])
    w = random.normal(size=cotrain.GRAMS + 1)
    want = [float(w[f] @ v + w[-1]) for f, v in cotrain.text_vectors(texts)]
    assert np.allclose(cotrain.text_logits(texts, w), want, atol=1e-4)
    w, metas = random.normal(size=cotrain.META + cotrain.SHAPES + 1), [[1, 5], [2, 2], [0, 4095]] * 2 + [[7, 8]]
    want = [float(w[f] @ v + w[-1]) for f, v in cotrain.page_vectors(texts, metas)]
    assert np.allclose(cotrain.page_logits(texts, pa.array(metas), w), want, atol=1e-4)


def test_quality_views_give_each_other_labels_in_every_round(spark, monkeypatch):
    """On documents each view is sure of some for the other, and what is exchanged doesn't cost held-out documents their right answer."""
    given, keep = [], cotrain.written

    def noted(df, what, *more):
        out = keep(df, what, *more)
        if what == "pseudo":
            given.append({r.view for r in out.select("view").distinct().collect()})
        return out

    monkeypatch.setattr(cotrain, "written", noted)
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    labels = labels.select(F.col("doc_id").alias("id"), ((F.col("quality") == 1) & (F.col("toxic") == 0)).alias("good"))
    meta = cotrain.metadata(F.col("source"), F.col("lang"))
    right = []
    for rounds in (0, 2):
        found = cotrain.co_trained(docs, labels.where("id % 3 <> 0"), meta, rounds=rounds)
        right.append(found.join(labels.withColumnRenamed("id", "doc_id"), "doc_id").where("doc_id % 3 = 0 AND kept = good").count())
    assert given == [{"text", "meta"}] * 2 and right[1] >= right[0]


def test_quality_of_odd_rows_by_a_fitted_model(spark, odd):
    """Null, empty, long and repeated texts get a probability from a model of both classes, and equal rows the same."""
    labels = spark.createDataFrame([(i, i % 2 == 0) for i in (1, 2, 4, 5, 6, 7, 8, 9)], "id long, good boolean")
    rows = cotrain.co_trained(odd, labels, cotrain.metadata(F.col("source"))).collect()
    assert len(rows) == odd.count() and all(0 <= r.score <= 1 and r.kept == (r.score >= cotrain.KEEP) for r in rows) and len({r.score for r in rows}) > 5
    assert len({r.score for r in rows if r.doc_id == 2}) == 1


@pytest.mark.parametrize("sign", ["²", "½", "Ⅷ", "①", "7 _ -"])
def test_signs_that_are_no_letters_have_no_language(sign):
    assert not langid.has_letter(sign) and langid.has_letter(sign + "ª") and langid.has_letter("漢") and not langid.has_letter("") and not langid.has_letter(None)


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_nearest(spark, sf):
    got = queries.QUERIES["op2_vector_graph"](spark, f"/root/testdata/{sf}").toPandas()
    t = pq.read_table(f"/root/testdata/{sf}/embeddings.parquet")
    ids, v = t.column("vec_id").to_numpy(), np.stack(t.column("embedding").to_numpy()).astype(float)
    found = got.groupby("query_id").vec_id.apply(set)
    recall = []
    for i in np.flatnonzero(ids % 20 == 0):
        s = v @ v[i]
        s[i] = -np.inf
        recall.append(len(found[ids[i]] & set(ids[np.lexsort((ids, -s))[:20]])) / 20)
    assert np.mean(recall) >= 0.9 and sorted(got[got.query_id == 0]["rank"]) == list(range(1, 21))


def test_shards_are_bounded_in_bytes(spark, monkeypatch):
    """Long vectors make more shards, not larger ones, and the same neighbours are found."""
    random = np.random.default_rng(8)
    v = random.normal(size=(400, 48))
    table = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    shards, keep = [], graph.written

    def noted(df, what, *more):
        out = keep(df, what, *more)
        if what == "shape":
            shards.append(out.agg(F.sum("shards")).first()[0])
        return out

    monkeypatch.setattr(graph, "written", noted)
    for size in (64 << 20, 8 * 48 * 40):
        monkeypatch.setattr(graph, "SHARD_BYTES", size)
        found = graph.nearest(table, F.col("vec_id") % 40 == 0, k=5).toPandas().groupby("query_id").vec_id.apply(set)
        hits = [len(found[i] & set(np.argsort(-np.where(np.arange(400) == i, -np.inf, v @ v[i]))[:5])) for i in range(0, 400, 40)]
        assert sum(hits) >= 45
    assert shards[1] >= 10 > shards[0]


def test_a_graph_searches_alike_after_many_searches():
    """Marks of earlier searches, and their counter's return, change nothing."""
    random = np.random.default_rng(3)
    g = graph.Graph(random.normal(size=(600, 8))).build()
    asked = random.normal(size=(5, 8)).astype(np.float32)
    first = g.search(asked)
    g._searches = 65_533
    assert all((g.search(asked)[0] == first[0]).all() for _ in range(5))
    exact = np.argsort(g.squares - 2 * asked @ g.points.T, axis=1)[:, :10]
    assert np.mean([len(set(a) & set(b[:10])) / 10 for a, b in zip(exact.tolist(), first[0].tolist(), strict=True)]) > 0.9


def test_nearest_with_odd_vectors(spark):
    nan = float("nan")
    rows = [(i, [1.0, 0.0]) for i in range(0, 60)] + [(60, None), (80, [0.0, 0.0]), (100, [nan, 1.0]), (120, [None, 1.0]), (140, []), (160, [1.0]), (None, [1.0, 1.0]), (20, [1.0, 0.0]), (7, [5.0, 0.0])]
    got = graph.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("vec_id") % 20 == 0, k=5).collect()
    by = collections.defaultdict(list)
    for r in sorted(got, key=lambda r: (r.query_id, r.rank)):
        by[r.query_id].append((r.vec_id, r.score))
    assert by == {0: [(7, 5.0), (1, 1.0), (2, 1.0), (3, 1.0), (4, 1.0)], 20: [(7, 5.0), (0, 1.0), (1, 1.0), (2, 1.0), (3, 1.0)], 40: [(7, 5.0), (0, 1.0), (1, 1.0), (2, 1.0), (3, 1.0)]}
    assert graph.nearest(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.lit(True)).count() == 0


def test_nearest_beside_long_vectors(spark):
    """Norms from 1e-25 to 1e30: each query finds what exact products find."""
    random = np.random.default_rng(4)
    v = random.normal(size=(3000, 16))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    for norm, low, high in ((1e3, 1, 4), (1e30, 4, 6), (1e-25, 2900, 3000)):
        v[low:high] *= norm
    v = v.astype(np.float32).astype(float)
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(v.tolist())], "vec_id long, embedding array<float>")
    found = collections.defaultdict(set)
    for r in graph.nearest(rows, F.col("vec_id") % 20 == 0, k=10).collect():
        found[r.query_id].add(r.vec_id)
    recall = []
    for i in range(0, 3000, 20):
        s = v @ v[i]
        s[i] = -np.inf
        recall.append(len(found[i] & set(np.argsort(-s, kind="stable")[:10].tolist())) / 10)
    assert len(found) == 150 and np.mean(recall) >= 0.95


def test_pipeline(spark, odd, none, tmp_path):
    import corpus_pipeline as p

    out = p.run(spark, SF).collect()
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    kept = p.near(spark, p.exact(spark, p.language(spark, spark.read.parquet(f"{SF}/documents.parquet"), SF), SF), SF)
    assert all(r.lossless and r.text_sha256 == hashlib.sha256(docs[r.doc_id].text.encode()).hexdigest() for r in out)
    assert {r.doc_id for r in out} <= {r.doc_id for r in kept.collect()}
    # each of the first three stages against brute force
    spoken = p.language(spark, spark.read.parquet(f"{SF}/documents.parquet"), SF).collect()
    assert {r.doc_id for r in spoken} == {i for i, r in docs.items() if re.search(r"[^\W\d_]", r.text or "")}
    best = {}
    for r in spoken:
        best[normal(r.text)] = max(r.doc_id, best.get(normal(r.text), -1))
    single = [(i, docs[i].text) for i in best.values()]
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for _, _, c in truth(single)})
    for _, stage in p.STAGES[:-1]:
        got = stage(spark, none, SF)
        assert got.columns == none.columns and got.count() == 0
        assert stage(spark, odd, SF).columns == odd.columns


def test_pipeline_decides_by_rows(spark, odd):
    """Of each text one row stays, with or without an identifier, even if an identifier stands for two texts."""
    import corpus_pipeline as p

    left = p.exact(spark, odd, SF).collect()
    texts = collections.defaultdict(list)
    for r in odd.collect():
        texts[normal(r.text)].append(r.doc_id)
    assert sorted(normal(r.text) for r in left) == sorted(texts)
    assert all(r.doc_id == max((i for i in texts[normal(r.text)] if i is not None), default=None) for r in left)
    rows = [(1, A, "en", "a"), (1, A + " and more", "en", "a"), (1, "some other words that stand for themselves", "en", "a"), (None, A + " also", "en", "a"), (None, None, None, None), (None, "", None, None)]
    near = p.near(spark, docs_of(spark, rows).withColumn("row_key", F.lit(0)), SF).collect()
    assert len(near) == 4 and all(r.row_key == 0 for r in near) and {r.doc_id for r in near if r.text} == {1}
    assert p.language(spark, odd, SF).where("text IS NULL OR text = ''").count() == 0
