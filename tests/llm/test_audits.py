"""Line dedup, the filter audit and the prefix trie against brute force, on odd inputs and on shuffled instead of broadcast joins."""

import collections
import hashlib
import itertools
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sightline.llm import common, filteraudit, linededup, prefixtrie

from .test_ops import docs_of, none, normal, odd  # noqa: F401  fixtures


def shuffled(monkeypatch, module):
    monkeypatch.setattr(module, "looked_up", lambda a, b, keys, how="inner": common.looked_up(a, b, keys, how, rows=0))


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def stripped(line):
    return normal(line.strip(" \t\n\v\f\r"))


def without_lines(texts, least, chars=1):
    """(lines, dropped, kept text) of each text."""
    held = collections.Counter(k for t in texts for k in {stripped(x) for x in (t or "").split("\n")} if len(k) >= chars)
    for t in texts:
        lines = (t or "").split("\n")
        kept = [x for x in lines if held[stripped(x)] < least]
        yield len(lines), len(lines) - len(kept), "\n".join(kept)


LINES = ["Same line", " same LINE\t", "other", "", "  ", "ä", "Ä", "\r", "x ", "long " * 2000, "\x1fy", "z z"]


@pytest.mark.parametrize("by_shuffle", [False, True])
def test_line_dedup(spark, odd, none, monkeypatch, by_shuffle):
    if by_shuffle:
        shuffled(monkeypatch, linededup)
    random = np.random.default_rng(4)
    rows = [(r.doc_id, r.text) for r in odd.collect()] + [(100 + i % 90, "\n".join(random.choice(LINES, random.integers(0, 9)))) for i in range(120)]
    rows += [(None, "Same line\nonce")] * 3 + [(300, "q\n" * 3000)] + [(400 + i, "q\nr") for i in range(7)] + [(500 + i, "just under\nten") for i in range(9)]
    docs = docs_of(spark, [(i, t, "en", "a") for i, t in rows]).withColumn("row", F.lit(1)).withColumn("print", F.lit(2))
    for least, chars in ((10, 1), (3, 6), (1, 1)):
        got = linededup.without_frequent_lines(docs, min_docs=least, min_chars=chars).collect()
        want = [(i, *x) for (i, _), x in zip(rows, without_lines([t for _, t in rows], least, chars), strict=True)]
        assert sorted(map(repr, ((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in got))) == sorted(map(repr, want))
    assert linededup.without_frequent_lines(none).count() == 0


def audited(rows, labels):
    """What every order of filters does, document by document."""
    good, toxic = ({i for i, *x in labels if x[k] == 1 and i is not None} for k in (0, 1))
    parts = collections.defaultdict(list)
    for i, text, part in rows:
        t = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        earlier = [j for j, u, _ in rows if (u or "") == t and j is not None and (i is None or j < i)]
        fails = {"A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": bool(earlier)}
        parts[part or ""].append((fails, i in good, i in toxic))
    out = {}
    for part, docs in parts.items():
        shapley = collections.Counter()
        for order in map("".join, itertools.permutations("ABCDE")):
            for k, f in enumerate(order):
                here = [d for d in docs if not any(d[0][e] for e in order[:k])]
                removed = [d for d in here if d[0][f]]
                shapley[f] += len(removed)
                out[part, order, k + 1] = [
                    len(here) - len(removed), len(removed), sum(d[0][f] for d in docs) - len(removed), sum(d[0][f] and sum(d[0].values()) == 1 for d in docs),
                    sum(d[1] for d in removed), sum(d[2] for d in removed),
                ]
        for (p, order, k), x in out.items():
            if p == part:
                x.append(shapley[order[k - 1]])
    return out


@pytest.mark.parametrize("by_shuffle", [False, True])
def test_filter_audit(spark, odd, none, monkeypatch, by_shuffle):
    if by_shuffle:
        shuffled(monkeypatch, filteraudit)
    random = np.random.default_rng(5)
    plain = [f"w{i}" for i in range(60)]
    texts = [" ".join(plain), " ".join(plain).upper(), " ".join(plain) + " 50%", " ".join(plain[:20] * 3), "A" * 9, "é" * 60 + " É", None, "", "#"]
    rows = [(r.doc_id, r.text, r.source) for r in odd.collect()]
    rows += [(int(random.integers(50, 90)) if random.random() > 0.1 else None, texts[random.integers(len(texts))], [None, "", "a", "b", "c"][random.integers(5)]) for _ in range(70)]
    marks = [(int(random.integers(0, 95)), [None, 0, 1][random.integers(3)], [None, 0, 1][random.integers(3)]) for _ in range(120)] + [(None, 1, 1)]
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int").withColumn("id", F.lit(1)).withColumn("part", F.lit("x"))
    docs = docs_of(spark, [(i, t, "en", s) for i, t, s in rows]).withColumn("A", F.lit(True)).withColumn("print", F.lit(1)).withColumn("part", F.lit("y"))
    names = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    got = filteraudit.audited(docs, labels).collect()
    assert {(r.part, r.filter_order, r.step): [r[n] for n in names] for r in got} == audited(rows, marks) and len(got) == 4 * 600
    assert filteraudit.audited(none, labels).count() == 0
    assert {r.good_lost for r in filteraudit.audited(docs, labels.limit(0)).collect()} == {0}


def nodes(conversations):
    """The trie's nodes by their paths."""
    own = collections.defaultdict(list)
    for c, turn, role, text in conversations:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", hashlib.sha256((text or "").encode()).digest(), text or ""))
    turns = {c: [(r, x) for _, _, r, _, x in sorted(t)] for c, t in own.items()}
    built = {}
    for c, t in turns.items():
        h, first = zlib.crc32(str(c).encode()) % 4, c - int(np.fmod(c, 20))
        built[c] = turns.get(first, [])[:h] + t[h:]
    members = collections.defaultdict(list)
    for c, t in built.items():
        for d in range(len(t) + 1):
            members[tuple(t[:d])].append(c)
    children, below, saved = collections.Counter(p[:-1] for p in members if p), collections.Counter(), collections.Counter()
    for p, m in members.items():
        for d in range(len(p) + 1):
            below[p[:d]] += not children[p]
            saved[p[:d]] += (len(m) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
    return sorted(
        (min(m), len(p), -1 if not p else min(members[p[:-1]]), len(m), children[p], below[p], saved[p], sha(",".join(str(c) for c in sorted(m) if len(built[c]) == len(p)))) for p, m in members.items()
    )


@pytest.mark.parametrize("block, chunk, by_shuffle", [(4096, 65_536, False), (4096, 3, True), (1, 1, False), (3, 2, True)])
def test_prefix_trie(spark, monkeypatch, block, chunk, by_shuffle):
    """Random conversations that share beginnings, many alike, one of a third of all turns, ties, nulls, negative and missing identifiers."""
    if by_shuffle:
        shuffled(monkeypatch, prefixtrie)
    random = np.random.default_rng(7)
    rows = []
    for c in [*range(-30, 70), *range(200, 230), 5_000_000_000]:
        if c % 20 == 0 and c % 40:  # some groups lack their first
            continue
        for k in range(random.integers(1, 7)):
            rows.append((c, [k, None][int(random.random() < 0.1)], [None, "", "user", "assistant"][random.integers(4) if k > 1 else 2], ["a b", None, "", " c\td ", "e" * 500][random.integers(5) if k > 1 else 0]))
    for c in range(300, 340):
        rows += [(c, k, "user", f"same {k}") for k in range(4)]
    rows += [(211, k, "user", f"turn {k % 5}") for k in range(40)] + [(211, 7, "user", "tie")] * 3 + [(212, k, "user", f"turn {k % 5}") for k in range(25)]
    rows += [(None, 0, "user", "nobody's"), (None, None, None, None)] * 5
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("conv", F.lit(1)).withColumn("digest", F.lit(2)).withColumn("place", F.lit(3)).repartition(3)
    found = prefixtrie.trie(*prefixtrie.rebuilt(*prefixtrie.turns(table)), block=block, chunk=chunk).collect()
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert sorted(tuple(-1 if r[n] is None and n == "parent_conv_id" else r[n] for n in names) for r in found) == nodes(rows)


def test_prefix_trie_of_nothing(spark):
    table = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert prefixtrie.trie(*prefixtrie.rebuilt(*prefixtrie.turns(table))).count() == 0
    table = spark.createDataFrame([(None, 1, "user", "x")], table.schema)
    assert prefixtrie.trie(*prefixtrie.rebuilt(*prefixtrie.turns(table))).count() == 0
    bare = spark.createDataFrame([(1, 1, "user", "x")], table.schema)  # h is 3 or under and its group's first does not exist
    found = prefixtrie.trie(*prefixtrie.rebuilt(*prefixtrie.turns(bare))).collect()
    assert [r.n_convs for r in found] == [1] * len(found) and {r.depth for r in found} == ({0} if zlib.crc32(b"1") % 4 else {0, 1})


@pytest.mark.parametrize("name", ["op11_line_dedup", "op12_filter_audit", "op13_prefix_trie"])
def test_same_as_sql(spark, name):
    import duckdb

    from sightline.llm import queries

    con = duckdb.connect()
    for t in ("documents", "labels", "conversations"):
        con.execute(f"create view {t} as select * from '/root/testdata/sf0.001/{t}.parquet'")
    want = con.execute(queries.ORACLES[name])
    columns = [d[0] for d in want.description]
    got = queries.QUERIES[name](spark, "/root/testdata/sf0.001")
    assert sorted(got.columns) == sorted(columns)
    assert sorted((tuple(r) for r in got.select(columns).collect()), key=repr) == sorted(want.fetchall(), key=repr)
