"""Near-duplicates, decontamination and embeddings against brute force and on awkward rows."""

import itertools
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexsieve.llm import buckets, decontam, embed, minhash
from lexsieve.llm.components import components
from lexsieve.llm.tokens import U, mix

SF = "/root/testdata/sf0.001"


def _groups(pairs):
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {x: find(x) for x in up}


def _slow_superminhash(seeds, m):
    """One element at a time, without early stopping."""
    sig = [2**64 - 1] * m
    for s in seeds:
        perm = list(range(m))
        for k in range(m):
            r = int(mix(np.array([(int(s) + (k + 1) * 0x9E3779B97F4A7C15) % 2**64], U))[0])
            at = k + ((r >> 32) * (m - k) >> 32)
            perm[k], perm[at] = perm[at], perm[k]
            sig[perm[k]] = min(sig[perm[k]], k << 32 | r & 0xFFFFFFFF)
    return sig


def test_superminhash():
    rng = np.random.default_rng(3)
    sizes = [1, 2, 7, 40, 300]
    seeds = rng.integers(0, 2**63, sum(sizes), dtype=U)
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    got = minhash.superminhash(seeds, bounds, 16)
    for d in range(len(sizes)):
        assert got[d].tolist() == _slow_superminhash(seeds[bounds[d] : bounds[d + 1]], 16)


def test_superminhash_estimates():
    rng = np.random.default_rng(4)
    for share in (0.2, 0.5, 0.8):
        seen = []
        for _ in range(30):
            n = int(200 * share)
            both = rng.integers(0, 2**63, n, dtype=U)
            a, b = (np.concatenate([both, rng.integers(0, 2**63, (200 - n) // 2, dtype=U)]) for _ in range(2))
            s = minhash.superminhash(mix(np.concatenate([a, b])), np.array([0, len(a), len(a) + len(b)]))
            seen.append((s[0] == s[1]).mean() - n / (2 * len(a) - n))
        assert abs(np.mean(seen)) < 0.03


def test_components(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(i, i + 1) for i in range(1000, 1060)] + [(7, 7)]
    df = spark.createDataFrame([*edges, (None, 3)], "a bigint, b bigint").repartition(7)
    got = {r.node: r.root for r in components(df).collect()}
    want = _groups([e for e in edges if e[0] != e[1]])
    assert got == want


def _sets(docs, words):
    out = {}
    for doc_id, text in docs:
        w = words(text)
        out[doc_id] = {tuple(w[i : i + 3]) for i in range(max(1, len(w) - 2))} if w else set()
    return out


def test_near_duplicates(spark, words):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    sets = _sets([tuple(r) for r in docs.collect()], words)
    where = defaultdict(list)
    for i, s in sets.items():
        for g in s:
            where[g].append(i)
    shared = defaultdict(int)
    for ids in where.values():
        for a, b in itertools.combinations(ids, 2):
            shared[a, b] += 1
    true = [p for p, n in shared.items() if n >= minhash.THRESHOLD * (len(sets[p[0]]) + len(sets[p[1]]) - n)]
    rows = minhash.near_duplicates(docs).collect()
    got = {r.doc_id: r.group_id for r in rows}
    together = sum(got.get(a) is not None and got.get(a) == got.get(b) for a, b in true)
    assert together >= 0.9 * len(true)
    want = _groups(true)
    assert all(want.get(a) == want.get(b) for a, b in got.items())  # no false member
    assert all(r.keep == (r.doc_id == r.group_id) for r in rows)
    size = Counter(got.values())
    assert all(r.links == size[r.group_id] - 1 > 0 for r in rows)


def test_hot_bucket(spark, monkeypatch, words):
    """Many documents that share a passage but aren't near, among them groups of copies; all rounds are used."""
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    common = [word() for _ in range(30)]
    rows = []
    for g in range(25):
        own = [word() for _ in range(34)]
        for c in range(3):
            text = common + own
            text[40 + c] = word()
            rows.append((g * 3 + c, " ".join(text)))
    monkeypatch.setattr(buckets, "LEADER_ROUNDS", 1)
    got = {r.doc_id: r.group_id for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == {i: i - i % 3 for i, _ in rows}


def test_prefix_pairs(spark, words):
    """Sets that share much that is common, some of which are near: no near pair is lost, few others are formed."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    common = [word() for _ in range(40)]
    rows = []
    for g in range(120):
        own = [word() for _ in range(rng.randrange(1, 90))]
        rows.append((2 * g, " ".join(common + own)))
        rows.append((2 * g + 1, " ".join(common + own[: len(own) * 2 // 3] + [word() for _ in range(rng.randrange(0, 50))])))
    rows += [(1000 + i, "same start " + word()) for i in range(50)] + [(2000, "x"), (2001, "x y")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    sigs = docs.mapInArrow(minhash.signatures, "doc_id bigint, fp bigint, fq bigint, bands array<bigint>, grams binary").cache()
    items = docs.selectExpr("doc_id as id", "doc_id as root")
    pairs = {(r.a, r.b) for r in minhash.prefix_pairs(items, sigs, 0.5).collect()}
    sets = _sets(rows, words)
    near = {(a, b) for a, b in itertools.combinations(sorted(sets), 2) if len(sets[a] & sets[b]) >= 0.5 * len(sets[a] | sets[b])}
    assert near <= pairs and len(near) > 100
    assert all(a < b for a, b in pairs) and len(pairs) < 0.4 * len(rows) ** 2 / 2
    assert {(r.a, r.b) for r in minhash.prefix_pairs(items.withColumn("root", F.lit(1).cast("bigint")), sigs, 0.5).collect()} == set()


def test_large_unlinked_buckets(spark, monkeypatch):
    """Buckets beyond the pairwise size are searched by the exact way; results stay the same."""
    monkeypatch.setattr(buckets, "PAIRWISE", 1)
    monkeypatch.setattr(buckets, "LEADER_ROUNDS", 1)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    some = {tuple(r) for r in minhash.near_duplicates(docs).collect()}
    monkeypatch.setattr(buckets, "PAIRWISE", 10**9)
    assert some == {tuple(r) for r in minhash.near_duplicates(docs).collect()} and some
    rng = np.random.default_rng(12)
    x = rng.normal(size=(300, 16))
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(1000 + i, _near(rng, v, 0.95).tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    monkeypatch.setattr(embed, "BLOCK", 100)
    units = df.mapInArrow(embed._hashed, "vec_id bigint, unit binary, keys array<bigint>").select("vec_id", "unit").cache()
    items = df.selectExpr("vec_id % 2 as key", "vec_id as id", "vec_id as root")
    got = {(r.a, r.b) for r in embed.block_pairs(items, units, 0.9).collect()}
    m = np.stack([np.array(v) / np.linalg.norm(v) for _, v in rows])
    ids = [i for i, _ in rows]
    assert got == {(ids[a], ids[b]) for a, b in zip(*np.nonzero(np.triu(m @ m.T >= 0.9, 1))) if ids[a] % 2 == ids[b] % 2} and len(got) > 250


def test_chains(spark, words):
    """A~B, B~C, but not A~C: of 100 such groups at least 90 are found whole, though B matches A, which leads their buckets."""
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(7))
    rows = []
    for g in range(100):
        b = [word() for _ in range(200)]
        c = b[:139] + [word() for _ in range(61)]
        a = list(b)
        for at in (20, 60, 100):
            a[at] = word()
        rows += [(3 * g + k, " ".join(t)) for k, t in enumerate((a, b, c))]
    sets = _sets(rows, words)
    like = lambda x, y: len(sets[x] & sets[y]) / len(sets[x] | sets[y])
    assert all(like(3 * g, 3 * g + 1) > 0.9 and like(3 * g + 1, 3 * g + 2) >= 0.5 > like(3 * g, 3 * g + 2) for g in range(100))
    got = {r.doc_id: r.group_id for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert all(g == i - i % 3 for i, g in got.items())
    assert sum(3 * g + 2 in got and 3 * g + 1 in got for g in range(100)) >= 90


def test_near_duplicates_awkward(awkward, nothing):
    got = {r.doc_id: (r.group_id, r.keep) for r in minhash.near_duplicates(awkward).collect()}
    assert got == {1: (1, True), 2: (1, False), 3: (1, False)}
    kept = minhash.drop_near_duplicates(awkward)
    assert kept.columns == awkward.columns
    ids = sorted((r.doc_id is None, r.doc_id) for r in kept.select("doc_id").collect())
    assert [i for none, i in ids if not none] == [1, 4, 5, 6, 7, 8, 9, 10] and sum(none for none, _ in ids) == 1  # the copy without an id goes, the null text stays
    assert minhash.near_duplicates(nothing).count() == 0 and minhash.drop_near_duplicates(nothing).count() == 0


def test_near_duplicates_repeated_ids(spark):
    """Each row is judged by its own text."""
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    rows = [(1, b), (1, a), (2, a), (3, b + " more"), (4, None), (4, ""), (4, c)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    assert {(r.doc_id, r.text) for r in minhash.drop_near_duplicates(docs).collect()} == {(1, a), (1, b), (4, None), (4, ""), (4, c)}
    assert {(r.doc_id, r.group_id, r.keep) for r in minhash.near_duplicates(docs).collect()} == {(1, 1, True), (2, 1, False), (3, 1, False)}


def _brute_exact(docs, items, words, n):
    out = set()
    items = {i: words(t) for i, t in items if i is not None and t is not None}
    for doc_id, text in docs:
        d = words(text)
        if doc_id is None:
            continue
        for i, t in items.items():
            if not t:
                continue
            k = min(n, len(t))
            for shift in range(-len(t) + 1, len(d)):
                run = 0
                for j in range(len(t) + 1):
                    if j < len(t) and 0 <= shift + j < len(d) and d[shift + j] == t[j]:
                        run += 1
                        continue
                    if run >= k:
                        out.add((i, doc_id, j - run, shift + j - run, run))
                    run = 0
    return out


def _brute_near(docs, items, words):
    out = {}
    for doc_id, text in docs:
        d = words(text)
        for i, t in items:
            t = words(t)
            if doc_id is None or i is None or not t:
                continue
            places = defaultdict(list)
            for p, w in enumerate(d):
                places[w].append(p)
            need = len(t) - int((1 - decontam.SHARE) * len(t) + 1e-9)
            leads = {p - j - s for j, w in enumerate(t) for p in places[w] for s in range(decontam.SLOP + 1)}
            best = max((sum(any(lead + j <= p <= lead + j + decontam.SLOP for p in places[w]) for j, w in enumerate(t)) for lead in leads), default=0)
            if best >= need:
                out[i, doc_id] = best
    return out


@pytest.fixture(scope="module")
def passages():
    rng = random.Random(8)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(1, 4))) for _ in range(60)]
    text = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(i, text(rng.randrange(4, 40))) for i in range(12)]
    docs = []
    for k in range(60):
        d = text(rng.randrange(0, 120))
        i, t = rng.choice(items)
        at = rng.randrange(len(d) + 1)
        t = list(t)
        if k % 3 == 1:  # part of it
            t = t[rng.randrange(len(t)) :]
        if k % 3 == 2:  # edited
            for _ in range(len(t) // 8):
                j = rng.randrange(len(t))
                t[j : j + 1] = rng.choice([[], ["new"], [t[j], "new"]])
        docs.append((k, " ".join([*d[:at], *t, *d[at:]])))
    return docs, [(i, " ".join(t)) for i, t in items] + [(90, "too short"), (91, None), (92, "a"), (93, "b c d"), (94, "!"), (None, "a b c d e f")]


def test_decontamination(spark, words, passages, monkeypatch):
    docs, items = passages
    d = spark.createDataFrame([*docs, (500, None), (None, docs[0][1]), (501, "")], "doc_id bigint, text string").repartition(3)
    b = spark.createDataFrame(items, "item_id bigint, text string")
    for size in (decontam.BLOCK_BYTES, 300):  # searched at once, and in blocks
        monkeypatch.setattr(decontam, "BLOCK_BYTES", size)
        rows = decontam.find_matches(decontam.build_index(d), b).collect()
        exact = {(r.item_id, r.doc_id, r.item_pos, r.doc_pos, r.n_tokens) for r in rows if r.kind == "exact"}
        assert exact == _brute_exact(docs, items, words, decontam.N)
        pairs = {(i, k) for i, k, *_ in exact}
        near = {(r.item_id, r.doc_id): r.n_tokens for r in rows if r.kind == "proximity"}
        want = {k: n for k, n in _brute_near(docs, [x for x in items if x[1]], words).items() if k not in pairs}
        assert near == want and near


def test_decontamination_awkward(spark, awkward, nothing):
    b = spark.createDataFrame([(1, "crimson turbines hum beside frozen lakes and nobody hears them at noon"), (2, None), (3, "")], "item_id bigint, text string")
    kept = decontam.drop_contaminated(awkward, b)
    assert kept.columns == awkward.columns and kept.where("doc_id = 9").count() == 0 and kept.count() == awkward.count() - 2
    assert decontam.drop_contaminated(awkward, b.where("false")).count() == awkward.count()
    assert decontam.drop_contaminated(nothing, b).count() == 0


def test_decontamination_rows(spark):
    """Rows of null doc_id are searched too, and each row is judged by its own text."""
    item = " ".join(f"w{i}" for i in range(20))
    rows = [(None, "see " + item), (None, "clean text without it"), (1, item + " end"), (1, "clean as well"), (2, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    kept = decontam.drop_contaminated(docs, spark.createDataFrame([(7, item)], "item_id bigint, text string"))
    assert {(r.doc_id, r.text) for r in kept.collect()} == {(None, "clean text without it"), (1, "clean as well"), (2, None)}


def test_hadamard():
    h = np.array([[1.0]])
    while len(h) < 16:
        h = np.block([[h, h], [h, -h]])
    x = np.random.default_rng(1).normal(size=(5, 16))
    assert np.allclose(embed.hadamard(x), x @ h / 4)


def _brute_classes(rows, threshold):
    """vec_id -> (class, links) by all pairs."""
    m = np.stack([v for _, v in rows])
    m = m / np.linalg.norm(m, axis=1, keepdims=True)
    a, b = np.nonzero(m @ m.T >= threshold)
    ids = [i for i, _ in rows]
    group = _groups([(ids[x], ids[y]) for x, y in zip(a, b)])
    size = Counter(group.values())
    return {i: (g, size[g] - 1) for i, g in group.items()}


def _near(rng, v, cosine):
    z = rng.normal(size=len(v))
    z -= (z @ v) * v / (v @ v)
    return cosine * v / np.linalg.norm(v) + np.sqrt(1 - cosine * cosine) * z / np.linalg.norm(z)


@pytest.mark.parametrize("dim,n", [(48, 150), (300, 80), (768, 60)])
def test_embeddings(spark, dim, n):
    """Recall of at least 0.9 near the threshold, whatever the length, and nothing below it."""
    rng = np.random.default_rng(2)
    rows = []
    for i in range(n):
        v = rng.normal(size=dim)
        rows += [(2 * i, v), (2 * i + 1, _near(rng, v, 0.905))]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in rows], "vec_id bigint, embedding array<float>")
    got = {r.vec_id: (r.class_id, r.links) for r in embed.near_groups(df).collect()}
    want = _brute_classes(rows, embed.THRESHOLD)
    assert set(got) == set(want) and sum(w == (2 * (i // 2), 1) for i, w in want.items()) == 2 * n
    assert all(g in (want[i], (i, 0)) for i, g in got.items())
    assert sum(got[2 * i + 1] == (2 * i, 1) for i in range(n)) >= 0.9 * n


def test_embeddings_hot(spark):
    """One vector a thousand times, and a hundred vectors near it, are one class with a row each."""
    rng = np.random.default_rng(3)
    v = rng.normal(size=32)
    rows = [(i, v) for i in range(1000)] + [(1000 + i, _near(rng, v, 0.97)) for i in range(100)] + [(2000 + i, rng.normal(size=32)) for i in range(50)]
    df = spark.createDataFrame([(i, x.tolist()) for i, x in rows], "vec_id bigint, embedding array<double>").repartition(5)
    got = {r.vec_id: (r.class_id, r.links) for r in embed.near_groups(df).collect()}
    assert got == _brute_classes(rows, embed.THRESHOLD) and got[1050] == (0, 1099)


def test_embeddings_awkward(spark):
    nan = float("nan")
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (2, [2.0, 0.0]), (3, None), (None, [1.0, 0.0]), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [None, 1.0]), (7, [1.0, 0.0, 0.0]), (8, []), (9, [3.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").selectExpr("*", "1 as keys", "'u' as unit", "2 as class_id")
    assert sorted((r.vec_id, r.class_id, r.links) for r in embed.near_groups(df).collect()) == [(1, 1, 1), (2, 1, 1), (7, 7, 0), (9, 9, 0)]
    assert embed.near_groups(df.where("false")).count() == 0
