"""Token kernel, language ID, quality, LM scores and licences against brute force and on awkward rows."""

import math
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from lexsieve.llm import langid, license, lm, quality, tokens

SF = "/root/testdata/sf0.001"


def test_tokens(words):
    texts = ["Hello, World", "", None, "a_b c1 É", "x", "日本 語", "no-end", " lead"]
    t = tokens.tokenise(pa.array(texts))
    want = [words(x) for x in texts]
    assert t.counts.tolist() == [len(w) for w in want]
    seen = {}
    for w, h in zip([w for ws in want for w in ws], t.hash.tolist()):
        assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)
    h, bounds = tokens.shingles(t, 3)
    assert np.diff(bounds).tolist() == [max(len(w) - 2, min(len(w), 1)) for w in want]
    rows = [x for _, part in tokens.slices(pa.array(texts), 5) for x in part.to_pylist()]
    assert rows == [x or "" for x in texts]


def test_language_vectors():
    """Document vectors against the definition, letter by letter."""
    space = langid.Space(256)
    texts = ["Abc, abd!", "", "é1é é", "ab"]
    got, n = space.documents(tokens.strings(pa.array(texts)))
    vec = lambda c: langid._letter_vector(ord(c), 256).astype(int)
    for text, v, k in zip(texts, got, n):
        s = ""
        for c in text.lower():
            if c.isalpha():
                s += c
            elif s and s[-1] != " ":
                s += " "
        want = np.zeros(256)
        for a, b, c in zip(s, s[1:], s[2:]):
            want += np.roll(vec(a), 2) * np.roll(vec(b), 1) * vec(c)
        assert k == max(0, len(s) - 2) and (v == want).all()


def test_many_letters():
    """Scripts beyond the direct table, and a full table, change nothing."""
    texts = ["".join(chr(0x4E00 + (i * 7 + j) % 300) for j in range(50)) for i in range(20)] + ["plain words here"]
    arr = tokens.strings(pa.array(texts))
    a, _ = langid.Space(128).documents(arr)
    space = langid.Space(128)
    b = []
    for i in range(len(texts)):
        space.MOST = 10
        b.append(space.documents(arr.slice(i, 1))[0][0])
    assert (a == np.stack(b)).all()


def test_language_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [r for r in langid.identify_languages(docs).collect()]
    assert np.mean([r.lang == r.detected for r in rows if r.accepted]) > 0.97
    assert np.mean([r.accepted for r in rows]) > 0.97


def test_language_awkward(spark, awkward, nothing):
    rows = langid.identify_languages(awkward).collect()
    assert len(rows) == awkward.count()
    for r in rows:
        if r.doc_id in (4, 5, 6):
            assert r.detected is None and not r.accepted and r.cosine == 0
    kept = langid.keep_identified(awkward)
    assert kept.columns == awkward.columns and kept.where("doc_id = 9").count() == 2
    assert langid.identify_languages(nothing).count() == 0 and langid.keep_identified(nothing).count() == 0
    untrained = langid.profiles(nothing)
    assert not any(r.accepted or r.detected for r in langid.identify_languages(awkward, untrained).collect())


def _trigrams(text):
    s = ""
    for c in (text or "").lower():
        if c.isalpha():
            s += c
        elif s and s[-1] != " ":
            s += " "
    return Counter(zip(s, s[1:], s[2:]))


def test_language_brute_force(spark):
    """The whole operator, trigram by trigram; all labelled documents train."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("n_chars < 4000")
    rows = docs.collect()
    assert max(Counter(r.lang for r in rows).values()) <= langid.TRAIN_PER_LANG
    letter, gram = {}, {}

    def vector(text):
        out = np.zeros(langid.DIM)
        for t, n in _trigrams(text).items():
            if t not in gram:
                a, b, c = (letter.setdefault(x, langid._letter_vector(ord(x), langid.DIM).astype(float)) for x in t)
                gram[t] = np.roll(a, 2) * np.roll(b, 1) * c
            out += n * gram[t]
        return out / max(np.linalg.norm(out), 1e-30)

    vectors = {r.doc_id: vector(r.text) for r in rows}
    names = sorted({r.lang for r in rows})
    prototypes = np.stack([sum(vectors[r.doc_id] for r in rows if r.lang == k) for k in names])
    prototypes /= np.linalg.norm(prototypes, axis=1, keepdims=True)
    length = {r.doc_id: sum(_trigrams(r.text).values()) for r in rows}
    by_length = defaultdict(list)
    for r in rows:
        if length[r.doc_id]:
            by_length[int(math.log2(length[r.doc_id]))].append(vectors[r.doc_id] @ prototypes[names.index(r.lang)])
    least, last = [], langid.MIN_COSINE
    for k in range(63):
        if len(by_length[k]) >= langid.KNOWN:
            last = max(langid.MIN_COSINE, langid.LENIENCE * np.quantile(by_length[k], langid.QUANTILE))
        least.append(last)
    got = {r.doc_id: r for r in langid.identify_languages(docs).collect()}
    sure = 0
    for i, v in vectors.items():
        cos = prototypes @ v
        order = np.argsort(-cos)
        want = (cos[order[0]], cos[order[0]] - cos[order[1]])
        assert got[i].detected == (names[order[0]] if length[i] else None)
        assert (got[i].cosine, got[i].margin) == pytest.approx(want if length[i] else (0, 0), abs=1e-5)
        slack = [want[0] - least[int(math.log2(max(length[i], 1)))], want[1] - langid.MIN_MARGIN]
        if min(map(abs, slack)) > 1e-4 or not length[i]:
            sure += 1
            assert got[i].accepted == (length[i] > 0 and min(slack) > 0)
    assert sure > 0.95 * len(rows)


def test_language_gibberish(spark):
    """Random letters and scripts without a prototype are rejected, declared documents are kept."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rng = np.random.default_rng(6)
    word = lambda a, n: "".join(chr(c) for c in rng.integers(a, a + n, rng.integers(3, 9)))
    odd = [(i, " ".join(word(*[(97, 26), (0x430, 32), (0x3B1, 25)][i % 3]) for _ in range([60, 300, 2000][i // 3 % 3]))) for i in range(90)]
    model = langid.profiles(docs)
    bad = langid.identify_languages(spark.createDataFrame(odd, "doc_id bigint, text string").selectExpr("*", "'xx' as lang"), model).collect()
    assert np.mean([r.accepted for r in bad]) < 0.05
    assert np.mean([r.accepted for r in langid.identify_languages(docs, model).collect()]) > 0.98


def test_language_trains_on_all(spark):
    """More documents of a language than round 1's sample had: prototypes and thresholds are those of every one of them."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = docs.collect()
    assert max(Counter(r.lang for r in rows).values()) > 400
    vectors, n = langid.Space().documents(tokens.strings(pa.array([r.text for r in rows])))
    vectors = vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-30).astype(float)
    names = sorted({r.lang for r in rows})
    of = np.array([names.index(r.lang) for r in rows])
    prototypes = np.stack([vectors[of == i].sum(0) for i in range(len(names))])
    cos = vectors @ (prototypes / np.linalg.norm(prototypes, axis=1, keepdims=True)).T
    length, own, top = np.log2(np.maximum(n, 1)).astype(int), cos[np.arange(len(rows)), of], np.sort(cos, 1)
    least, last = [], langid.MIN_COSINE
    for k in range(63):
        here = own[(length == k) & (n > 0)]
        if len(here) >= langid.KNOWN:
            last = max(langid.MIN_COSINE, langid.LENIENCE * np.quantile(here, langid.QUANTILE))
        least.append(last)
    got = {r.doc_id: r for r in langid.identify_languages(docs).collect()}
    for r, k, c, m in zip(rows, n, top[:, -1], top[:, -1] - top[:, -2]):
        assert (got[r.doc_id].cosine, got[r.doc_id].margin) == pytest.approx((c, m) if k else (0, 0), abs=3e-6)
    sure = [(got[r.doc_id].accepted, k > 0 and min(slack) > 0) for r, k, *slack in zip(rows, n, top[:, -1] - np.array(least)[length], top[:, -1] - top[:, -2] - langid.MIN_MARGIN) if min(map(abs, slack)) > 1e-5]
    assert len(sure) > 0.95 * len(rows) and all(a == b for a, b in sure)
    model, again = langid.profiles(docs), langid.profiles(docs.repartition(5))
    assert model.least == pytest.approx(least, abs=2e-6) and (again.least == model.least).all()
    assert (again.blocks[0][1] == model.blocks[0][1]).all() and again.blocks[0][0] == names


def test_many_languages(spark, monkeypatch):
    """Hundreds of declared languages all get a prototype, also in blocks and in parts of the sums."""
    rng = np.random.default_rng(8)
    words = [["".join(map(chr, rng.integers(97, 123, 5))) for _ in range(12)] for _ in range(300)]
    rows = [(3 * i + j, " ".join(rng.permutation(words[i])), f"l{i}") for i in range(300) for j in range(3)] + [(900, None, "l0"), (901, "", "none"), (902, words[0][0], None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    whole = sorted(langid.identify_languages(docs).collect(), key=lambda r: r.doc_id)
    assert len(whole) == len(rows) and all(r.detected == r.lang and r.accepted for r in whole[:900])
    assert [(r.detected, r.cosine, r.accepted) for r in whole[900:902]] == [(None, 0, False)] * 2 and whole[902].detected == "l0"
    monkeypatch.setattr(langid, "BROADCAST_BYTES", 4 * langid.DIM * 70)
    monkeypatch.setattr(langid, "SUMS", 2)
    for df in (langid.identify_languages(docs), langid.identify_languages(docs, model := langid.profiles(docs))):
        for a, b in zip(whole, sorted(df.collect(), key=lambda r: r.doc_id), strict=True):
            assert (a.doc_id, a.lang, a.detected, a.accepted) == (b.doc_id, b.lang, b.detected, b.accepted)
            assert (a.cosine, a.margin) == pytest.approx((b.cosine, b.margin), abs=3e-6)
    assert len(model.blocks) == 5 and [k for names, _ in model.blocks for k in names] == sorted({r[2] for r in rows if r[2]})
    kept = langid.keep_identified(docs.drop("lang"), model)
    assert kept.columns == ["doc_id", "text"] and {r.doc_id for r in kept.collect()} == {r.doc_id for r in whole if r.accepted}


def test_long_tokens():
    """Tokens and texts longer than what is hashed or worked on at once; the hash of a token doesn't depend on its place."""
    long = "ab" * tokens.HASH_BYTES
    texts = [long + " x " + long, "y", "x" * (tokens.SLICE_BYTES + 7), "é" * tokens.SLICE_BYTES + " end", "end " + long + "!"]
    t = tokens.tokenise(pa.array(texts))
    assert t.counts.tolist() == [3, 1, 1, 2, 2]
    h = t.hash.tolist()
    assert h[0] == h[2] == h[8] and h[6] == h[7] and len(set(h)) == 6
    assert tokens.tokenise(pa.array(texts[2:])).hash.tolist() == h[4:]


def test_quality_held_out(spark):
    """Fitted on half of the labels, judged on the other half."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").where("quality is not null")
    w = quality.train(docs, labels.where("doc_id % 2 = 0"))
    rows = quality.assess(docs, labels, w).join(labels.where("doc_id % 2 = 1"), "doc_id").collect()
    assert np.mean([(r.good >= 0.5) == (r.quality == 1) for r in rows]) > 0.95
    clean = [r.keep for r in rows if r.quality == 1 and r[-1] == 0]
    assert np.mean(clean) > 0.97


def test_posteriors(spark):
    """The shrunk means against a plain computation; a sparse site lies nearer its prior."""
    rng = np.random.default_rng(1)
    rows = [(f"h{i % 5}", f"h{i % 5}/p{i % 3}", float(z), 0.0) for i, z in enumerate(rng.normal(size=400) + [(i % 5) for i in range(400)])]
    rows.append(("h9", "h9/p0", -9.0, 0.0))
    got = {r.path: r for r in quality.posteriors(spark.createDataFrame(rows, "host string, path string, good double, toxic double")).collect()}
    p = lambda z: 1 / (1 + math.exp(-z))
    host, path = defaultdict(list), defaultdict(list)
    for h, s, z, _ in rows:
        host[h].append(p(z))
        path[h, s].append(p(z))
    m = np.mean([p(r[2]) for r in rows])
    strength = lambda m, v: min(max(m * (1 - m) / max(v, 1e-9) - 1, 1), 1e6)
    v = sum(len(x) * (np.mean(x) - m) ** 2 for x in host.values()) / len(rows)
    k = strength(m, v)
    hm = {h: (sum(x) + k * m) / (len(x) + k) for h, x in host.items()}
    v = sum(len(x) * (np.mean(x) - hm[h]) ** 2 for (h, _), x in path.items()) / len(rows)
    for (h, s), x in path.items():
        k = strength(hm[h], v)
        assert got[s].good_site == pytest.approx((sum(x) + k * hm[h]) / (len(x) + k))
    assert got["h9/p0"].good_site > p(-9.0) + 0.01


def test_quality_brute_force(spark, words):
    """The whole operator, word by word: classifier, site means, combination and decision."""
    rng = np.random.default_rng(9)
    good, bad, plain = (["%s%d" % (c, i) for i in range(30)] for c in ("fine", "awful", "usual"))
    rows, labels = [], []
    for i in range(400):
        q, t = int(rng.random() < 0.6), int(rng.random() < 0.2)
        own = list(rng.choice(plain, 25)) + list(rng.choice(good if q else bad, 6)) + (["venom"] * 2 if t else [])
        rng.shuffle(own)
        rows.append((i, " ".join(own).capitalize() + ".", "en", f"h{i % 4}/p{i % 3}" if i % 5 else None, None))
        if i % 2:
            labels.append((i, q, t))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, good string")
    known = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    by_id = {r[0]: r for r in rows}
    bits = quality.WORD_BITS

    def hashed(text):
        """Features of a text, from the tokens one at a time."""
        out = set()
        for w in words(text):
            t = tokens.tokenise(pa.array([w]))
            out.add(int(t.hash[0]) >> (64 - bits))
            for k in quality.PREFIXES:
                if len(w.encode()) > k:
                    out.add(int(t.prefixes(k)[0][0]) >> (64 - bits))
        return out

    def shape(text):
        raw, w = text.encode(), words(text)
        n = max(len(w), 1)
        up, low = sum(65 <= b < 91 for b in raw), sum(97 <= b < 123 for b in raw)
        count = lambda chars: sum(chr(b) in chars for b in raw if b < 128)
        quiet = ".,;:'\"-?"
        signs = sum(33 <= b < 127 and not chr(b).isalnum() and chr(b) not in quiet for b in raw)
        return [1, up / max(up + low, 1), count("0123456789") / max(len(raw), 1), min(signs / n, 2), min(count(quiet) / n, 2), len(set(w)) / n, sum(a == b for a, b in zip(w, w[1:])) / n, math.log1p(len(w)) / 10, count(" \t\r\n") / max(len(raw), 1)]

    feature = {r[0]: hashed(r[1]) for r in rows}
    shapes = {r[0]: np.array(shape(r[1])) for r in rows}

    def fit(y):
        ids = sorted(y)
        total, of_class = Counter(), Counter()
        for i in ids:
            total.update(feature[i])
            if y[i]:
                of_class.update(feature[i])
        q = np.mean([y[i] for i in ids])
        used = []
        for f, n in total.items():
            a = of_class[f]
            g2 = 2 * sum(k * math.log(max(k / n / p, 1e-9)) for k, p in ((a, q), (n - a, 1 - q)))
            if g2 >= quality.MIN_G2:
                used.append(f)
        used.sort()
        x = np.array([[f in feature[i] for f in used] for i in ids], float)
        z = np.stack([shapes[i] for i in ids])
        both, target = np.hstack([x, z]), np.array([y[i] for i in ids], float)
        theta, m, v = np.zeros(both.shape[1]), 0.0, 0.0
        theta[len(used)] = math.log(q / (1 - q))
        ridge = np.array([2e-4] * len(used) + [1e-5] * quality.SHAPE)
        for k in range(1, 251):
            e = (1 / (1 + np.exp(-np.clip(both @ theta, -30, 30))) - target) / len(ids)
            g = both.T @ e + ridge * theta
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            theta = theta - 0.15 * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-8)
        return {i: float(np.clip(sum(t for f, t in zip(used, theta) if f in feature[i]) + shapes[i] @ theta[len(used) :], -12, 12)) for i in by_id}

    p = lambda z: 1 / (1 + math.exp(-z))
    logit = lambda x: math.log(x / (1 - x))
    where = lambda r: ("\0", "\0/en") if r[3] is None else (r[3].split("/")[0], r[3])
    want = defaultdict(dict)
    for name, column in (("good", 1), ("toxic", 2)):
        z = fit({r[0]: r[column] for r in labels})
        host, path = defaultdict(list), defaultdict(list)
        for i, r in by_id.items():
            host[where(r)[0]].append(p(z[i]))
            path[where(r)].append(p(z[i]))
        base = np.mean([p(x) for x in z.values()])
        strength = lambda m, v: min(max(m * (1 - m) / max(v, 1e-9) - 1, 1), 1e6)
        k = strength(base, sum(len(x) * (np.mean(x) - base) ** 2 for x in host.values()) / len(z))
        hm = {h: (sum(x) + k * base) / (len(x) + k) for h, x in host.items()}
        spread = sum(len(x) * (np.mean(x) - hm[h]) ** 2 for (h, _), x in path.items()) / len(z)
        site = {s: (sum(x) + strength(hm[s[0]], spread) * hm[s[0]]) / (len(x) + strength(hm[s[0]], spread)) for s, x in path.items()}
        for i, r in by_id.items():
            want[i][name] = p(z[i] + quality.SITE_WEIGHT * (logit(site[where(r)]) - logit(base)))
    got = {r.doc_id: r for r in quality.assess(docs, known).collect()}
    assert set(got) == set(by_id)
    for i, r in got.items():
        assert (r.good, r.toxic) == pytest.approx((want[i]["good"], want[i]["toxic"]), abs=2e-3)
        if min(abs(want[i]["good"] - quality.MIN_GOOD), abs(want[i]["toxic"] - quality.MAX_TOXIC)) > 5e-3:
            assert r.keep == (want[i]["good"] >= quality.MIN_GOOD and want[i]["toxic"] < quality.MAX_TOXIC)
    assert {r.doc_id for r in quality.keep_good(docs, known).collect()} == {i for i, r in got.items() if r.keep}


def test_quality_awkward(spark, awkward, nothing):
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (9, 1, 1), (77, 1, 0), (None, 1, 0), (8, None, None)], "doc_id bigint, quality int, toxic int")
    none = labels.where("false")
    for known in (labels, none):
        assert quality.assess(awkward, known).count() == awkward.count()
        kept = quality.keep_good(awkward, known)
        assert kept.columns == awkward.columns
        assert quality.assess(nothing, known).count() == 0 and quality.keep_good(nothing, known).count() == 0
    assert quality.keep_good(awkward, none).count() == awkward.count()


def _brute_scores(docs, held):
    """Deleted interpolation with dictionaries."""
    c = [Counter() for _ in range(6)]
    test = Counter()
    for doc_id, text in docs:
        b = b"\0" * 4 + (text or "").lower().encode()
        for i in range(4, len(b)):
            if held(doc_id):
                test[b[i - 4 : i + 1]] += 1
            else:
                for k in range(1, 6):
                    c[k][b[i - k + 1 : i + 1]] += 1
    ctx = [Counter() for _ in range(6)]
    for k in range(1, 6):
        for g, n in c[k].items():
            ctx[k][g[:-1]] += n

    def terms(g):
        out = [1 / 256]
        for k in range(1, 6):
            n = ctx[k][g[5 - k : 4]]
            out.append(c[k][g[5 - k :]] / n if n else 0.0)
        return np.array(out), int(math.floor(math.log2(ctx[5][g[:4]] + 1)))

    lam = {}
    for _ in range(lm.EM_STEPS):
        sums = defaultdict(lambda: np.zeros(6))
        for g, n in test.items():
            t, b = terms(g)
            r = lam.get(b, np.full(6, 1 / 6)) * t
            sums[b] += n * r / r.sum()
        new = {b: s / s.sum() for b, s in sums.items()}
        moved = max((abs(new[b] - lam.get(b, np.full(6, 1 / 6))).max() for b in new), default=0)
        lam = new
        if moved < lm.EM_CHANGE:
            break
    out = []
    for doc_id, text in docs:
        b = b"\0" * 4 + (text or "").lower().encode()
        total = 0.0
        for i in range(4, len(b)):
            t, k = terms(b[i - 4 : i + 1])
            total += math.log((lam.get(k, np.full(6, 1 / 6)) * t).sum())
        out.append((doc_id, len(b) - 4, round(total, 3)))
    return out


def test_lm_scores(spark):
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{SF}/documents.parquet").where("n_chars < 900").select("doc_id", "text")
    held = {r[0] for r in docs.where(F.pmod(F.xxhash64(F.lit(4), "doc_id"), F.lit(lm.HELD_OUT)) == 0).collect()}
    assert held
    want = sorted(_brute_scores([tuple(r) for r in docs.collect()], held.__contains__))
    for most in (lm.BROADCAST_BYTES, 0):  # by lookup, and by join
        got = sorted((r.doc_id, r.n_bytes, round(r.log_prob, 3)) for r in lm.score(docs, most).collect())
        assert [g[:2] for g in got] == [w[:2] for w in want]
        assert max(abs(g[2] - w[2]) for g, w in zip(got, want)) < 0.02


def test_lm_awkward(spark, awkward, nothing):
    for most in (lm.BROADCAST_BYTES, 0):
        rows = lm.score(awkward, most).collect()
        assert len(rows) == awkward.count()
        assert all(r.n_bytes == 0 and r.log_prob == 0 and r.bits_per_byte is None for r in rows if r.doc_id in (4, 5))
        assert lm.score(nothing, most).count() == 0


def _brute_notices(docs, words, templates):
    """All alignments of all templates."""
    out = []
    known = []
    for name, template, phrases in templates:
        t, must = words(template), set()
        for ws in map(words, phrases):
            at = next(i for i in range(len(t)) if t[i : i + len(ws)] == ws)
            must |= set(range(at, at + len(ws)))
        known.append((name, t, must))
    for doc_id, text in docs:
        d = words(text)
        for k, (name, t, must) in enumerate(known):
            same = defaultdict(set)
            for i, w in enumerate(t):
                for j, v in enumerate(d):
                    if v == w:
                        same[j - i].add(i)
            out += [(doc_id, name, k, p) for p, got in same.items() if len(got) >= license.SHARE * len(t) - 1e-9 and must <= got]
    return sorted(out)


def test_licences(spark, words, awkward, nothing):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("n_chars < 3000").select("doc_id", "text")
    more = [(1001 + i, f"Some words. {t[1]}! And more." + " the of to" * i) for i, t in enumerate(license.TEMPLATES)]
    assert len(more) > 25
    more += [(2001, "Released under the MIT License. Released under the MIT License"), (2002, "General Public License, version 3"), (2003, "This work is licenced under the GNU General Public License, version 3"), (2004, "Version 2.0")]
    docs = docs.union(spark.createDataFrame(more, "doc_id bigint, text string"))
    got = sorted((r.doc_id, r.license, r.template, r.token_pos) for r in license.scan(docs).collect())
    assert got == _brute_notices([tuple(r) for r in docs.collect()], words, license.TEMPLATES)
    assert {r[0] for r in got} >= {m[0] for m in more[: len(license.TEMPLATES)]} | {2001, 2003}
    assert license.scan(awkward).count() == 0 and license.scan(nothing).count() == 0


def test_licence_table(spark, words):
    """Templates of a table; a null text, name and phrase list; long templates with edits."""
    long = [f"w{i % 37}x{i % 11}" for i in range(400)]
    table = [("L", " ".join(long), ["w0x0 w1x1"]), (None, "the seven words of this other template", None), ("none", None, ["x"])]
    templates = spark.createDataFrame(table, "license string, text string, phrases array<string>").selectExpr("*", "1 as doc_id")
    edited = list(long)
    for i in range(100, 170):
        edited[i] = "other"
    docs = [(1, "so: " + " ".join(long)), (2, " ".join(edited)), (3, " ".join(["y", *edited[1:]])), (4, " ".join(long[:200])), (5, "The seven words of this template"), (6, "see the seven words of this other template")]
    got = sorted((r.doc_id, r.license, r.template, r.token_pos) for r in license.scan(spark.createDataFrame(docs, "doc_id bigint, text string"), templates).collect())
    assert got == _brute_notices(docs, words, license.templates_of(templates)) and {r[0] for r in got} == {1, 2, 6}
    assert license.scan(spark.createDataFrame(docs, "doc_id bigint, text string"), templates.where("false")).count() == 0
