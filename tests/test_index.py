"""N-grams, the index, refresh, and that pruned and whole searches agree."""

import json

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from lexsieve import api
from lexsieve.functions import codec as C
from lexsieve.functions import grams as N
from lexsieve.operators import index as I
from lexsieve.operators import search as S
from lexsieve.plans import gram_query
from lexsieve.plans.spec import SearchSpec


def _slow_grams(b: bytes) -> set[bytes]:
    w = N.pair_weights()
    out = set()
    for i in range(len(b)):
        for n in range(3, 9):
            if i + n <= len(b):
                pairs = [int(w[b[k], b[k + 1]]) for k in range(i, i + n - 1)]
                if min(pairs[0], pairs[-1]) > max(pairs[1:-1], default=0):
                    out.add(b[i : i + n])
    return out


@given(st.binary(max_size=60) | st.text("aZ_ 1", max_size=60).map(str.encode))
@settings(max_examples=150, deadline=None)
def test_grams(b):
    assert set(N.grams_of(b)) == _slow_grams(b)
    assert set(N.distinct_grams(np.frombuffer(b, np.uint8)).to_pylist()) == _slow_grams(b)


@given(st.binary(min_size=0, max_size=20), st.binary(max_size=20), st.binary(max_size=20))
@settings(max_examples=100, deadline=None)
def test_grams_of_a_part_are_in_the_whole(a, b, c):
    assert set(N.grams_of(b)) <= set(N.grams_of(a + b + c))


def test_gram_cases():
    w = N.pair_weights()
    weight = lambda s: int(w[ord(s[0]), ord(s[1])])
    assert weight("ZX") > weight("th") and weight("  ") < weight("Q_") and w.min() == 10 and w.max() == 209
    for short in (b"", b"a", b"ab"):
        assert N.grams_of(short) == []
    assert all(len(g) <= 8 for g in N.grams_of(b"Z" * 200))
    for text in ("café naïve", "你好世界", "hello 🦀 world"):
        assert N.grams_of(text.encode())


def test_fnv(spark):
    texts = ["", "a", "foobar", "変数 é", "x" * 300, None]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(F.col("t").cast("binary").alias("b"))
    rows = df.select(N.fnv1a("b").alias("x"), N.fnv1a_column(F.col("b")).alias("y")).collect()
    want = [None if t is None else f"{N.fnv1a_64(t.encode()):016x}" for t in texts]
    assert [r.x for r in rows] == want and [r.y for r in rows][:-1] == want[:-1]
    assert want[1] == "af63dc4c8601ec8c"


FIVE = [
    ("main.rs", "\nconst A: usize = MAX_FILE_SIZE;\nfn main() {\n    check(MAX_FILE_SIZE);\n}\n"),
    ("config.rs", "pub const MAX_FILE_SIZE: usize = 10;\npub const ZX_HANDLE_INVALID: u32 = 0;\n"),
    ("util.rs", "// the limit is MAX_FILE_SIZE\nfn helper() {}\n"),
    ("readme.txt", "Some prose about the project.\n"),
    ("app.py", "def main():\n    return 1\n\n"),
]


@pytest.fixture(autouse=True)
def never_weak(monkeypatch):
    """In tiny corpora every n-gram is in a large share of the documents."""
    monkeypatch.setattr(I, "WEAK_SHARE", 1.0)


@pytest.fixture(scope="module")
def five(spark, tmp_path_factory):
    rows = [(i + 1, p, t) for i, (p, t) in enumerate(FIVE)]
    df = spark.createDataFrame([*rows, (9, "bin", "MAX_FILE_SIZE\0"), (10, "none", None)], "doc_id bigint, path string, text string")
    path = str(tmp_path_factory.mktemp("index") / "five")
    I.build(df, path)
    return df, path


def _ids(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect())


def test_candidates(five):
    df, path = five
    found = lambda p, **k: _ids(I.candidates(df, path, SearchSpec(p, **k), current=True))
    assert found("MAX_FILE_SIZE") == [1, 2, 3] and found("ZX_HANDLE_INVALID") == [2]
    assert found("no such thing anywhere") == []
    assert len(found("[a-z]+")) == 7 and len(found("max_file", ignore_case=True)) == 7 and len(found("x", invert=True)) == 7
    # what isn't indexed always may match
    assert _ids(I.candidates(df, path, SearchSpec("ZX_HANDLE_INVALID"))) == [2, 9, 10]


PATTERNS = [
    SearchSpec("MAX_FILE_SIZE"), SearchSpec("MAX_.*SIZE|prose"), SearchSpec("(ZX_)?HANDLE"), SearchSpec("(main)+"), SearchSpec("main|x"), SearchSpec(("prose", "helper")),
    SearchSpec("fn", invert=True), SearchSpec("MAIN", ignore_case=True), SearchSpec("main", smart_case=True), SearchSpec("main()", fixed_strings=True), SearchSpec(r"\bfn\b"),
    SearchSpec("a.c", fixed_strings=True), SearchSpec(r"fn \w+\(\)"), SearchSpec("}", fixed_strings=True, line=True), SearchSpec("(?i)PROSE"), SearchSpec("z*"), SearchSpec("return 1", word=True), SearchSpec(r"^\s*$"),
]


@pytest.mark.parametrize("spec", PATTERNS, ids=lambda s: "+".join(s.patterns))
def test_pruned_equals_whole(five, spec):
    df, path = five
    for op in (S.match_lines, S.files_with):
        rows = lambda x: sorted(tuple(r) for r in x.collect())
        assert rows(I.pruned(op, df, path, spec)) == rows(op(df, spec)) == rows(I.pruned(op, df, path, spec, current=True))


def test_lookup_and_lists(spark, five, tmp_path):
    rows = [(0, "xyz one"), (1, "xyz two"), (2, "two")]
    path = str(tmp_path / "i")
    I.build(spark.createDataFrame(rows, "doc_id bigint, text string"), path)
    got = {bytes(r.ngram): r.doc_ids for r in I.lookup(spark, path, [b"xyz", b"two", b"zzz"]).collect()}
    assert got == {b"xyz": [0, 1], b"two": [1, 2]}
    lists = spark.createDataFrame([(bytearray([i]), ids) for i, ids in enumerate([[0, 5, 10, 100, 500, 10000], [7], [], list(range(100))])], "ngram binary, doc_ids array<bigint>")
    assert sorted((r.ngram, r.doc_ids) for r in I.delta_decoded(I.delta_encoded(lists)).collect()) == sorted((r.ngram, r.doc_ids) for r in lists.collect())


def test_pushdown(spark, five):
    _, path = five
    plan = I.postings(spark, path).where(F.col("ngram").isin(F.lit(b"MAX"), F.lit(b"AX_")))._jdf.queryExecution().toString()
    assert "PushedFilters: [In(ngram" in plan


def _docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, path string, text string, mtime bigint")


def test_changes_and_refresh(spark, tmp_path):
    path = str(tmp_path / "i")
    old = _docs(spark, [(1, "a", "alpha one", 5), (2, "b", "beta two", 5), (3, "c", "gamma", 5), (4, "d", "delta", 5)])
    new = _docs(spark, [(1, "a", "alpha one", 5), (2, "b", "beta changed", 6), (5, "c2", "gamma", 5), (6, "e", "epsilon", 1), (4, "d", "delta", 5)])
    first = I.build(old, path, corpus_version="v1")
    cols = lambda df: df.select("path", F.col("mtime").alias("mtime_secs"))
    assert {r.path: r.status for r in I.changes(cols(old), cols(new)).collect()} == {"a": "unchanged", "b": "modified", "c": "removed", "c2": "new", "d": "unchanged", "e": "new"}
    stale = _ids(I.candidates(new, path, SearchSpec("changed")))
    assert stale == [2, 5, 6]  # changed or new since: always candidates
    second = I.build(new, path, corpus_version="v2")
    assert second["version"] != first["version"] and second["num_files"] == 5
    whole = str(tmp_path / "w")
    I.build(new, whole)
    rows = lambda p: sorted((bytes(r.ngram), r.doc_id) for r in I.postings(spark, p).collect())
    assert rows(path) == rows(whole)
    third = I.build(new, path, corpus_version="v3")
    assert third["version"] == second["version"] and third["segments"] == second["segments"] and I.facts(spark, path)["corpus_version"] == "v3"
    assert [I.is_stale(*p) for p in (("a", "a"), ("a", "b"), (None, "b"), ("a", None), (None, None))] == [False, True, True, False, False]


def test_status_faults_and_clear(spark, tmp_path):
    path = tmp_path / "i"
    df = _docs(spark, [(1, "a", "alpha", 1)])
    assert not I.status(spark, str(path)).first().exists and not api.clear_index(spark, str(path))
    I.build(df, str(path))
    s = I.status(spark, str(path)).first()
    assert s.exists and s.num_files == 1 and s.num_postings >= s.num_ngrams > 0 and s.disk_bytes > 0
    good = (path / "CURRENT.json").read_text()
    for bad in ("garbage", json.dumps({**json.loads(good), "format": 99}), json.dumps({**json.loads(good), "segments": [{**json.loads(good)["segments"][0], "name": "s-gone"}]})):
        (path / ".CURRENT.json.crc").unlink(missing_ok=True)
        (path / "CURRENT.json").write_text(bad)
        with pytest.raises(I.NoIndex):
            I.facts(spark, str(path))
        assert _ids(I.candidates(df, str(path), SearchSpec("nothing here"))) == [1]  # falls back to all
    assert api.ensure_index(df, str(path))["num_files"] == 1
    assert api.clear_index(spark, str(path)) and not I.exists(spark, str(path))


def test_segments(spark, tmp_path, monkeypatch):
    """A refresh adds a segment and leaves the others' files as they are; many segments are merged; all agree with a rebuild."""
    path, rows = str(tmp_path / "i"), {i: (i, f"p{i}", f"text number {i} shared words", 0) for i in range(40)}
    I.build(_docs(spark, list(rows.values())), path)
    first = sorted((tmp_path / "i").glob("s-*/postings/*"))
    for step in range(1, 4):
        rows.pop(step)
        rows[20 + step] = (20 + step, f"p{20 + step}", f"changed in step {step} shared words", step)
        rows[100 + step] = (100 + step, f"new{step}", f"fresh in step {step}", 0)
        now = _docs(spark, list(rows.values()))
        state = I.refresh(now, path)
        assert len(state["segments"]) == step + 1 and all(p.exists() for p in first) and state["num_files"] == 40
        for pattern in ("changed in step", "fresh in step 2", "number 21", "shared words", "number 3"):
            spec = SearchSpec(pattern)
            want = sorted(tuple(r) for r in S.match_lines(now, spec).collect())
            assert sorted(tuple(r) for r in I.search_lines(now, path, spec, current=True).collect()) == want == sorted(tuple(r) for r in I.search_lines(now, path, spec).collect())
    monkeypatch.setattr(I, "MOST_SEGMENTS", 2)
    rows.pop(0)
    now = _docs(spark, list(rows.values()))
    assert len(I.refresh(now, path)["segments"]) == 1
    I.build(now, str(tmp_path / "w"))
    long = lambda p: sorted((bytes(r.ngram), r.doc_id) for r in I.postings(spark, p).collect())
    assert long(path) == long(str(tmp_path / "w"))
    one = lambda p: I.status(spark, p).select("num_files", "num_ngrams", "num_postings").first()
    assert one(path) == one(str(tmp_path / "w"))


def test_append(spark, tmp_path):
    """Batches replace documents of the same id; a batch under a known name changes nothing."""
    path = str(tmp_path / "i")
    docs = lambda *rows: spark.createDataFrame(rows, "doc_id bigint, text string")
    I.append(docs((1, "alpha one"), (2, "alpha two")), path, batch="a")
    I.append(docs((2, "beta two"), (3, "beta three")), path, batch="b")
    again = I.append(docs((9, "lost")), path, batch="a")
    assert again["num_files"] == 3 and _ids(I.files(spark, path)) == [1, 2, 3]
    now = docs((1, "alpha one"), (2, "beta two"), (3, "beta three"))
    for pattern, want in (("alpha", [1]), ("beta", [2, 3]), ("two", [2]), ("lost", [])):
        assert _ids(I.candidates(now, path, SearchSpec(pattern), current=True)) == want


def test_readers_and_writers(spark, tmp_path, monkeypatch):
    """A reader that planned on an old state ends well; a second writer is refused; an abandoned lock is taken over."""
    path = str(tmp_path / "i")
    old, new = _docs(spark, [(1, "a", "alpha one", 1)]), _docs(spark, [(1, "a", "beta one", 2)])
    I.build(old, path)
    planned = I.matching(spark, path, SearchSpec("alpha").pruning())
    I.build(new, path, force=True)
    assert _ids(planned) == [1] and _ids(I.matching(spark, path, SearchSpec("alpha").pruning())) == []
    (tmp_path / "i/LOCK").write_text("")
    for write in (lambda: I.build(old, path, force=True), lambda: I.refresh(old, path), lambda: I.append(old, path)):
        with pytest.raises(I.Locked):
            write()
    monkeypatch.setattr(I, "LOCK_SECONDS", -1)
    monkeypatch.setattr(I, "KEEP_SECONDS", -1)
    assert I.build(old, path, force=True)["num_files"] == 1 and not (tmp_path / "i/LOCK").exists()
    assert len(list((tmp_path / "i").glob("s-*"))) == 1  # what no state names is gone


def test_pruned_read(spark, tmp_path, monkeypatch):
    """A pruned search reads few rows; a pattern that most documents may match doesn't look at the index."""
    rng = np.random.default_rng(1)
    rows = [(i, f"document {i} " + ("needle " if i == 777 else "") + "filler words " + rng.bytes(9000).hex()) for i in range(1000)]
    docs, path = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3), str(tmp_path / "i")
    I.build(docs, path)
    found = I.candidates(docs, path, SearchSpec("needle"), current=True)
    assert "PushedFilters: [EqualTo(doc_id,777)" in found._jdf.queryExecution().toString() or "PushedFilters: [IsNotNull(doc_id), EqualTo(doc_id,777)" in found._jdf.queryExecution().toString()
    assert _ids(found) == [777]
    read = _rows_read(found)
    assert 0 < read <= 300
    monkeypatch.setattr(I, "WEAK_SHARE", 0.5)
    monkeypatch.setattr(I, "matching", None)
    assert I.candidates(docs, path, SearchSpec("filler words")) is docs


def _rows_read(df):
    """Rows that the scans of a DataFrame give."""
    df.collect()
    plan, n, todo = df._jdf.queryExecution().executedPlan(), 0, []
    todo.append(plan)
    while todo:
        p = todo.pop()
        if p.nodeName().startswith("Scan parquet"):
            n += p.metrics().apply("numOutputRows").value()
        if p.nodeName() == "AdaptiveSparkPlan":
            todo.append(p.executedPlan())
        children = p.children()
        todo += [children.apply(i) for i in range(children.size())]
    return n


def test_duplicate_content(spark, tmp_path):
    df = _docs(spark, [(1, "a", "same text", 1), (2, "b", "same text", 1)])
    I.build(df, str(tmp_path / "i"))
    assert _ids(I.candidates(df, str(tmp_path / "i"), SearchSpec("same"), current=True)) == [1, 2]


def test_index_size_cap(spark, tmp_path):
    df = _docs(spark, [(1, "a", "x" * 2000, 1), (2, "b", "small text", 1)])
    I.build(df, str(tmp_path / "i"), max_bytes=1024)
    assert _ids(I.files(spark, str(tmp_path / "i"))) == [2]
    assert _ids(S.files_with(I.candidates(df, str(tmp_path / "i"), SearchSpec("xxx")), SearchSpec("xxx"))) == [1]


@pytest.mark.parametrize("ids", [[], [7], [0, 5, 10, 100, 500, 10000], list(range(100)), [0, 0, 1], [127, 128, 16383, 16384, 2**32 - 1, 2**62]])
def test_codec(ids):
    data = C.encode_list(ids)
    assert C.decode_list(data).tolist() == ids
    if len(ids) == 100:
        assert len(data) < 4 * len(ids) / 3


def test_codec_faults():
    for bad in (b"\x80", b"\xff" * 11 + b"\x01"):
        with pytest.raises(ValueError):
            C.decode_list(bad)
    with pytest.raises(ValueError):
        C.encode_list([2, 1])


def test_intersection_and_cases(spark, five):
    _, path = five
    assert I.documents_with_all(spark, path, [b"MAX", b"SIZ"]).first().doc_ids == [1, 2, 3]
    assert I.documents_with_all(spark, path, [b"MAX", b"no!"]).first().doc_ids == []
    found = gram_query.candidates_in_cases(I.postings(spark, path), "max_file_size")
    assert _ids(found) == [1, 2, 3]


def test_filters_with_stored_texts(spark, five):
    """Path filters hold for candidates that come out of the index."""
    df, path = five
    rows = api.search(df, SearchSpec("MAX_FILE_SIZE", globs="u*.rs"), path, "files_with", current=True)
    assert _ids(rows) == [3]


def _many(spark, n=400, kind="bigint"):
    """Documents of known words, in several blocks and ranges of n-grams."""
    rng = np.random.default_rng(3)
    words = ["alpha", "Beta", "MIT", "Release", "é中", "zq7", "under_score", "the", "of", "x" * 9]
    rows = [(i if kind == "bigint" else f"id/{i}", " ".join(rng.choice(words, rng.integers(1, 40)))) for i in range(n)]
    return rows, spark.createDataFrame(rows, f"doc_id {kind}, text string").repartition(4)


def test_packed_lists(monkeypatch):
    """n-grams over the ends of chunks and none over the ends of documents; places of one, two and three bytes come back."""
    texts = [b"", b"ab", b"abc", "naïve MAX_FILE_SIZE ".encode() * 30, b"MAX_FILE", b"LE_SIZE zq zq", bytes(range(1, 256))]
    want = {(g, i) for i, t in enumerate(texts) for g in _slow_grams(t)}
    for chunk in (N.CHUNK, 64, 7):
        monkeypatch.setattr(N, "CHUNK", chunk)
        got = []
        for key, n, docs in N.block_lists(pa.array(texts, pa.binary())):
            assert sorted(key.tolist()) == key.tolist() and len(set(key.tolist())) == len(key)
            got += zip(np.repeat(N.key_bytes(key).to_numpy(zero_copy_only=False), n).tolist(), docs.tolist())
        assert len(got) == len(want) and set(got) == want
    lists = [[0], [], [5, 6, 200, 17000, 65535], [], list(range(300)), [65535]]
    data = N.packed(np.array(sum(lists, []), np.int64), np.array([len(x) for x in lists]))
    places, n = N.unpacked(data)
    assert n.tolist() == [len(x) for x in lists] and places.tolist() == sum(lists, [])
    assert N.unpacked(pa.array([None, b""], pa.binary()))[1].tolist() == [0, 0] and len(data[4].as_py()) == 300


@pytest.mark.parametrize("kind", ["bigint", "string"])
def test_lists_in_ranges(spark, tmp_path, monkeypatch, kind):
    """F1 to F4: each n-gram lies in one of many files; counts, lists, intersections and candidates are those of the texts."""
    monkeypatch.setattr(I, "PART_BYTES", 5000)
    rows, docs = _many(spark, kind=kind)
    path = str(tmp_path / "i")
    ranges = I.build(docs, path)["segments"][0]["files"]
    assert len(ranges) >= 4 and all(a[1] < b[0] for a, b in zip(ranges, ranges[1:]))
    grams = {i: _slow_grams(t.encode()) for i, t in rows}
    having = lambda *gs: sorted(i for i, have in grams.items() if set(gs) <= have)
    table = I.posting_table(spark, path)
    counts = {bytes(r.ngram): r.n for r in table.groupBy("ngram").agg(F.sum("n").alias("n")).collect()}
    assert counts == {g: len(having(g)) for g in set().union(*grams.values())} and table.select("block").distinct().count() > 1
    assert {bytes(r.ngram): r.doc_ids for r in I.lookup(spark, path, [b"MIT", b"Rel", b"no!"]).collect()} == {g: having(g) for g in (b"MIT", b"Rel")}
    assert I.documents_with_all(spark, path, [b"MIT", b"Rel"]).first().doc_ids == having(b"MIT", b"Rel")
    assert _ids(I.matching(spark, path, SearchSpec("MIT Release").pruning())) == having(*gram_query.covering("MIT Release"))
    I.build(docs, path, force=True, store=False)
    assert {bytes(r.ngram): r.n for r in I.posting_table(spark, path).groupBy("ngram").agg(F.sum("n").alias("n")).collect()} == counts


def test_counts_without_what_is_gone(spark, tmp_path, monkeypatch):
    """after a refresh counts are those of the new version; new documents are found without a shuffle of the texts."""
    rows, docs = _many(spark)
    new = docs.where(F.col("doc_id") % 3 != 0).union(spark.createDataFrame([(1000, "alpha new7"), (1001, "the zq7")], docs.schema))
    path, whole = str(tmp_path / "i"), str(tmp_path / "w")
    I.build(docs, path)
    assert len(I.refresh(new, path)["segments"]) == 2
    I.build(new, whole)
    counts = lambda p: {bytes(r.ngram): r.n for r in I.posting_table(spark, p).groupBy("ngram").agg(F.sum("n").alias("n")).collect()}
    assert counts(path) == counts(whole)
    assert not list((tmp_path / "i").glob("s-*/keys"))
    keys = spark.createDataFrame([(1, "1", 0)], "doc_id bigint, path string, mtime_secs bigint")
    assert _ids(I._only(docs, keys, 1)) == _ids(I._only(docs, keys, I.BROADCAST_ROWS + 1)) == [1]
    assert "BroadcastHashJoin" in I._only(docs, keys, 1)._jdf.queryExecution().executedPlan().toString()


def test_refresh_keeps_every_document_of_a_path(spark, tmp_path):
    """a new document under the path of an unchanged one, or without a time, is indexed."""
    path = str(tmp_path / "i")
    I.build(_docs(spark, [(1, "a", "alpha one", 5)]), path)
    new = _docs(spark, [(1, "a", "alpha one", 5), (2, "a", "alpha two", 5), (3, "c", "alpha three", None)])
    assert I.refresh(new, path)["num_files"] == 3
    assert I.lookup(spark, path, [b"alp"]).first().doc_ids == [1, 2, 3]


def test_append_to_another_layout(spark, tmp_path):
    """an index that can't be read is not replaced by one batch."""
    rows = spark.createDataFrame([(1, "alpha")], "doc_id bigint, text string")
    (tmp_path / "CURRENT.json").write_text(json.dumps({"format": I.FORMAT, "segments": [{"name": "s-old"}]}))
    with pytest.raises(I.NoIndex):
        I.append(rows, str(tmp_path))
