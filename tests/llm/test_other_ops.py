"""Sharding, WARC and BPE; the pipeline; and that the registered queries are there."""

import base64
import struct
import time

import numpy as np
import pytest
import zstandard
from hypothesis import given, settings, strategies as st

import corpus_pipeline
from lexsieve.llm import bpe, queries, sharding, warc

SF = "/root/testdata/sf0.001"


@given(st.integers(1, 5000), st.integers(0, 2**40))
@settings(max_examples=40, deadline=None)
def test_permutation(n, seed):
    p = sharding.permute(np.arange(n), n, seed)
    assert sorted(p.tolist()) == list(range(n))
    assert (sharding.permute(p, n, seed, inverse=True) == np.arange(n)).all()


def test_locate():
    n, shards = 1000, 7
    for row in (0, 1, 500, 999):
        assert sharding.row_at(*sharding.locate(row, n, shards), n, shards) == row


def test_assignment(spark, awkward, nothing, tmp_path):
    docs = spark.createDataFrame([(i * 7 % 1009, f"t{i}") for i in range(1009)], "doc_id bigint, slot string").repartition(5)
    rows = sharding.assign(docs, 100).collect()
    assert [r.row_no for r in sorted(rows, key=lambda r: r.doc_id)] == list(range(1009))
    assert all((r.shard, r.slot) == sharding.locate(r.row_no, 1009, 11) for r in rows)
    assert sorted((r.doc_id, r.position) for r in rows) == sorted((r.doc_id, r.position) for r in sharding.assign(docs.repartition(3), 100).collect())
    sharding.write_shards(docs, str(tmp_path / "out"), 100)
    where = {r.doc_id: (r.shard, r.slot) for r in rows}
    for k in range(11):
        ids = [r.doc_id for r in spark.read.parquet(str(tmp_path / f"out/__shard={k}")).collect()]
        assert ids == sorted((i for i, (s, _) in where.items() if s == k), key=lambda i: where[i][1])
    odd = sharding.assign(awkward).collect()
    assert sorted(r.row_no for r in odd) == list(range(awkward.count())) and sorted(r.row_no for r in odd if r.doc_id is None) == [0, 1]
    assert sharding.assign(nothing).count() == 0


def test_write_shards_repeats(spark, awkward, nothing, tmp_path, monkeypatch):
    """Every row is written once, though ids are null or repeated; several ranges number rows without gaps."""
    monkeypatch.setattr(sharding, "RANGE_ROWS", 4)
    assert sorted(r.row_no for r in sharding.assign(awkward).collect()) == list(range(awkward.count()))
    sharding.write_shards(awkward, str(tmp_path / "out"), 3)
    got = spark.read.parquet(str(tmp_path / "out"))
    shape = lambda df: sorted(map(str, df.select(*awkward.columns).collect()))
    assert shape(got) == shape(awkward)
    assert sorted(r["count"] for r in got.groupBy("__shard").count().collect()) == [2, 2, 3, 3, 3]
    sharding.write_shards(nothing, str(tmp_path / "none"))


def _read(spark, *archives):
    df = spark.createDataFrame([(f"a{i}", bytearray(a) if a is not None else None) for i, a in enumerate(archives)], "path string, content binary")
    return sorted((r.asDict() for r in warc.read_archives(df).collect()), key=lambda r: (r["path"], r["record"]))


def test_warc_round_trip(spark, tmp_path):
    bodies = [b"", b"x", bytes(range(256)) * 50, b"\r\n\r\n", *(f"<html><title>page {i}</title><body>{'same words ' * 40}{i}</body></html>".encode() for i in range(400))]
    records = [warc.frame_record(f"<urn:{i}>", f"http://h/{i}" if i % 2 else None, "2024-01-01T00:00:00Z", b) for i, b in enumerate(bodies)]
    archive = warc.write_archive(records)
    assert struct.unpack_from("<I", archive)[0] == warc.DICTIONARY_MAGIC
    rows = _read(spark, archive, archive)
    assert len(rows) == 2 * len(bodies) and [r["content"] for r in rows[: len(bodies)]] == bodies and not any(r["error"] for r in rows)
    assert [r["target_uri"] for r in rows[:2]] == [None, "http://h/1"]
    (tmp_path / "x").mkdir()
    (tmp_path / "x/one.warc.zst").write_bytes(archive)
    assert warc.read_warc(spark, str(tmp_path)).count() == len(bodies)


def test_warc_faults(spark):
    good = warc.frame_record("<urn:1>", "u", "2024-01-01T00:00:00Z", b"body")
    z = zstandard.ZstdCompressor().compress
    cases = {
        good.replace(b"Content-Length: 4", b"Content-Length: 5"): "content-length is 5",
        good.replace(b"Content-Length: 4", b"Content-Length: four"): "isn't a number",
        good.replace(b"WARC/1.1", b"WARC/9"): "no WARC version",
        good.replace(b"WARC-Date: 2024-01-01T00:00:00Z\r\n", b""): "no warc-date",
        good.replace(b"body", b"bods"): "digest",
        good[:-4]: "content-length is 4",
        b"nothing": "no end of the headers",
        good.replace(b"WARC-Date", b" \r\nnocolon\r\nWARC-Date"): "without a name",
    }
    rows = _read(spark, b"".join(z(c) for c in cases) + z(good))
    assert all(want in r["error"] for r, want in zip(rows, cases.values())) and rows[-1]["error"] is None and rows[-1]["content"] == b"body"
    skip = struct.pack("<II", 0x184D2A51, 3) + b"abc"
    plain = struct.pack("<II", warc.DICTIONARY_MAGIC, 8) + b"rawwords"
    d = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(b"rawwords")).compress(good)
    cut = _read(spark, z(good) + z(good)[:-3], skip + z(good) + skip, plain + d, plain, b"", None, z(good) + b"rubbish!rubbish!", warc.write_archive([]), plain[:9])
    by = {}
    for r in cut:
        by.setdefault(r["path"], []).append(r["error"])
    assert by["a0"][0] is None and "cut off" in by["a0"][1]
    assert by["a1"] == [None] and by["a2"] == [None] and "a3" not in by and "a4" not in by and "a5" not in by and "a7" not in by
    assert by["a6"][0] is None and by["a6"][1].startswith("frame") and "dictionary" in by["a8"][0]


def test_warc_damage(spark):
    """Sound records after a damaged frame are read; the damage is one error, whether or not its end is known."""
    records = [warc.frame_record(f"<urn:{i}>", "u", "2024-01-01T00:00:00Z", b"body %d " % i * 300) for i in range(5)]
    frames = [zstandard.ZstdCompressor(write_checksum=True).compress(r) for r in records]
    bad = bytearray(frames[1])
    bad[-1] ^= 255  # the checksum
    rows = _read(spark, frames[0] + bytes(bad) + frames[2], frames[0] + frames[1][: len(frames[1]) // 2] + frames[2] + frames[3], frames[0] + b"rubbish" + frames[4])
    by = {}
    for r in rows:
        by.setdefault(r["path"], []).append((r["record_id"], r["error"] is None))
    assert by["a0"] == [("<urn:0>", True), (None, False), ("<urn:2>", True)]
    assert by["a1"][0] == ("<urn:0>", True) and by["a1"][1] == (None, False) and by["a1"][-1] == ("<urn:3>", True)
    assert by["a2"] == [("<urn:0>", True), (None, False), ("<urn:4>", True)]


def test_warc_size(spark, tmp_path):
    """Time in proportion to size; a long record; a file is read by windows."""
    body = np.random.default_rng(0).bytes(20_000)
    archive = lambda n: warc.write_archive([warc.frame_record(f"<urn:{i}>", None, "2024-01-01T00:00:00Z", body) for i in range(n)])
    small, large = archive(400), archive(3200)

    def timed(data):
        began = time.monotonic()
        assert all(e is None for *_, e in warc._frames(data))
        return time.monotonic() - began

    timed(small)
    assert timed(large) < 3 * 8 * timed(small) + 0.5
    long = warc.frame_record("<urn:long>", None, "2024-01-01T00:00:00Z", body * 1500)
    (tmp_path / "big #1.warc.zst").write_bytes(large + zstandard.ZstdCompressor().compress(long))
    got = warc.read_warc(spark, str(tmp_path)).selectExpr("count(*) n", "max(octet_length(content)) m", "count(error) e").first()
    assert tuple(got) == (3201, 30_000_000, 0)


def test_warc_awkward(spark):
    """Null html, url and id, repeated rows, a long page, columns of clashing names, an empty table."""
    rows = [(1, "u", "<p>", "a"), (1, "u", "<p>", "b"), (2, None, None, None), (None, "v", "", "c"), (3, "w", "x" * 5_000_000, "d")]
    pages = spark.createDataFrame([(a, b, c, d, d) for a, b, c, d in rows], "page_id bigint, url string, html string, content string, path string")
    got = warc.read_archives(warc.pages_to_archives(pages.repartition(2)))
    assert {(r.record_id, r.target_uri, len(r.content)) for r in got.collect()} == {("<urn:page:1>", "u", 3), ("<urn:page:2>", None, 0), ("<urn:page:None>", "v", 0), ("<urn:page:3>", "w", 5_000_000)}
    assert got.where("error is null").count() == 5
    assert warc.read_archives(warc.pages_to_archives(pages.where("false"))).count() == 0


@pytest.fixture(scope="module")
def tiktoken_encoding():
    import tiktoken

    pattern = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
    with open(bpe.VOCABULARY, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def test_bpe_tables(spark, tiktoken_encoding):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = bpe.encode(docs).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert len(rows) == len(texts) and all(r.round_trip and r.n_tokens == len(r.ids) for r in rows)
    assert all(r.ids == tiktoken_encoding.encode_ordinary(texts[r.doc_id]) for r in rows)
    assert {r.doc_id: r.text for r in bpe.decode(bpe.encode(docs)).collect()} == texts


@given(st.text(max_size=60) | st.text("aA b1_'é²\n\t.=  \x1cs", max_size=80))
@settings(max_examples=300, deadline=None)
def test_bpe_texts(tiktoken_encoding, text):
    text = text.encode("utf-8", "replace").decode()
    encoder = bpe.Encoder(bpe.VOCABULARY)
    ids, _ = encoder.encode([text])
    assert ids.tolist() == tiktoken_encoding.encode_ordinary(text)
    assert encoder.vocabulary.decode(ids).tobytes() == text.encode()


def test_bpe_awkward(awkward, nothing):
    rows = bpe.encode(awkward).collect()
    assert len(rows) == awkward.count() and all(r.round_trip for r in rows)
    assert all(r.ids is None and r.n_tokens == 0 for r in rows if r.doc_id == 5) and all(r.ids == [] for r in rows if r.doc_id == 4)
    assert bpe.encode(nothing).count() == 0


def test_pipeline(spark, words):
    """Each stage against its own operator's result on its own input, and the whole run."""
    from lexsieve.llm import decontam, langid, minhash, quality

    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels, items = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("labels", "benchmark"))
    ids = lambda df: {r[0] for r in df.select("doc_id").collect()}
    at = docs
    out = corpus_pipeline.language(spark, at, SF)
    assert ids(out) == ids(langid.identify_languages(at).where("accepted")) and out.columns == docs.columns
    at, out = out, corpus_pipeline.quality(spark, out, SF)
    assert ids(out) == ids(quality.assess(at, labels).where("keep")) and out.columns == docs.columns
    at, out = out, corpus_pipeline.near_duplicates(spark, out, SF)
    sets = {r.doc_id: frozenset(tuple(words(r.text)[i : i + 3]) for i in range(max(1, len(words(r.text)) - 2))) for r in at.collect()}
    left = ids(out)
    for a in left:
        for b in left:
            assert a == b or len(sets[a] & sets[b]) < minhash.THRESHOLD * len(sets[a] | sets[b])
    assert out.columns == docs.columns and len(left) < at.count()
    at, out = out, corpus_pipeline.decontamination(spark, out, SF)
    bench = [words(r.text) for r in items.collect()]
    windows = {tuple(t[i : i + min(13, len(t))]) for t in bench for i in range(max(1, len(t) - 12))}
    sizes = {len(w) for w in windows}
    dirty = {r.doc_id for r in at.collect() for w in [words(r.text)] if any(tuple(w[i : i + n]) in windows for n in sizes for i in range(len(w) - n + 1))}
    assert dirty and ids(at) - ids(out) == dirty
    final = {r.doc_id: r.ids for r in corpus_pipeline.run(spark, SF).collect()}
    assert set(final) == ids(out)


def test_pipeline_awkward(spark, awkward, nothing):
    """What each stage keeps of nulls, empty, blank and very long texts, and repeats."""
    shape = lambda rows: sorted(((r.doc_id is None, r.doc_id or 0, len(r.text or "")) for r in rows))
    every = awkward.collect()
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, awkward, SF)
        if name == "BPE encoding":
            texts = {r.doc_id: r.text for r in every if r.doc_id is not None}
            rows = out.collect()
            assert len(rows) == len(every) and all(r.round_trip and (r.ids is None) == (texts[r.doc_id] is None) for r in rows if r.doc_id is not None)
        else:
            assert out.columns == awkward.columns
            kept[name] = out.select("doc_id", "text").collect()
        none = stage(spark, nothing, SF)
        assert none.count() == 0
    lettered = [r for r in every if any(c.isalpha() for c in r.text or "")]
    assert {r[:2] for r in shape(kept["language ID"])} <= {r[:2] for r in shape(lettered)}
    assert sorted(r.doc_id for r in kept["MinHash near-dedup"] if r.doc_id is not None) == [1, 4, 5, 6, 7, 8, 9, 10]
    assert shape(kept["benchmark decontamination"]) == shape(every)  # none holds a passage


def test_registered():
    assert {f"op{n}" for n in range(1, 11)} | {"pipeline"} == {q.split("_")[0] for q in queries.QUERIES}
