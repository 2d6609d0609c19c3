"""Line modes, predicates, projections, context and limits on small corpora."""

import json

import pytest

from lexsieve.functions import text as T
from lexsieve.operators import render, search as S
from lexsieve.plans.spec import SearchSpec
from pyspark.sql import functions as F


@pytest.fixture(scope="session")
def corpus(spark):
    def make(*texts):
        return spark.createDataFrame([(i, f"f{i}.rs", t) for i, t in enumerate(texts)], "doc_id bigint, path string, text string")

    return make


def _lines(df):
    return [(r.doc_id, r.line_no, r.line) for r in df.orderBy("doc_id", "line_no").collect()]


CODE = "fn main() {\n    fn helper() {}\n}\n"


def test_counts(corpus):
    r = S.counts(corpus(CODE), SearchSpec("fn")).first()
    assert (r.lines, r.hits, r.matches) == (4, 2, 2)
    r = S.counts(corpus("fn main() {\n    let x = 1;\n}\n"), SearchSpec("fn", invert=True)).first()
    assert r.hits == 3  # two lines and the empty one after the last line feed
    zero = S.counts(corpus("abc", "fn", None, "a\0fn"), SearchSpec("fn")).orderBy("doc_id").collect()
    assert [(r.doc_id, r.hits) for r in zero] == [(0, 0), (1, 1)]


def test_documents_with_and_without(corpus):
    c = corpus("fn main() {}", "nothing", "", None, "bin\0fn")
    ids = lambda df: sorted(r.doc_id for r in df.collect())
    assert ids(S.files_with(c, SearchSpec("fn"))) == [0]
    assert ids(S.files_without(c, SearchSpec("fn"))) == [1, 2]
    assert ids(S.files_with(c, SearchSpec("fn", text_mode=True))) == [0, 4]
    assert ids(S.files_with(c, SearchSpec("fn", invert=True))) == [1, 2]
    assert S.exists(c, SearchSpec("main")) and not S.exists(c, SearchSpec("absent"))
    assert render.exit_code(c, SearchSpec("main")) == 0 and render.exit_code(c, SearchSpec("absent")) == 1


def test_empty_document_is_one_empty_line(corpus):
    assert _lines(S.match_lines(corpus(""), SearchSpec("^$"))) == [(0, 1, "")]
    assert _lines(S.match_lines(corpus(""), SearchSpec("anything"))) == []


def test_context(corpus):
    c = corpus("line1\nline2\nMATCH\nline4\nline5\n")
    rows = S.context(c, SearchSpec("MATCH", before=1, after=1)).orderBy("line_no").collect()
    assert [(r.line, r.is_match) for r in rows] == [("line2", False), ("MATCH", True), ("line4", False)]
    c = corpus("m\na\nb\nm\nc\nd\ne\nm")
    rows = S.context(c, SearchSpec("m", after=1)).orderBy("line_no").collect()
    assert [(r.line_no, r.block_id) for r in rows] == [(1, 0), (2, 0), (4, 1), (5, 1), (8, 3)]
    joined = S.context(c, SearchSpec("m", context=1)).orderBy("line_no").collect()
    assert [r.block_id for r in joined] == [0, 0, 0, 0, 0, 1, 1]
    few = S.context(c, SearchSpec("m", before=1, max_count=2)).orderBy("line_no").collect()
    assert [(r.line_no, r.is_match) for r in few] == [(1, True), (3, False), (4, True)]
    r = S.context_records(c, SearchSpec("b", context=2)).first()
    assert (r.line_no, r.context_before, r.context_after) == (3, ["m", "a"], ["m", "c"])
    r = S.context_records(c, SearchSpec("^a", before=5)).first()
    assert (r.context_before, r.context_after) == (["m"], [])


def test_limits(corpus):
    c = corpus("\n".join(f"line {i}" for i in range(1000)), "line x\nline y")
    assert len(_lines(S.match_lines(c, SearchSpec("line", max_count=5)))) == 7
    assert _lines(S.match_lines(c, SearchSpec("line", max_count=0))) == []
    assert [n for _, n, _ in _lines(S.match_lines(c, SearchSpec("line", max_results=3)))] == [1, 2, 3]
    assert [r.match for r in S.only_matching(corpus("foo 42 bar 99\n7"), SearchSpec(r"\d+", max_results=2)).collect()] == ["42", "99"]


def test_only_matching_and_offsets(corpus):
    c = corpus("é foo foo\nbar foo")
    rows = S.only_matching(c, SearchSpec("foo")).orderBy("line_no", "match_no").collect()
    assert [(r.line_no, r.start, r.end, r.column) for r in rows] == [(1, 3, 6, 4), (1, 7, 10, 8), (2, 4, 7, 5)]
    rows = S.line_records(c, SearchSpec("foo")).orderBy("line_no").collect()
    assert [(r.byte_offset, r.column) for r in rows] == [(0, 4), (11, 5)]
    rows = S.selected_lines(c, SearchSpec("foo", max_count=1), offsets=True).collect()
    assert [(r.line_no, r.byte_offset) for r in rows] == [(1, 0)]
    assert S.line_records(corpus("  é foo"), SearchSpec("foo", trim=True)).first()["column"] == 4
    with pytest.raises(ValueError):
        S.only_matching(c, SearchSpec("foo", invert=True))


def test_empty_matches(corpus):
    """An empty match right after another match is none."""
    rows = S.only_matching(corpus("baac"), SearchSpec("a*")).orderBy("match_no").collect()
    assert [(r.match, r.start) for r in rows] == [("", 0), ("aa", 1), ("", 4)]
    assert S.counts(corpus("baac"), SearchSpec("a*")).first().matches == 3
    assert S.match_lines(corpus("baac"), SearchSpec("a*", replace="<$0>")).first().line == "<>b<aa>c<>"
    assert S.stats(corpus("baac", "x"), SearchSpec("a*")).first().asDict() == {"files_searched": 2, "files_matched": 2, "lines_matched": 2, "matches_found": 5, "bytes_searched": 5}


def test_replace(corpus):
    one = lambda text, pattern, template, **k: S.match_lines(corpus(text), SearchSpec(pattern, replace=template, **k)).first().line
    assert one("this is old text\n", "old", "new") == "this is new text"
    assert one("k=v", r"(\w)=(?P<val>\w)", "$val:$1:${1}a:$1a:$$:\\:$9") == "v:k:ka::$:\\:"
    assert one("ab12", "([a-z]+)([0-9])", "$1-${2}3") == "ab-132"
    got = S.only_matching(corpus("a1 b2"), SearchSpec("([a-z])([0-9])", replace="$2$1")).orderBy("match_no").collect()
    assert [r.match for r in got] == ["1a", "2b"]


def test_shown_lines(corpus):
    assert S.match_lines(corpus("\u2003 x \u00a0\r"), SearchSpec("x")).first().line == "\u2003 x"
    assert S.match_lines(corpus(" \tx  "), SearchSpec("x", trim=True)).first().line == "x  "
    long = corpus("x" * 1_000_000 + "needle")
    assert S.match_lines(long, SearchSpec("needle", max_columns=200)).first().line == "[Omitted long matching line]"
    shown = S.match_lines(long, SearchSpec("needle", max_columns=200, max_columns_preview=True)).first().line
    assert shown.startswith("x" * 200 + " [...") and len(shown) < 300


def test_json(corpus):
    c = corpus("fn main() {}")
    got = json.loads(S.json_lines(c, SearchSpec("main")).first().json)
    assert got == {"type": "match", "data": {"path": {"text": "f0.rs"}, "lines": {"text": "fn main() {}"}, "line_number": 1, "absolute_offset": 0, "submatches": [{"match": {"text": "main"}, "start": 3, "end": 7}]}}
    assert "submatches" not in json.loads(S.json_lines(c, SearchSpec("zzz", invert=True)).first().json)["data"]


def test_predicates(corpus):
    c = corpus("Hello\nhello world\nworldly\nÉté\nété\na.b\naxb\nfoo\r\ncafé\n変数 x")
    hits = lambda p, **k: [n for _, n, _ in _lines(S.match_lines(c, SearchSpec(p, **k)))]
    assert hits("hello") == [2] and hits("hello", ignore_case=True) == [1, 2] and hits("hello", smart_case=True) == [1, 2]
    assert hits("Hello", smart_case=True) == [1] and hits("hello", smart_case=True, case_sensitive=True) == [2]
    assert hits("été", ignore_case=True) == [4, 5]
    assert hits("a.b", fixed_strings=True) == [6] and hits("a.b") == [6, 7]
    assert hits("world", word=True) == [2] and hits("foo|world", word=True) == [2, 8] and hits("caf", word=True) == []
    assert hits("hello|a.b", line=True) == [6, 7] and hits("a.b", line=True, fixed_strings=True) == [6]
    assert hits("foo$") == [] and hits("foo.$") == [8]  # \r is part of the line
    assert hits(("Hello", "変")) == [1, 10] and hits(("hello", "WORLD"), smart_case=True) == [2]
    assert hits(r"\wly$") == [3] and hits(r"^\w+$") == [1, 3, 4, 5, 7, 9]
    assert hits("hello.*worldly", dotall=True, multiline=True) == []  # never across lines
    assert hits("o", invert=True) == [4, 5, 6, 7, 9, 10]


def test_stats_and_passthru(corpus):
    c = corpus("foo foo\nbar\nfoo", "bar", None, "\0foo")
    assert S.stats(c, SearchSpec("foo")).first().asDict() == {"files_searched": 2, "files_matched": 1, "lines_matched": 2, "matches_found": 3, "bytes_searched": 18}
    rows = S.passthru(c, SearchSpec("foo")).orderBy("doc_id", "line_no").collect()
    assert [(r.line, r.is_match) for r in rows] == [("foo foo", True), ("bar", False), ("foo", True), ("bar", False)]


def test_render(corpus):
    c = corpus("one\nfoo\ntwo\nthree\nfoo", "x foo y")
    out = lambda spec, **k: list(render.render_lines(c, spec, render.Layout(**k)))
    assert out(SearchSpec("foo")) == ["f0.rs:2:foo", "f0.rs:5:foo", "f1.rs:1:x foo y"]
    assert out(SearchSpec("foo", max_count=1), column=True, byte_offset=True) == ["f0.rs:2:1:4:foo", "f1.rs:1:3:0:x foo y"]
    assert out(SearchSpec("foo", before=1)) == ["f0.rs-1-one", "f0.rs:2:foo", "--", "f0.rs-4-three", "f0.rs:5:foo", "--", "f1.rs:1:x foo y"]
    assert out(SearchSpec("foo"), heading=True, line_number=False) == ["f0.rs", "foo", "foo", "f1.rs", "x foo y"]
    assert out(SearchSpec("foo", sort="path", sort_reverse=True))[0].startswith("f1.rs")
    assert out(SearchSpec("foo", only_matching=True), line_number=False) == ["f0.rs:foo", "f0.rs:foo", "f1.rs:foo"]
    assert out(SearchSpec("foo"), color=True)[2] == "\x1b[35mf1.rs\x1b[0m:\x1b[32m1\x1b[0m:x \x1b[1;31mfoo\x1b[0m y"
    assert list(render.render_counts(c, SearchSpec("foo"))) == ["f0.rs:2", "f1.rs:1"]
    assert render.render_paths(S.files_with(c, SearchSpec("foo")), True, SearchSpec("foo")) == "f0.rs\0f1.rs\0"
    assert render.render_stats(c, SearchSpec("foo")).splitlines()[0] == "3 matches found"


def test_highlight_leaves_text(spark):
    df = spark.createDataFrame([("a foo",)], "line string")
    assert df.select(T.highlighted(F.col("line"), SearchSpec("foo"), "<$", "\\>")).first()[0] == "a <$foo\\>"


def test_stream(spark, tmp_path):
    from lexsieve.operators import index as I
    from lexsieve.streaming.search import append_index, match_stream

    spark.createDataFrame([(1, "foo\nbar"), (2, "bar")], "doc_id bigint, text string").write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema("doc_id bigint, text string").parquet(str(tmp_path / "in"))
    q = match_stream(stream(), SearchSpec("foo")).writeStream.format("memory").queryName("found").start()
    q.processAllAvailable()
    q.stop()
    assert [tuple(r) for r in spark.table("found").collect()] == [(1, 1, "foo")]
    for _ in range(2):  # a restarted query goes on from its checkpoint
        q = append_index(stream(), str(tmp_path / "out"), str(tmp_path / "ck"))
        q.processAllAvailable()
        q.stop()
        spark.createDataFrame([(2, "bar again"), (3, "bar")], "doc_id bigint, text string").write.mode("append").parquet(str(tmp_path / "in"))
    q = append_index(stream(), str(tmp_path / "out"), str(tmp_path / "ck"))
    q.processAllAvailable()
    q.stop()
    assert {r.doc_ids[0] for r in I.lookup(spark, str(tmp_path / "out"), [b"ain"]).collect()} == {2}
    assert sorted(I.lookup(spark, str(tmp_path / "out"), [b"bar"]).first().doc_ids) == [1, 2, 3]
    with pytest.raises(ValueError):
        match_stream(stream(), SearchSpec("foo", max_results=1))


def test_long_inputs(spark):
    """Context, spans and replacement take time in proportion to lines, and to matches of a line."""
    import time

    n = 100_000
    many = spark.createDataFrame([(1, "\n".join(f"{'MATCH' if i % 3 == 0 else 'other'} {i}" for i in range(n)))], "doc_id bigint, text string").cache()
    wide = spark.createDataFrame([(1, "é ab1 " * n)], "doc_id bigint, text string").cache()
    spec = SearchSpec("MATCH", context=1)

    def timed(rows):
        began = time.monotonic()
        return rows.collect(), time.monotonic() - began

    S.match_lines(many, spec).count(), S.only_matching(wide, SearchSpec("[a-z]+1")).count()
    lines, usual = timed(S.match_lines(many, spec))
    near, took = timed(S.context(many, spec))
    assert [r.line_no for r in near] == list(range(1, n + 1)) and sum(r.is_match for r in near) == len(lines) and took < 5 * usual + 10
    records, took = timed(S.context_records(many, spec))
    assert len(records) == len(lines) and records[1].context_before == ["other 2"] and records[-1].context_after == [] and took < 5 * usual + 10
    found, took = timed(S.only_matching(wide, SearchSpec("[a-z]+1")))
    assert [r.start for r in found] == [7 * i + 3 for i in range(n)] and {r.match for r in found} == {"ab1"} and took < 10
    swapped, took = timed(S.match_lines(wide, SearchSpec("z*", replace="-")))
    assert swapped[0].line.startswith("-é- -a-b-1- -é-") and took < 30
