"""Corpora, file trees, path filters, file types, the surface and the entry module."""

import io
import json
import os
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from lexsieve import api
from lexsieve.__main__ import main
from lexsieve.operators import index as I
from lexsieve.operators import search as S
from lexsieve.plans.spec import SearchSpec
from lexsieve.sources import corpus as C
from lexsieve.sources import filters
from lexsieve.sources.filetypes import FILE_TYPES

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def _paths(spark, names, **options):
    df = spark.createDataFrame([(n, 100 * i) for i, n in enumerate(names)], "path string, size bigint")
    return [r.path for r in filters.documents(df, SearchSpec("x", **options), size="size").collect()]


def test_path_filters(spark):
    names = ["src/main.rs", ".hidden/file.rs", "src/.secret.rs"]
    assert _paths(spark, names) == ["src/main.rs"] and _paths(spark, names, hidden=True) == names
    names = ["main.rs", "src/lib.rs", "src/index/builder.rs"]
    assert _paths(spark, names, max_depth=1) == ["main.rs"]
    assert _paths(spark, names, prefix="src/") == names[1:] and _paths(spark, ["src2/x", "src"], prefix="src") == ["src"]
    names = ["main.rs", "script.py", "readme.md", "Makefile", "LICENSE.txt", "a/Makefile"]
    assert _paths(spark, names, types=("rust",)) == ["main.rs"] and _paths(spark, names, types_not=("py",)) == [n for n in names if n != "script.py"]
    assert _paths(spark, names, types=("make", "license")) == names[3:] and _paths(spark, names, types=("unknown",)) == []
    assert _paths(spark, names, max_filesize="200") == names[:3]
    assert _paths(spark, [".git/config", "a/.git/x", "b"], hidden=True) == ["b"]


def test_globs(spark):
    names = ["a.rs", "src/b.rs", "src/c.py", "docs/d.md", "src/deep/e.rs"]
    assert _paths(spark, names, globs="*.rs") == ["a.rs", "src/b.rs", "src/deep/e.rs"]
    assert _paths(spark, names, globs=("!*.rs",)) == ["src/c.py", "docs/d.md"]
    assert _paths(spark, names, globs=("*.rs", "!src/**")) == ["a.rs"]
    assert _paths(spark, names, globs=("src/*.rs",)) == ["src/b.rs"] and _paths(spark, names, globs=("src/**/e.rs",)) == ["src/deep/e.rs"]
    assert _paths(spark, names, globs=("/a.rs", "docs/")) == ["a.rs", "docs/d.md"] and _paths(spark, names, globs=("*.{py,md}",)) == ["src/c.py", "docs/d.md"]
    assert _paths(spark, names, globs=("[ab].rs",)) == ["a.rs", "src/b.rs"] and _paths(spark, names, globs=("[!a].rs",)) == ["src/b.rs", "src/deep/e.rs"]
    assert _paths(spark, names, globs=("*.rs",), types=("py",)) == []  # all filters must hold


def test_types(spark):
    assert len(FILE_TYPES) == 123 and "*.rs" in FILE_TYPES["rust"]
    rows = filters.type_list(spark).collect()
    assert [r.name for r in rows] == sorted(FILE_TYPES) and rows[0].globs


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    files = {"main.rs": "fn main() {}", "pkg/__init__.py": "import x", "pkg/deep/y.py": "y", ".hid": "h", "ignored.rs": "no", "build/out.rs": "no", "pkg/keep.log": "k", "pkg/drop.log": "d", ".git/HEAD": "ref: refs/heads/main", ".git/refs/heads/main": "abc123\n", "big.txt": "x" * 2000}
    for name, text in files.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)
    (root / ".gitignore").write_text("ignored.rs\nbuild/\n*.log\n# note\n")
    (root / "pkg/.gitignore").write_text("!keep.log\n")
    (root / "data.bin").write_bytes(b"a\0b")
    (root / "bad.txt").write_bytes(b"caf\xe9 ok")
    (root / "link").symlink_to(root / "pkg")
    return str(root)


def test_walk(tree):
    names = lambda **k: [f[0] for f in C.walk(tree, **k)]
    assert names() == ["bad.txt", "big.txt", "data.bin", "main.rs", "pkg/__init__.py", "pkg/deep/y.py", "pkg/keep.log"]
    assert set(names(ignore=False)) - set(names()) == {"ignored.rs", "build/out.rs", "pkg/drop.log"}
    assert set(names(hidden=True)) - set(names()) == {".hid", ".gitignore", "pkg/.gitignore"}
    assert "pkg/deep/y.py" not in names(max_depth=2) and "link/__init__.py" in names(follow=True)
    assert names(vcs_ignore=False) == names(ignore=False)


def test_file_tree(spark, tree):
    rows = {r.path: r for r in C.file_tree(spark, tree).collect()}
    assert "data.bin" not in rows and rows["bad.txt"].text == "caf� ok" and rows["big.txt"].size == 2000
    assert "data.bin" in {r.path for r in C.file_tree(spark, tree, text_mode=True).collect()}
    assert "big.txt" not in {r.path for r in C.file_tree(spark, tree, max_bytes=1024).collect()}
    again = {r.path: r.doc_id for r in C.file_tree(spark, tree, ignore=False).collect()}
    assert all(again[p] == r.doc_id for p, r in rows.items()) and len(set(again.values())) == len(again)
    assert C.plain_tree(spark, tree + "/pkg").where("path like '%y.py'").first().text == "y"


def test_surface(spark, tree, tmp_path):
    files = C.file_tree(spark, tree)
    index = str(tmp_path / "i")
    assert api.git_head(tree) == "abc123" and api.git_head(str(tmp_path)) is None
    facts = api.ensure_index(files, index, api.git_head(tree))
    assert facts["num_files"] == 6 and api.ensure_index(files, index, "abc123") == facts
    spec = SearchSpec("main", globs="*.rs")
    assert [(r.path, r.line) for r in api.search(files, spec, index).collect()] == [("main.rs", "fn main() {}")]
    assert {r.path for r in api.search(files, spec, index, "files").collect()} == {"main.rs"}
    assert api.search(files, SearchSpec("zzz"), index, "files_without").count() == 6
    assert {m: api.search(files, SearchSpec("import"), index, m).count() for m in ("records", "submatches", "only_matching", "context", "json", "files_with", "stats", "counts")} == {"records": 1, "submatches": 1, "only_matching": 1, "context": 1, "json": 1, "files_with": 1, "stats": 1, "counts": 6}
    with pytest.raises(ValueError):
        api.search(files, spec, mode="nope")
    found, stats = api.search_records(files, "import", index, context_lines=1)
    assert found.first().line == "import x"
    r = stats.first()
    assert (r.total_files, r.candidates, r.files_searched, r.matches_found) == (6, 1, 1, 1)
    assert api.index_dir_for(spark, "/a/b").endswith("-b") and api.index_status(spark, index).first().exists


def test_binary(spark):
    df = spark.createDataFrame([(bytearray(b"a" * 9000 + b"\0"),), (bytearray(b"\0"),), (bytearray(b"x"),)], "c binary")
    assert [tuple(r) for r in df.select(C.is_binary(F.col("c")), C.is_binary(F.col("c"), 8192)).collect()] == [(True, False), (True, True), (False, False)]


def test_no_shuffle(spark):
    """Line search, counts and context are narrow; only the needed columns are read."""
    docs = C.documents(spark, "/root/testdata/sf0.001")
    for df in (S.match_lines(docs, SearchSpec("x", max_count=3)), S.context(docs, SearchSpec("x", context=1)), S.counts(docs, SearchSpec("x")), S.only_matching(docs, SearchSpec("x"))):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "source" not in plan.split("ReadSchema")[1]


def test_entry_without_the_optional_part(tmp_path):
    """The entry module imports, and has its queries, where the optional subpackage isn't there."""
    code = "import sys; sys.path.insert(0, %r); sys.modules['lexsieve.llm'] = None; import __spark_entry__ as e; assert 'match_lines' in e.queries() and not any(q.startswith('op') for q in e.queries()); assert set(e.oracle_sql()) <= set(e.queries())" % ROOT
    subprocess.run([sys.executable, "-c", code], check=True, cwd=tmp_path)


def test_command_line(spark, tree, tmp_path, monkeypatch):
    monkeypatch.setenv("LEXSIEVE_INDEX_DIR", str(tmp_path))

    def run(*args):
        out = io.StringIO()
        return main([*args], spark, out), out.getvalue()

    search = lambda *args: run("search", *args, "--path", tree)
    assert run("index", tree)[0] == 0 and '"num_files": 6' in run("status", tree)[1]
    assert search("main") == (0, "main.rs:fn main() {}\n") and search("absent") == (1, "")
    assert search("-n", "--column", "-b", "-F", "main()") == (0, "main.rs:1:4:0:fn main() {}\n")
    assert search("-l", "-e", "import", "-e", "fn") == (0, "main.rs\npkg/__init__.py\n") or search("-l", "-e", "import", "-e", "fn", "--sort", "path") == (0, "main.rs\npkg/__init__.py\n")
    assert search("-c", "y", "-g", "*.py", "--sort", "path") == (0, "pkg/__init__.py:0\npkg/deep/y.py:1\n")
    assert search("-q", "main")[0] == 0 and search("(", "-q")[0] == 2
    assert search("--files", "-t", "py", "-0")[1].count("\0") == 2
    assert search("--json", "import")[1].startswith('{"data":')
    assert "1 matches found" in search("import", "--stats")[1]
    assert search("x", "--sortr", "modified", "--max-results", "1")[0] == 0
    assert run("type-list")[1].startswith("agda: ") and run("clear", tree)[0] == 0 and run("clear", tree)[0] == 1
    got = json.loads(api.search_response(C.file_tree(spark, tree), "import", context_lines=1))
    assert got["matches"] == [{"file": "pkg/__init__.py", "line": 1, "text": "import x"}] and got["stats"]["matches_found"] == 1
    assert "error" in json.loads(api.search_response(C.file_tree(spark, tree), "("))


def test_tree_reads_candidates_alone(spark, tmp_path, monkeypatch, capsys):
    """What the index rules out isn't opened; changed files are; warnings are given unless --no-messages."""
    root = tmp_path / "tree"
    (root / ".git").mkdir(parents=True)
    (root / ".git/HEAD").write_text("aaa\n")
    for i in range(30):
        (root / f"f{i}.txt").write_text(f"file number {i} of many\n" + ("needle here\n" if i == 7 else ""))
    monkeypatch.setenv("LEXSIEVE_INDEX_DIR", str(tmp_path / "index"))

    def run(*args):
        out = io.StringIO()
        return main([*args], spark, out), out.getvalue(), capsys.readouterr().err

    code, text, said = run("search", "needle", "--path", str(root))
    assert (code, text) == (0, "f7.txt:needle here\n") and "no index" in said
    assert run("index", str(root), "--max-filesize", "30", "-j", "2")[0] == 0
    index = api.index_dir_for(spark, str(root))
    assert I.facts(spark, index)["num_files"] == 29  # f7.txt is over the limit
    assert run("index", str(root), "--force")[0] == 0 and I.facts(spark, index)["num_files"] == 30
    assert run("search", "needle", "--path", str(root)) == (0, "f7.txt:needle here\n", "")
    spec = SearchSpec("needle")
    assert [r.path for r in api.tree(spark, str(root), spec, index).collect()] == ["f7.txt"]
    (root / "f9.txt").write_text("another needle")
    os.utime(root / "f9.txt", (1, 1))
    (root / ".git/HEAD").write_text("bbb\n")
    assert sorted(r.path for r in api.tree(spark, str(root), spec, index).collect()) == ["f7.txt", "f9.txt"]
    code, text, said = run("search", "needle", "--path", str(root), "--sort", "path")
    assert text == "f7.txt:needle here\nf9.txt:another needle\n" and "another commit" in said
    assert run("search", "needle", "--path", str(root), "--sort", "path", "--no-messages")[2] == ""
    assert C.skipped(str(root), C.walk(str(root)), 40) == []
    assert [m.split(":")[0] for m in C.skipped(str(root), C.walk(str(root)), 30)] == ["f7.txt"]
    assert [r.path for r in api.tree(spark, str(root), SearchSpec("number", globs="f1*.txt"), index).where("path < 'f11'").collect()] == ["f1.txt", "f10.txt"]


def test_global_ignore(tmp_path, monkeypatch):
    monkeypatch.setenv("HOME", str(tmp_path / "home"))
    monkeypatch.delenv("XDG_CONFIG_HOME", raising=False)
    (tmp_path / "home/.config/git").mkdir(parents=True)
    (tmp_path / "t").mkdir()
    for name in ("a.txt", "b.tmp", "c.bak"):
        (tmp_path / "t" / name).write_text("x")
    names = lambda **k: [f[0] for f in C.walk(str(tmp_path / "t"), **k)]
    assert names() == ["a.txt", "b.tmp", "c.bak"]
    (tmp_path / "home/.config/git/ignore").write_text("*.tmp\n")
    assert names() == ["a.txt", "c.bak"]
    (tmp_path / "home/.gitconfig").write_text("[user]\n\tname = x\n[core]\n\texcludesFile = ~/mine\n")
    (tmp_path / "home/mine").write_text("*.bak\n")
    assert names() == ["a.txt", "b.tmp"] and names(vcs_ignore=False) == ["a.txt", "b.tmp", "c.bak"]
