"""The pattern dialect, its translation, sizes, and the conditions derived for pruning."""

import pytest
import regex

from lexsieve.functions.grams import grams_of
from lexsieve.plans import gram_query as G
from lexsieve.plans.dialect import PatternError, compile_pattern, escape
from lexsieve.plans.spec import SearchSpec, parse_filesize, patterns_from_file


def _java(spark, pattern, text):
    return spark.sql("SELECT regexp_extract_all(:t, :p, 0) AS x", args={"t": text, "p": compile_pattern(pattern).java}).first().x


@pytest.mark.parametrize(
    "pattern, text, want",
    [
        (r"[[:digit:]]+", "a12:d", ["12"]),
        (r"[^[:alpha:]]+", "ab1-c", ["1-"]),
        (r"(?P<year>\d{4})-(?<month>\d\d)", "on 2024-05 now", ["2024-05"]),
        (r"a++", "caaat", ["aaa"]),
        (r"a{2}{2}", "aaaaa", ["aaaa"]),
        (r"\x41\u{e9}\n?", "xAéy", ["Aé"]),
        (r"\w+", "né 変数", ["né", "変数"]),
        (r"(?i)É", "é", ["é"]),
        (r"(?x) a b # c", "ab", ["ab"]),
        (r"a(?i:b)c", "aBc abC", ["aBc"]),
        (r"[a&&[^b]]", "ab", ["a"]),
        (r"[\]\-x]+", "]-x", ["]-x"]),
        (r"[]a]+", "a]", ["a]"]),
        (r"\p{Greek}+|\pL", "αβ z", ["αβ", "z"]),
        (r"\bfoo\b", "foo food", ["foo"]),
        (r"x.y", "x\ry", ["x\ry"]),
        (r"a|b*?c", "bca", ["bc", "a"]),
        (r"\&\~\#\%", "&~#%", ["&~#%"]),
    ],
)
def test_dialect(spark, pattern, text, want):
    assert _java(spark, pattern, text) == want
    p = compile_pattern(pattern)
    assert [m[0] for m in regex.finditer(p.python, text)] == want or "[" in pattern


@pytest.mark.parametrize("pattern", [r"(?=a)", r"(?<!a)b", r"(a)\1", r"a**b(", "[a", "a)", "(?U)a", r"\q", "*a", "{2}", "a{3,2}", "[z-a]", r"[a--b]", r"[a~~b]", "[[:nope:]]", r"(?P<a>x)(?P<a>y)", "(?k)a", r"\x{110000}", "a\\"])
def test_rejected(pattern):
    with pytest.raises(PatternError):
        SearchSpec(pattern)


def test_validation():
    with pytest.raises(ValueError):
        SearchSpec(())
    with pytest.raises(PatternError):
        SearchSpec(("a)", "(b"))  # valid only together
    assert SearchSpec("foo.bar()", fixed_strings=True).compiled.node.text == "foo.bar()"
    assert compile_pattern(escape("a.b*[c]{d}\\")).node.text == "a.b*[c]{d}\\"


@pytest.mark.parametrize("text, size", [("1024", 1024), ("10K", 10240), ("10k", 10240), ("5M", 5 << 20), ("1G", 1 << 30), ("10MB", 10 << 20), ("", None), ("abc", None), (7, 7), (None, None)])
def test_filesize(text, size):
    assert parse_filesize(text) == size


def test_pattern_file(tmp_path):
    (tmp_path / "p").write_text("one\n\ntwo\r\n")
    assert patterns_from_file(str(tmp_path / "p")) == ["one", "two"]


@pytest.mark.parametrize(
    "pattern, want",
    [(".*", []), ("[a-z]+", []), ("a", []), ("", []), ("foo.*bar", ["bar", "foo"]), ("hello|world", ["hello", "world"]), ("^start.*end$", ["end", "start"]), ("(hello)+", ["hello"]), ("(hello)*x", []), ("(foo(bar))", ["bar", "foo"])],
)
def test_literals(pattern, want):
    assert G.literals(compile_pattern(pattern)) == want


@pytest.mark.parametrize(
    "pattern, want",
    [
        ("license", {"license"}),
        ("(foo(bar))", {"foobar"}),
        ("(license)?that", {"that"}),
        ("that|license", {"that", "license"}),
        ("that|x", None),
        ("abc[0-9]def", {"abc", "def"}),
        ("(abc){0,2}", None),
        ("(abc){2}", {"abc"}),
        ("(?i)license", None),
        ("ab", None),
        (r"\bhello\b", {"hello"}),
        ("a(?i:bcd)efg", {"efg"}),
    ],
)
def test_condition(pattern, want):
    c = G.condition(compile_pattern(pattern).node)
    assert (set(G.terms(c)) if c is not None else None) == want


def test_no_pruning():
    for k in ({"invert": True}, {"passthru": True}, {"ignore_case": True}, {"smart_case": True}):
        assert SearchSpec("license", **k).pruning() is None
    assert G.terms(SearchSpec("a.bcd", fixed_strings=True).pruning()) == ["a.bcd"]
    assert isinstance(SearchSpec(("abc", "def")).pruning(), G.Either)


def test_covering():
    grams = G.covering("MAX_FILE_SIZE")
    assert grams and set(grams) <= set(grams_of(b"MAX_FILE_SIZE")) and not any(a != b and a in b for a in grams for b in grams)
    assert G.covering("ab") == []


def test_strength():
    assert [G.strength(1, 10, False), G.strength(0, 10, True), G.strength(6, 10, True), G.strength(5, 10, True)] == ["useless", "weak", "weak", "strong"]
