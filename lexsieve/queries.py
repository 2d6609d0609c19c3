"""Registered queries over the test tables, each with the SQL that gives the same rows.

Queries are (spark, sf_dir) -> DataFrame over whole tables; limits stand only where the limit is the feature.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from .functions import text as T
from .functions.grams import byte_classes, fnv1a
from .operators import index as I
from .operators import search as S
from .plans import gram_query
from .plans.spec import SearchSpec
from .sources import corpus as C
from .sources import filters
from .sources.filetypes import FILE_TYPES
from .storage import work_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: Lines of documents in SQL.
L = "l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1)::INT AS line_no FROM documents)"
LICENSE = "[Ll]icen[sc]e"
MAIL = r"[A-Za-z0-9._]+@[A-Za-z0-9.]+"
PHONE = "[0-9]{3}-[0-9]{4}"


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql.strip()
        return f

    return add


def _docs(operator, spec: SearchSpec):
    return lambda spark, d: operator(C.documents(spark, d), spec)


def _rtrim(x: str) -> str:
    return f"regexp_replace({x}, '[ \\t\\r\\n\\f\\v]+$', '')"


def _lines_query(name: str, spec: SearchSpec, where: str, shown: str = _rtrim("line")) -> None:
    query(name, f"WITH {L} SELECT doc_id, line_no, {shown} AS line FROM l WHERE {where}")(_docs(S.match_lines, spec))


# lines and predicates

query("lines_scan", f"WITH {L} SELECT doc_id, line_no, line FROM l")(lambda spark, d: S.lines(C.documents(spark, d)))
_lines_query("match_lines", SearchSpec(LICENSE), f"regexp_matches(line, '{LICENSE}')")
_lines_query("match_invert", SearchSpec(r"\.$", invert=True), r"NOT regexp_matches(line, '\.$')")
_lines_query("match_fixed", SearchSpec("2.0", fixed_strings=True), "contains(line, '2.0')")
_lines_query("match_line", SearchSpec("Licensed under the Apache License, Version 2.0.", fixed_strings=True, line=True), "line = 'Licensed under the Apache License, Version 2.0.'")
_lines_query("match_line_regex", SearchSpec("Licensed.*|Released.*", line=True), "regexp_full_match(line, 'Licensed.*|Released.*')")
_lines_query("match_icase", SearchSpec("LICENSE", ignore_case=True), "regexp_matches(line, 'license', 'i')")
_lines_query("match_smartcase", SearchSpec("the mit", smart_case=True), "regexp_matches(line, 'the mit', 'i')")
_lines_query("match_smartcase_upper", SearchSpec("The", smart_case=True), "regexp_matches(line, 'The')")
_lines_query("match_word", SearchSpec("license|work", word=True), r"regexp_matches(line, '(^|[^\p{L}\p{N}\p{M}_])(license|work)($|[^\p{L}\p{N}\p{M}_])')")
_lines_query("match_multi", SearchSpec((LICENSE, MAIL)), f"regexp_matches(line, '{LICENSE}') OR regexp_matches(line, '{MAIL}')")
_lines_query("match_anchored", SearchSpec("^The"), "regexp_matches(line, '^The')")

# counts, existence, totals

_COUNTS = f"""WITH {L}, c AS (SELECT doc_id, count(*)::INT AS lines, count(*) FILTER (WHERE {{hit}})::BIGINT AS hits,
 sum(len(regexp_extract_all(line, '{{re}}')))::BIGINT AS matches FROM l GROUP BY doc_id) SELECT doc_id, lines, hits, matches FROM c"""
query("count_lines", _COUNTS.format(hit="regexp_matches(line, 'tion')", re="tion"))(_docs(S.counts, SearchSpec("tion")))
query("count_matches", _COUNTS.format(hit=f"regexp_matches(line, '{PHONE}')", re=PHONE))(_docs(S.counts, SearchSpec(PHONE)))
query("count_invert", _COUNTS.format(hit="NOT regexp_matches(line, 'tion')", re="tion"))(_docs(S.counts, SearchSpec("tion", invert=True)))
query("files_with", f"WITH {L} SELECT doc_id FROM l GROUP BY doc_id HAVING bool_or(regexp_matches(line, '{PHONE}'))")(_docs(S.files_with, SearchSpec(PHONE)))
query("files_without", f"WITH {L} SELECT doc_id FROM l GROUP BY doc_id HAVING NOT bool_or(regexp_matches(line, 'tion'))")(_docs(S.files_without, SearchSpec("tion")))


@query("quiet_exists", f"WITH {L} SELECT bool_or(regexp_matches(line, '{MAIL}')) AS found FROM l")
def quiet_exists(spark: SparkSession, d: str) -> DataFrame:
    return S.files_with(C.documents(spark, d), SearchSpec(MAIL)).limit(1).agg((F.count("*") > 0).alias("found"))


query(
    "stats",
    f"""WITH {L}, c AS (SELECT doc_id, count(*) FILTER (WHERE regexp_matches(line, 'tion')) AS n, sum(len(regexp_extract_all(line, 'tion'))) AS m FROM l GROUP BY doc_id)
SELECT count(*)::BIGINT AS files_searched, (count(*) FILTER (WHERE n > 0))::BIGINT AS files_matched, sum(n)::BIGINT AS lines_matched, sum(m)::BIGINT AS matches_found,
 (SELECT sum(strlen(text))::BIGINT FROM documents) AS bytes_searched FROM c""",
)(_docs(S.stats, SearchSpec("tion")))

# projections

query(
    "only_matching",
    f"""WITH {L}, m AS (SELECT doc_id, line_no, unnest(regexp_extract_all(line, '{MAIL}')) AS match, generate_subscripts(regexp_extract_all(line, '{MAIL}'), 1)::INT AS match_no FROM l)
SELECT doc_id, line_no, match_no, match FROM m""",
)(lambda spark, d: S.only_matching(C.documents(spark, d), SearchSpec(MAIL)).select("doc_id", "line_no", "match_no", "match"))
_lines_query("replace_lines", SearchSpec(r"([A-Za-z0-9._]+)@([A-Za-z0-9.]+)", replace="$2 at ${1}"), f"regexp_matches(line, '{MAIL}')", _rtrim(r"regexp_replace(line, '([A-Za-z0-9._]+)@([A-Za-z0-9.]+)', '\2 at \1', 'g')"))
query(
    "replace_matches",
    f"WITH {L}, m AS (SELECT doc_id, line_no, unnest(regexp_extract_all(line, '{PHONE}')) AS match FROM l) SELECT doc_id, line_no, regexp_replace(match, '([0-9]{{3}})-([0-9]{{4}})', '<\\1>') AS match FROM m",
)(lambda spark, d: S.only_matching(C.documents(spark, d), SearchSpec("([0-9]{3})-([0-9]{4})", replace="<$1>")).select("doc_id", "line_no", "match"))
_OFF = f"{L}, o AS (SELECT doc_id, line_no, line, (coalesce(sum(strlen(line) + 1) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS byte_offset FROM l)"
query("line_offsets", f"WITH {_OFF} SELECT doc_id, line_no, byte_offset, line FROM o WHERE regexp_matches(line, '{LICENSE}')")(
    lambda spark, d: S.selected_lines(C.documents(spark, d), SearchSpec(LICENSE), offsets=True).select("doc_id", "line_no", "byte_offset", "line")
)
query("match_column", f"WITH {L} SELECT doc_id, line_no, (strlen(split_part(line, 'tion', 1)) + 1)::INT AS \"column\" FROM l WHERE contains(line, 'tion')")(
    lambda spark, d: S.selected_lines(C.documents(spark, d), SearchSpec("tion")).select("doc_id", "line_no", T.first_column(F.col("line"), SearchSpec("tion")).alias("column"))
)
query(
    "submatches",
    f"""WITH {_OFF}, m AS (SELECT doc_id, line_no, unnest(string_split(line, 'tion')) AS gap, generate_subscripts(string_split(line, 'tion'), 1) AS k, len(string_split(line, 'tion')) AS n FROM o WHERE contains(line, 'tion')),
g AS (SELECT *, sum(strlen(gap)) OVER (PARTITION BY doc_id, line_no ORDER BY k) + 4 * (k - 1) AS start FROM m)
SELECT doc_id, line_no, k::INT AS match_no, 'tion' AS match, start::INT AS start, (start + 4)::INT AS "end" FROM g WHERE k < n""",
)(lambda spark, d: S.only_matching(C.documents(spark, d), SearchSpec("tion")).drop("column"))
_lines_query("trim_lines", SearchSpec(PHONE, trim=True), f"regexp_matches(line, '{PHONE}')", "regexp_replace(line, '^[ \\t\\r\\n\\f\\v]+', '')")
_lines_query("max_columns", SearchSpec("tion", max_columns=200), "contains(line, 'tion')", f"CASE WHEN strlen({_rtrim('line')}) > 200 THEN '[Omitted long matching line]' ELSE {_rtrim('line')} END")
query("passthru", f"WITH {L} SELECT doc_id, line_no, regexp_matches(line, '{LICENSE}') AS is_match, {_rtrim('line')} AS line FROM l")(_docs(S.passthru, SearchSpec(LICENSE)))
query(
    "json_lines",
    f"""WITH {_OFF} SELECT doc_id, line_no, json_object('data', json_object('absolute_offset', byte_offset, 'line_number', line_no, 'lines', json_object('text', {_rtrim('line')}),
 'path', json_object('text', doc_id::VARCHAR), 'submatches', json_array(json_object('end', strlen(split_part(line, 'MIT License', 1)) + 11, 'match', json_object('text', 'MIT License'), 'start', strlen(split_part(line, 'MIT License', 1))))), 'type', 'match')::VARCHAR AS json
FROM o WHERE contains(line, 'MIT License')""",
)(lambda spark, d: S.json_lines(C.documents(spark, d), SearchSpec("MIT License"), path="doc_id"))

# context, limits, order

_CTX = f"""WITH {L}, h AS (SELECT doc_id, line_no, line, regexp_matches(line, '{LICENSE}') AS is_match FROM l),
w AS (SELECT *, bool_or(is_match) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN {{a}} PRECEDING AND {{b}} FOLLOWING) AS near FROM h)
SELECT doc_id, line_no, {_rtrim('line')} AS line, is_match, (line_no - row_number() OVER (PARTITION BY doc_id ORDER BY line_no))::INT AS block_id FROM w WHERE near"""
query("context_before", _CTX.format(a=0, b=2))(_docs(S.context, SearchSpec(LICENSE, before=2)))
query("context_after", _CTX.format(a=2, b=0))(_docs(S.context, SearchSpec(LICENSE, after=2)))
query("context_both", _CTX.format(a=1, b=1))(_docs(S.context, SearchSpec(LICENSE, context=1)))
query("context_blocks", f"SELECT doc_id, block_id, min(line_no)::INT AS first_line, count(*)::BIGINT AS lines FROM ({_CTX.format(a=3, b=1)}) AS x GROUP BY doc_id, block_id")(
    lambda spark, d: S.context(C.documents(spark, d), SearchSpec(LICENSE, before=1, after=3)).groupBy("doc_id", "block_id").agg(F.min("line_no").alias("first_line"), F.count("*").alias("lines"))
)
query(
    "context_arrays",
    f"""WITH {L}, h AS (SELECT doc_id, line_no, {_rtrim('line')} AS line, regexp_matches(line, '{LICENSE}') AS hit FROM l),
w AS (SELECT *, string_agg(line, '|') OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING) AS b, string_agg(line, '|') OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING) AS a FROM h)
SELECT doc_id, line_no, line, coalesce(b, '') AS context_before, coalesce(a, '') AS context_after FROM w WHERE hit""",
)(lambda spark, d: S.context_records(C.documents(spark, d), SearchSpec(LICENSE, context=2)).select("doc_id", "line_no", "line", F.array_join("context_before", "|").alias("context_before"), F.array_join("context_after", "|").alias("context_after")))
query("max_count", f"WITH {L}, r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS k FROM l WHERE contains(line, 'tion')) SELECT doc_id, line_no, {_rtrim('line')} AS line FROM r WHERE k <= 2")(
    _docs(S.match_lines, SearchSpec("tion", max_count=2))
)
query("max_results", f"WITH {L} SELECT doc_id, line_no, {_rtrim('line')} AS line FROM l WHERE contains(line, 'tion') ORDER BY doc_id, line_no LIMIT 25")(_docs(S.match_lines, SearchSpec("tion", max_results=25)))


def _placed(rows: DataFrame, *columns: str) -> DataFrame:
    """Rows with the place at which they come, of an ordered result: written once, then counted by partition."""
    spark, path = rows.sparkSession, f"{work_dir(rows.sparkSession)}/placed-{uuid.uuid4().hex}"
    m = F.monotonically_increasing_id()
    rows.select(*columns, F.shiftright(m, 33).alias("part"), m.bitwiseAND(F.lit((1 << 33) - 1)).alias("at")).write.parquet(path)
    got = spark.read.parquet(path)
    counts = got.groupBy("part").count().withColumn("before", F.coalesce(F.sum("count").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    # a row for each partition
    return got.join(F.broadcast(counts.select("part", "before")), "part").select((F.col("before") + F.col("at") + 1).cast("int").alias("place"), *columns)


# sorting a whole result is the feature; the place at which each row comes is shown
@query("sort_path", "SELECT row_number() OVER (ORDER BY string_split(path, '/') DESC, doc_id)::INT AS place, doc_id, path FROM (SELECT page_id AS doc_id, regexp_replace(url, '^[a-z]+://', '') AS path FROM pages WHERE contains(html, '<h1>')) AS p")
def sort_path(spark: SparkSession, d: str) -> DataFrame:
    spec = SearchSpec("<h1>", fixed_strings=True, sort="path", sort_reverse=True)
    return _placed(S.ordered(S.files_with(C.pages(spark, d), spec), spec), "doc_id", "path")


@query("sort_modified", f"WITH {L} SELECT row_number() OVER (ORDER BY doc_id % 7, doc_id, line_no)::INT AS place, doc_id, line_no FROM l WHERE contains(line, 'MIT')")
def sort_modified(spark: SparkSession, d: str) -> DataFrame:
    spec = SearchSpec("MIT", sort="modified")
    docs = C.documents(spark, d).withColumn("mtime", F.col("doc_id") % 7)
    return _placed(S.ordered(S.match_lines(docs, spec), spec), "doc_id", "line_no")


# document filters, over page URLs as paths

_PAGES = "SELECT page_id AS doc_id, regexp_replace(url, '^[a-z]+://', '') AS path FROM pages"


def _paths(name: str, where: str, **options) -> None:
    spec = SearchSpec("x", **options)
    run = lambda spark, d: filters.documents(C.pages(spark, d), spec, size="size").select("doc_id", "path")
    query(name, f"SELECT doc_id, path FROM ({_PAGES}) AS p WHERE {where}")(run)


_paths("glob_filter", "regexp_matches(path, '^[^/]*\\.example\\.com/en(/.*)?$') AND NOT regexp_matches(path, '^(.*/)?[^/]*5(/.*)?$')", globs=("*.example.com/en", "!*5"))
_paths("depth_filter", "len(string_split(path, '/')) <= 3", max_depth=3)
_paths("prefix_filter", "starts_with(path, 'm.ththth.example.net/') OR path = 'm.ththth.example.net'", prefix="m.ththth.example.net")
query("size_filter", f"SELECT doc_id, path FROM ({_PAGES} WHERE strlen(html) <= 2048) AS p")(lambda spark, d: filters.documents(C.pages(spark, d), SearchSpec("x", max_filesize="2K"), size="size").select("doc_id", "path"))
_HID = "SELECT doc_id, (CASE WHEN doc_id % 3 = 0 THEN '.cache/' WHEN doc_id % 3 = 1 THEN 'src/' ELSE 'src/.git/' END) || source || (CASE WHEN doc_id % 2 = 0 THEN '.rs' ELSE '.py' END) AS path FROM documents"


def _tree(spark: SparkSession, d: str) -> DataFrame:
    """Documents under made-up file paths."""
    i = F.col("doc_id")
    folder = F.when(i % 3 == 0, ".cache/").when(i % 3 == 1, "src/").otherwise("src/.git/")
    return C.table(spark, d, "documents").select("doc_id", F.concat(folder, "source", F.when(i % 2 == 0, ".rs").otherwise(".py")).alias("path"), "text")


query("hidden_filter", f"SELECT doc_id, path FROM ({_HID}) AS p WHERE doc_id % 3 = 1")(lambda spark, d: filters.documents(_tree(spark, d), SearchSpec("x")).select("doc_id", "path"))
query("type_filter", f"SELECT doc_id, path FROM ({_HID}) AS p WHERE doc_id % 3 <> 2 AND path LIKE '%.rs'")(lambda spark, d: filters.documents(_tree(spark, d), SearchSpec("x", types=("rust",), hidden=True)).select("doc_id", "path"))
query("type_exclude", f"SELECT doc_id, path FROM ({_HID}) AS p WHERE doc_id % 3 = 1 AND NOT path LIKE '%.py'")(lambda spark, d: filters.documents(_tree(spark, d), SearchSpec("x", types_not=("py",))).select("doc_id", "path"))
query("type_list", "SELECT * FROM (VALUES " + ", ".join(f"('{k}', '{', '.join(v)}')" for k, v in sorted(FILE_TYPES.items())) + ") AS t(name, globs)")(lambda spark, d: filters.type_list(spark))

# other corpora

_PL = "l AS (SELECT {key} AS doc_id, unnest(string_split({text}, chr(10))) AS line, generate_subscripts(string_split({text}, chr(10)), 1)::INT AS line_no FROM {table})"
query("search_pages", f"WITH {_PL.format(key='page_id', text='html', table='pages')} SELECT doc_id, count(*)::BIGINT AS n FROM l WHERE contains(line, '<h1>') GROUP BY doc_id")(
    lambda spark, d: S.selected_lines(C.pages(spark, d), SearchSpec("<h1>", fixed_strings=True)).groupBy("doc_id").agg(F.count("*").alias("n"))
)
query("search_conversations", "WITH " + _PL.format(key="conv_id || '/' || turn", text="text", table="conversations") + f" SELECT doc_id, line_no, {_rtrim('line')} AS line FROM l WHERE regexp_matches(line, '^[A-Z][a-z]+\\.$')")(
    lambda spark, d: S.match_lines(C.conversations(spark, d), SearchSpec(r"^[A-Z][a-z]+\.$"))
)
query("search_benchmark", "WITH " + _PL.format(key="item_id", text="text", table="benchmark") + f" SELECT doc_id, line_no, {_rtrim('line')} AS line FROM l WHERE contains(line, 'tion')")(
    lambda spark, d: S.match_lines(C.benchmark(spark, d), SearchSpec("tion"))
)

# the index

_indexes: dict[tuple[str, str], str] = {}
#: Documents of tables are indexed whatever their size.
EVERY_SIZE = 1 << 31


def index_of(spark: SparkSession, d: str) -> str:
    """The index of the documents table, built once for a session and table."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _indexes:
        path = f"{work_dir(spark)}/index-{spark.sparkContext.applicationId}-{len(_indexes)}"
        I.build(C.documents(spark, d), path, force=True, max_bytes=EVERY_SIZE)
        _indexes[key] = path
    return _indexes[key]


_GRAM = """b AS (SELECT doc_id, text FROM documents),
g AS (SELECT doc_id, unnest(list_distinct(list_transform(generate_series(1, (length(h) - {n2}) // 2 + 1), lambda i: h[2 * i - 1 : 2 * i + {n2} - 2]))) AS ngram FROM (SELECT doc_id, hex(text) AS h FROM b) AS x WHERE length(h) >= {n2})"""


@query("gram_trigrams", "WITH " + _GRAM.format(n2=6) + " SELECT ngram, count(*)::BIGINT AS docs FROM g GROUP BY ngram")
def gram_trigrams(spark: SparkSession, d: str) -> DataFrame:
    rows = I.posting_table(spark, index_of(spark, d)).where(F.octet_length("ngram") == 3)
    return rows.groupBy(F.hex("ngram").alias("ngram")).agg(F.sum("n").alias("docs"))


def _grams_sql() -> str:
    """CTEs up to g(doc_id, ngram in hex): the sparse n-grams by their definition, byte by byte."""
    classes = ", ".join(f"('{v:02X}', {v}, {s}, {int(u)}, {int(d)}, {int(g)})" for v, (s, u, d, g) in enumerate(zip(*(x.tolist() for x in byte_classes()))))
    near = lambda c, most: ", ".join(f"lead({c}, {k}) OVER o AS {c}{k}" for k in range(1, most + 1))
    parts = []
    for n in range(3, 9):
        text = " || ".join(["x", *(f"x{k}" for k in range(1, n))])
        inside = ", ".join(["0", *(f"w{k}" for k in range(1, n - 2))])
        parts.append(f"SELECT doc_id, {text} AS ngram FROM q WHERE x{n - 1} IS NOT NULL AND least(w, w{n - 2}) > greatest({inside})")
    return f"""c(x, v, s, u, d, g) AS (VALUES {classes}),
t AS (SELECT doc_id, unnest(h) AS x, generate_subscripts(h, 1) AS i FROM (SELECT doc_id, regexp_extract_all(hex(text), '..') AS h FROM documents) AS b),
e AS (SELECT doc_id, i, t.x, v, s, u, d, g, {", ".join(f"lead({c}) OVER o AS {c}n" for c in "vsudg")} FROM t JOIN c ON t.x = c.x WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
p AS (SELECT doc_id, i, x, s + sn + CASE WHEN u * gn + g * un > 0 THEN 40 WHEN u * dn + d * un > 0 THEN 20 WHEN u * un > 0 THEN 15 ELSE 0 END + ((31 * v + vn) & 15) AS w FROM e),
q AS (SELECT doc_id, x, w, {near("x", 7)}, {near("w", 6)} FROM p WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
g AS (SELECT DISTINCT doc_id, ngram FROM ({" UNION ALL ".join(parts)}) AS a)"""


@query("gram_sparse", f"WITH {_grams_sql()} SELECT (length(ngram) // 2)::INT AS bytes, count(*)::BIGINT AS postings, count(DISTINCT ngram)::BIGINT AS ngrams FROM g GROUP BY length(ngram)")
def gram_sparse(spark: SparkSession, d: str) -> DataFrame:
    grams = I.extracted_counts(C.documents(spark, d)).groupBy("ngram").agg(F.sum("n").alias("n"))
    return grams.groupBy(F.octet_length("ngram").alias("bytes")).agg(F.sum("n").alias("postings"), F.count("*").alias("ngrams"))


@query("gram_df", f"WITH {_grams_sql()} SELECT ngram, count(*)::BIGINT AS docs FROM g GROUP BY ngram")
def gram_df(spark: SparkSession, d: str) -> DataFrame:
    return I.posting_table(spark, index_of(spark, d)).groupBy(F.hex("ngram").alias("ngram")).agg(F.sum("n").alias("docs"))


@query("index_status", f"WITH {_grams_sql()} SELECT TRUE AS exists, 2 AS format, (SELECT count(*) FROM documents)::BIGINT AS num_files, count(DISTINCT ngram)::BIGINT AS num_ngrams, count(*)::BIGINT AS num_postings, NULL::VARCHAR AS corpus_version, TRUE AS built, TRUE AS on_disk FROM g")
def index_status(spark: SparkSession, d: str) -> DataFrame:
    return I.status(spark, index_of(spark, d)).select("exists", "format", "num_files", "num_ngrams", "num_postings", "corpus_version", (F.col("built_at") > 0).alias("built"), (F.col("disk_bytes") > 0).alias("on_disk"))


@query(
    "content_hash",
    """SELECT doc_id, lpad(lower(hex(list_reduce(list_prepend(14695981039346656037::UHUGEINT, list_transform(regexp_extract_all(hex(text), '..'), lambda b: ('0x' || b)::UHUGEINT)),
 lambda x, y: (xor(x, y) * 1099511628211::UHUGEINT) % 18446744073709551616::UHUGEINT)::UBIGINT)), 16, '0') AS hash FROM documents""",
)
def content_hash(spark: SparkSession, d: str) -> DataFrame:
    return C.documents(spark, d).select("doc_id", fnv1a(F.col("text").cast("binary")).alias("hash"))


@query("posting_lists", "SELECT 'MIT' AS ngram, string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id) AS doc_ids FROM documents WHERE contains(text, 'MIT')")
def posting_lists(spark: SparkSession, d: str) -> DataFrame:
    lists = I.delta_decoded(I.delta_encoded(I.lookup(spark, index_of(spark, d), [b"MIT"])))
    return lists.select(F.col("ngram").cast("string").alias("ngram"), F.array_join("doc_ids", ",").alias("doc_ids"))


@query("list_intersection", "SELECT string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id) AS doc_ids FROM documents WHERE contains(text, 'MIT') AND contains(text, 'Rel')")
def list_intersection(spark: SparkSession, d: str) -> DataFrame:
    return I.documents_with_all(spark, index_of(spark, d), [b"MIT", b"Rel"]).select(F.array_join("doc_ids", ",").alias("doc_ids"))


def _pruned(name: str, spec: SearchSpec, where: str) -> None:
    run = lambda spark, d: I.search_lines(C.documents(spark, d), index_of(spark, d), spec, current=True)
    query(name, f"WITH {L} SELECT doc_id, line_no, {_rtrim('line')} AS line FROM l WHERE {where}")(run)


_pruned("pruned_literal", SearchSpec("license"), "contains(line, 'license')")
_pruned("pruned_alternation", SearchSpec("that|license"), "regexp_matches(line, 'that|license')")
_pruned("pruned_optional", SearchSpec("(license)?that"), "regexp_matches(line, 'that')")
_pruned("pruned_multi", SearchSpec(("Apache", "Public License")), "contains(line, 'Apache') OR contains(line, 'Public License')")
_pruned("pruned_invert", SearchSpec("the", invert=True), "NOT contains(line, 'the')")
_pruned("pruned_class", SearchSpec(r"Version [0-9]\.0"), r"regexp_matches(line, 'Version [0-9]\.0')")
_pruned("pruned_icase", SearchSpec("MIT LICENSE", ignore_case=True), "regexp_matches(line, 'MIT LICENSE', 'i')")
_pruned("pruned_fixed", SearchSpec("2.0.", fixed_strings=True), "contains(line, '2.0.')")


def _all(*grams: str) -> str:
    return "(" + " AND ".join(f"contains(text, '{g}')" for g in grams) + ")"


#: Covering n-grams, worked out by hand from the pair weights.
_LICENSE_GRAMS = ("icen", " Li", "Lic", "ens", "nse")


@query("candidates_literal", f"SELECT doc_id FROM documents WHERE {_all('IT Li', 'icen', 'Lic', 'MIT', 'ens', 'nse')}")
def candidates_literal(spark: SparkSession, d: str) -> DataFrame:
    """Documents that hold all covering n-grams of a literal."""
    return I.matching(spark, index_of(spark, d), SearchSpec("MIT License").pruning())


#: Pattern -> what a document needs in SQL; None if any may match.
_STRENGTH = {
    "license": _all("icen", "ens", "lic", "nse"),
    "that|the": f"({_all('hat', 'tha')} OR {_all('the')})",
    "[a-z]+": None,
    "no such literal": _all("uch li", "liter", "no su", "era", "ral", "suc"),
    "Apache License": _all("Apache L", *_LICENSE_GRAMS),
    "(MIT|Public) License": f"({_all('MIT')} OR {_all('ubli', 'Pub', 'lic')}) AND {_all(*_LICENSE_GRAMS)}",
}


def _strength_sql(pattern: str, need: str | None) -> str:
    n = f"count(*) FILTER (WHERE {need})" if need else "count(*)"
    strength = f"CASE WHEN {n} = 0 OR 2 * {n} > count(*) THEN 'weak' ELSE 'strong' END" if need else "'useless'"
    return f"SELECT '{pattern}' AS pattern, {strength} AS strength, ({n})::BIGINT AS candidates, count(*)::BIGINT AS total FROM documents"


@query("query_strength", " UNION ALL ".join(_strength_sql(p, need) for p, need in _STRENGTH.items()))
def query_strength(spark: SparkSession, d: str) -> DataFrame:
    out = None
    for p in _STRENGTH:
        row = I.query_strength(spark, index_of(spark, d), SearchSpec(p)).select(F.lit(p).alias("pattern"), "*")
        out = row if out is None else out.union(row)
    return out


@query("literals", "SELECT * FROM (VALUES ('foo.*bar', 'bar'), ('foo.*bar', 'foo'), ('hello|world', 'hello'), ('hello|world', 'world'), ('(hello)+', 'hello')) AS t(pattern, literal)")
def literals(spark: SparkSession, d: str) -> DataFrame:
    rows = [(p, x) for p in ("foo.*bar", "hello|world", "(hello)+", "[a-z]+", ".*") for x in gram_query.literals(SearchSpec(p).compiled)]
    return spark.createDataFrame(rows, "pattern string, literal string")


_OLD = "SELECT doc_id::VARCHAR AS path, doc_id % 7 AS mtime FROM documents WHERE doc_id % 5 <> 0"
_NEW = "SELECT doc_id::VARCHAR AS path, CASE WHEN doc_id % 11 = 0 THEN -1 ELSE doc_id % 7 END AS mtime FROM documents WHERE doc_id % 3 <> 0"


def _versions(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Two versions of the documents: some only in one, some with another time."""
    docs, i = C.documents(spark, d), F.col("doc_id")
    old = docs.where(i % 5 != 0).withColumn("mtime", i % 7)
    new = docs.where(i % 3 != 0).withColumn("mtime", F.when(i % 11 == 0, -1).otherwise(i % 7))
    return old, new


@query("change_detect", f"SELECT coalesce(o.path, n.path) AS path, CASE WHEN o.path IS NULL THEN 'new' WHEN n.path IS NULL THEN 'removed' WHEN o.mtime = n.mtime THEN 'unchanged' ELSE 'modified' END AS status FROM ({_OLD}) AS o FULL OUTER JOIN ({_NEW}) AS n ON o.path = n.path")
def change_detect(spark: SparkSession, d: str) -> DataFrame:
    old, new = (x.select(F.col("doc_id").cast("string").alias("path"), F.col("mtime").alias("mtime_secs")) for x in _versions(spark, d))
    return I.changes(old, new)


@query("index_refresh", "SELECT count(*)::BIGINT AS docs, sum(doc_id)::BIGINT AS ids FROM documents WHERE doc_id % 3 <> 0 AND contains(text, 'MIT')")
def index_refresh(spark: SparkSession, d: str) -> DataFrame:
    """An index of the old version, refreshed to the new one, holds what the new one holds."""
    old, new = _versions(spark, d)
    path = f"{work_dir(spark)}/refresh-{spark.sparkContext.applicationId}-{abs(hash(d))}"
    I.build(old, path, force=True)
    I.refresh(new, path)
    rows = I.lookup(spark, path, [b"MIT"]).select(F.explode("doc_ids").alias("id"))
    return rows.agg(F.count("*").alias("docs"), F.sum("id").alias("ids"))
