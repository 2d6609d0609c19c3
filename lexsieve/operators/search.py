"""Search operators: from documents (doc_id, text and optionally path) to lines, matches, counts and context.

Lines are worked on inside the document's row: what needs its neighbours (context, the first m matches) is taken from
the array of lines before it is exploded, so that no operator here but the ordered ones shuffles.

A null text has no lines; a text with a NUL character is binary and has none either, unless text_mode is set.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text as T
from ..plans import gram_query
from ..plans.spec import SearchSpec


def _keys(docs: DataFrame) -> list[str]:
    return [c for c in ("doc_id", "path", "mtime", "atime", "created") if c in docs.columns]


def searched(docs: DataFrame, spec: SearchSpec) -> DataFrame:
    """The documents that are searched."""
    out = docs.select(*_keys(docs), "text").where(F.col("text").isNotNull())
    return out if spec.text_mode else out.where(~F.contains("text", F.lit("\0")))


def _may_match(text: Column, condition: object | None) -> Column | None:
    """Necessary condition on the whole text, as plain substring tests."""
    if condition is None:
        return None
    if isinstance(condition, gram_query.Term):
        return F.contains(text, F.lit(condition.literal))
    tests = [_may_match(text, p) for p in condition.parts]
    out = tests[0]
    for t in tests[1:]:
        out = out & t if isinstance(condition, gram_query.Both) else out | t
    return out


def promising(docs: DataFrame, spec: SearchSpec) -> DataFrame:
    """Searched documents without those in which no line can match."""
    out = searched(docs, spec)
    test = _may_match(F.col("text"), spec.pruning(1))
    return out if test is None else out.where(test)


def lines(docs: DataFrame, offsets: bool = False) -> DataFrame:
    """(keys, line_no, line[, byte_offset]) of all lines of all documents with text."""
    keys = _keys(docs)
    docs = docs.where(F.col("text").isNotNull())
    if not offsets:
        out = docs.select(*keys, F.posexplode(T.lines_of(F.col("text"))).alias("pos", "line"))
        return out.select(*keys, (F.col("pos") + 1).alias("line_no"), "line")
    both = F.arrays_zip(T.lines_of(F.col("text")).alias("line"), T.line_offsets("text").alias("byte_offset"))
    out = docs.select(*keys, F.posexplode(both).alias("pos", "l"))
    return out.select(*keys, (F.col("pos") + 1).alias("line_no"), "l.line", "l.byte_offset")


def _records(spec: SearchSpec) -> Column:
    """Array of (line_no, line) of the selected lines, at most max_count."""
    every = F.transform(T.lines_of(F.col("text")), lambda line, i: F.struct((i + 1).alias("line_no"), line.alias("line")))
    return F.slice(F.filter(every, lambda r: T.hit(r["line"], spec)), 1, spec.max_count)


def _limited(rows: DataFrame, spec: SearchSpec, *order: str) -> DataFrame:
    return rows.orderBy(*order).limit(spec.max_results) if spec.max_results else rows


def selected_lines(docs: DataFrame, spec: SearchSpec, offsets: bool = False) -> DataFrame:
    """(keys, line_no, line[, byte_offset]) of the selected lines, raw text, with max_count and max_results."""
    docs = promising(docs, spec)
    keys = _keys(docs)
    if spec.max_count == 0:
        return lines(docs.where("false"), offsets)
    if spec.max_count and not offsets:
        out = docs.select(*keys, F.explode(_records(spec)).alias("r")).select(*keys, "r.*")
    elif spec.max_count:
        both = F.transform(F.arrays_zip(T.lines_of(F.col("text")).alias("line"), T.line_offsets("text").alias("at")), lambda r, i: F.struct((i + 1).alias("line_no"), r["line"].alias("line"), r["at"].alias("byte_offset")))
        out = docs.select(*keys, F.explode(F.slice(F.filter(both, lambda r: T.hit(r["line"], spec)), 1, spec.max_count)).alias("r")).select(*keys, "r.*")
    else:
        out = lines(docs, offsets).where(T.hit(F.col("line"), spec))
    return _limited(out, spec, *keys[:1], "line_no")


def match_lines(docs: DataFrame, spec: SearchSpec) -> DataFrame:
    """(keys, line_no, line) of the selected lines as shown."""
    out = selected_lines(docs, spec)
    return out.withColumn("line", T.shown(F.col("line"), spec))


def line_records(docs: DataFrame, spec: SearchSpec) -> DataFrame:
    """(keys, line_no, column, byte_offset, line): everything the line output can show of a match."""
    out = selected_lines(docs, spec, offsets=True)
    column = F.lit(None).cast("int") if spec.invert else T.first_column(F.col("line"), spec)
    return out.withColumn("column", column).withColumn("line", T.shown(F.col("line"), spec))


def submatches(docs: DataFrame, spec: SearchSpec) -> DataFrame:
    """(keys, line_no, byte_offset, line, submatches) of the selected lines; with invert submatches is null."""
    out = selected_lines(docs, spec, offsets=True)
    return out.withColumn("submatches", F.lit(None).cast(T.SPAN) if spec.invert else T.spans(F.col("line"), spec))


def only_matching(docs: DataFrame, spec: SearchSpec) -> DataFrame:
    """(keys, line_no, match_no, match, start, end, column): a row for each match; max_results counts matches.

    With a replacement, match is the template applied to the first match in the matched text taken by itself.
    """
    if spec.invert:
        raise ValueError("lines without a match have nothing to show")
    found = selected_lines(docs, spec.but(max_results=0))
    keys = _keys(docs)
    out = found.select(*keys, "line_no", F.posexplode(T.spans(F.col("line"), spec)).alias("pos", "m"))
    match = F.col("m.match")
    if spec.replace is not None:
        p = spec.compiled
        match = F.regexp_replace(match, F.lit(p.java), F.lit(p.template(spec.replace)))
    out = out.select(*keys, "line_no", (F.col("pos") + 1).alias("match_no"), match.alias("match"), F.col("m.start").alias("start"), F.col("m.end").alias("end"), (F.col("m.start") + 1).alias("column"))
    return _limited(out, spec, *keys[:1], "line_no", "match_no")


def passthru(docs: DataFrame, spec: SearchSpec) -> DataFrame:
    """(keys, line_no, line, is_match) of all lines."""
    return lines(searched(docs, spec)).select(*_keys(docs), "line_no", T.hit(F.col("line"), spec).alias("is_match"), T.shown(F.col("line"), spec).alias("line"))


def counts(docs: DataFrame, spec: SearchSpec) -> DataFrame:
    """(keys, lines, hits, matches): lines, selected lines, and matches, of every searched document, zeros too.

    hits counts lines without a match under invert; matches counts matches in any case.
    """
    docs = searched(docs, spec)
    keys = _keys(docs)
    every = T.lines_of(F.col("text"))
    hits = F.size(F.filter(every, lambda line: T.hit(line, spec)))
    out = docs.select(*keys, F.size(every).alias("lines"), hits.cast("bigint").alias("hits"), *([] if spec.compiled.may_be_empty else [F.aggregate(every, F.lit(0).cast("bigint"), lambda n, line: n + T.match_count(line, spec)).alias("matches")]))
    if spec.compiled.may_be_empty:  # needs exact spans, which lambdas can't call
        n = lines(docs).groupBy(*keys).agg(F.sum(T.match_count(F.col("line"), spec)).cast("bigint").alias("matches"))
        out = out.join(n, keys)
    return out


def _any_line(docs: DataFrame, spec: SearchSpec) -> Column:
    return F.exists(T.lines_of(F.col("text")), lambda line: T.hit(line, spec))


def files_with(docs: DataFrame, spec: SearchSpec) -> DataFrame:
    """Keys of the documents with a selected line (with invert: with a line that doesn't match)."""
    docs = promising(docs, spec)
    return docs.where(_any_line(docs, spec)).select(*_keys(docs))


def files_without(docs: DataFrame, spec: SearchSpec) -> DataFrame:
    """Keys of the searched documents without a selected line."""
    docs = searched(docs, spec)
    return docs.where(~_any_line(docs, spec)).select(*_keys(docs))


def exists(docs: DataFrame, spec: SearchSpec) -> bool:
    """Whether there is any selected line; stops at the first."""
    return not files_with(docs, spec).isEmpty()


def stats(docs: DataFrame, spec: SearchSpec) -> DataFrame:
    """One row: files_searched, files_matched, lines_matched, matches_found, bytes_searched (of searched documents)."""
    docs = searched(docs, spec)
    every = T.lines_of(F.col("text"))
    n = F.size(F.filter(every, lambda line: T.hit(line, spec))).alias("n")
    size = F.octet_length("text").alias("size")
    if spec.compiled.may_be_empty:
        each = counts(docs, spec).select(F.col("hits").alias("n"), F.col("matches").alias("m"))
        rows = each.withColumn("size", F.lit(0))
        total = docs.agg(F.sum(size).alias("b"))
    else:
        m = F.aggregate(every, F.lit(0).cast("bigint"), lambda k, line: k + T.match_count(line, spec)).alias("m")
        rows, total = docs.select(n, m, size), None
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint")
    out = rows.agg(F.count("*").alias("files_searched"), F.count_if(F.col("n") > 0).alias("files_matched"), zero(F.sum("n")).alias("lines_matched"), zero(F.sum("m")).alias("matches_found"), zero(F.sum("size")).alias("bytes_searched"))
    if total is not None:
        out = out.drop("bytes_searched").crossJoin(total.select(zero(F.col("b")).alias("bytes_searched")))
    return out


def _context_array(spec: SearchSpec) -> Column:
    """Array of (line_no, line, is_match) of accepted matches and the lines around them.

    is_match is false for what only stands near a match, matches beyond max_count among them.
    """
    before, after = spec.lines_before, spec.lines_after

    def around(x: Column) -> Column:
        """The places of the matches and of their neighbours, ascending, out of all lines and their places of matches."""
        last = F.size(x["line"]) - 1
        near = F.transform(x["at"], lambda i: F.sequence(F.greatest(i - before, F.lit(0)), F.least(i + after, last)))
        end = F.coalesce(F.element_at(x["at"], -1), F.lit(-1)) if spec.max_count != 0 else F.lit(-1)
        row = lambda i: F.struct((i + 1).alias("line_no"), F.get(x["line"], i).alias("line"), (F.get(x["hit"], i) & (i <= end)).alias("is_match"))
        return F.transform(F.array_distinct(F.flatten(near)), row)

    def places(x: Column) -> Column:
        at = F.filter(F.transform(x["hit"], lambda h, i: F.when(h, i)), lambda i: i.isNotNull())
        return F.struct(x["line"].alias("line"), x["hit"].alias("hit"), (F.slice(at, 1, spec.max_count) if spec.max_count is not None else at).alias("at"))

    hits = lambda every: F.struct(every.alias("line"), F.transform(every, lambda line: T.hit(line, spec)).alias("hit"))
    return T.bound(T.lines_of(F.col("text")), lambda every: T.bound(hits(every), lambda x: T.bound(places(x), around)))


def context(docs: DataFrame, spec: SearchSpec) -> DataFrame:
    """(keys, line_no, line, is_match, block_id): matches with the lines around them.

    block_id is the number of lines left out before: equal within a run of adjacent lines, greater in a later run; where it
    changes the line output has a separator.
    """
    docs = promising(docs, spec)
    keys = _keys(docs)
    docs = docs.where(_any_line(docs, spec))
    out = docs.select(*keys, F.posexplode(_context_array(spec)).alias("pos", "r"))
    block = (F.col("r.line_no") - F.col("pos") - 1).alias("block_id")
    return out.select(*keys, "r.line_no", T.shown(F.col("r.line"), spec.but(replace=None)).alias("line"), "r.is_match", block)


def context_records(docs: DataFrame, spec: SearchSpec) -> DataFrame:
    """(keys, line_no, line, context_before, context_after): each match with the lines before and after it, right-trimmed."""
    docs = promising(docs, spec)
    keys = _keys(docs)
    hit = lambda every: F.filter(F.transform(every, lambda line, i: F.when(T.hit(line, spec), i)), lambda i: i.isNotNull())

    def records(x: Column) -> Column:
        part = lambda at, n: F.transform(F.slice(x["line"], at + 1, n), T.trim_right)

        def record(i: Column) -> Column:
            first = F.greatest(i - spec.lines_before, F.lit(0))
            return F.struct((i + 1).alias("line_no"), T.trim_right(F.get(x["line"], i)).alias("line"), part(first, i - first).alias("context_before"), part(i + 1, F.lit(spec.lines_after)).alias("context_after"))

        return F.transform(x["at"], record)

    both = lambda every: T.bound(F.struct(every.alias("line"), hit(every).alias("at")), records)
    out = docs.where(_any_line(docs, spec)).select(*keys, F.explode(T.bound(T.lines_of(F.col("text")), both)).alias("r")).select(*keys, "r.*")
    return _limited(out, spec, *keys[:1], "line_no")


def json_lines(docs: DataFrame, spec: SearchSpec, path: str = "path") -> DataFrame:
    """(keys, json): a 'match' object for each selected line; without submatches under invert."""
    rows = submatches(docs, spec)
    parts = F.struct(F.col("byte_offset").alias("absolute_offset"), F.col("line_no").alias("line_number"), F.struct(T.trim_right(F.col("line")).alias("text")).alias("lines"), F.struct(F.col(path).cast("string").alias("text")).alias("path"), F.transform("submatches", lambda m: F.struct(m["end"].alias("end"), F.struct(m["match"].alias("text")).alias("match"), m["start"].alias("start"))).alias("submatches"))
    return rows.select(*_keys(docs), "line_no", F.to_json(F.struct(parts.alias("data"), F.lit("match").alias("type"))).alias("json"))


def ordered(rows: DataFrame, spec: SearchSpec) -> DataFrame:
    """Rows by document attribute: path (by component), modified, accessed, created; then by line.  Unknown names mean path."""
    times = {"modified": "mtime", "accessed": "atime", "created": "created"}
    if not spec.sort or spec.sort == "none":
        key = [F.col("doc_id")]
    elif times.get(spec.sort) in rows.columns:
        key = [F.col(times[spec.sort])]
    else:
        key = [F.split(F.col("path" if "path" in rows.columns else "doc_id").cast("string"), "/")]
    if spec.sort_reverse:
        key = [k.desc() for k in key]
    rest = [c for c in ("doc_id", "line_no", "match_no") if c in rows.columns]
    return rows.orderBy(*key, *rest)
