"""Command line: python -m lexsieve index | search | status | clear | type-list.

Flags have the usual meanings of line-search tools.  Exit status: 0 match, 1 none, 2 error.
"""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession

from . import api
from .operators import index as I
from .operators import render
from .operators import search as S
from .plans.spec import PatternError, SearchSpec, parse_filesize, patterns_from_file
from .sources import corpus, filters


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser("lexsieve", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    i = sub.add_parser("index")
    i.add_argument("path", nargs="?", default=".")
    i.add_argument("--force", action="store_true")
    i.add_argument("--max-filesize", default="50M")
    i.add_argument("-j", "--threads", type=int)
    for name in ("status", "clear"):
        sub.add_parser(name).add_argument("path", nargs="?", default=".")
    sub.add_parser("type-list")
    s = sub.add_parser("search", add_help=False)
    s.add_argument("--help", action="help")
    s.add_argument("pattern", nargs="?")
    s.add_argument("--path", default=".")
    s.add_argument("-e", "--regexp", action="append", default=[])
    s.add_argument("-f", "--file", action="append", default=[])
    flags = "i:ignore-case s:case-sensitive S:smart-case F:fixed-strings w:word-regexp x:line-regexp v:invert-match U:multiline a:text c:count l:files-with-matches q:quiet o:only-matching n:line-number N:no-line-number b:byte-offset H:with-filename I:no-filename p:pretty 0:null L:follow"
    for f in flags.split():
        short, name = f.split(":")
        s.add_argument(f"-{short}", f"--{name}", action="store_true")
    for name in ("multiline-dotall", "json", "count-matches", "files-without-match", "passthru", "vimgrep", "stats", "files", "heading", "no-heading", "column", "trim", "max-columns-preview", "hidden", "no-ignore", "no-ignore-vcs", "no-messages", "no-index"):
        s.add_argument(f"--{name}", action="store_true")
    for short, name in (("m", "max-count"), ("A", "after-context"), ("B", "before-context"), ("C", "context"), ("M", "max-columns"), ("d", "max-depth"), ("j", "threads")):
        s.add_argument(f"-{short}", f"--{name}", type=int)
    s.add_argument("--max-results", type=int, default=0)
    s.add_argument("-r", "--replace")
    s.add_argument("--context-separator", default="--")
    s.add_argument("--color", choices=["never", "auto", "always", "ansi"], default="auto")
    s.add_argument("--max-filesize")
    for short, name in (("g", "glob"), ("t", "type"), ("T", "type-not")):
        s.add_argument(f"-{short}", f"--{name}", action="append", default=[])
    s.add_argument("--sort")
    s.add_argument("--sortr")
    return p


def spec_of(a: argparse.Namespace) -> SearchSpec:
    patterns = [*([a.pattern] if a.pattern is not None else []), *a.regexp, *(x for f in a.file for x in patterns_from_file(f))]
    return SearchSpec(
        tuple(patterns or ([""] if a.files else [])), ignore_case=a.ignore_case, smart_case=a.smart_case, case_sensitive=a.case_sensitive, fixed_strings=a.fixed_strings, word=a.word_regexp, line=a.line_regexp, invert=a.invert_match,
        multiline=a.multiline, dotall=a.multiline_dotall, text_mode=a.text, globs=tuple(a.glob), types=tuple(a.type), types_not=tuple(a.type_not), max_depth=a.max_depth, max_filesize=a.max_filesize, hidden=a.hidden,
        before=a.before_context or 0, after=a.after_context or 0, context=a.context or 0, max_count=a.max_count, max_results=a.max_results, only_matching=a.only_matching, passthru=a.passthru, replace=a.replace, trim=a.trim,
        max_columns=a.max_columns, max_columns_preview=a.max_columns_preview, sort=a.sort or a.sortr, sort_reverse=bool(a.sortr),
    )


def warnings(spark: SparkSession, root: str, index: str | None) -> list[str]:
    """What is to be said of the index before a search."""
    if index is None:
        return []
    try:
        known = I.facts(spark, index)["corpus_version"]
    except I.NoIndex:
        return ["no index, all files are searched"]
    return ["the index is of another commit; changed files are searched, run index to bring it up to date"] if I.is_stale(known, api.git_head(root)) else []


def search(spark: SparkSession, a: argparse.Namespace, out) -> int:
    """The first mode that is asked for, in this order: files, counts, quiet, paths with, paths without, JSON, lines."""
    spec = spec_of(a)
    options = {"hidden": a.hidden, "follow": a.follow, "ignore": not a.no_ignore, "vcs_ignore": not a.no_ignore_vcs}
    everything = a.files or a.count or a.count_matches or a.files_without_match or a.passthru
    index = None if everything or a.no_index or a.text else api.index_dir_for(spark, a.path)
    if not a.no_messages and not a.files:
        for message in [*warnings(spark, a.path, index), *corpus.skipped(a.path, corpus.walk(a.path, **options))]:
            print(f"lexsieve: {message}", file=sys.stderr)
    if a.files:
        docs = filters.documents(corpus.listing(spark, a.path, **options), spec, size="size")
    else:
        docs = api.tree(spark, a.path, spec, index, a.text, **options)
    color = a.color in ("always", "ansi") or (a.color == "auto" and out.isatty())
    layout = render.Layout(filename=not a.no_filename, line_number=(a.line_number or a.pretty or a.vimgrep or out.isatty()) and not a.no_line_number, column=a.column, byte_offset=a.byte_offset, heading=(a.heading or a.pretty) and not a.no_heading, color=color or a.pretty, null=a.null, separator=a.context_separator, vimgrep=a.vimgrep)
    some = False

    def put(lines) -> bool:
        any_line = False
        for line in lines:
            any_line = True
            out.write(line + "\n")
        return any_line

    if a.files:
        text = render.render_paths(docs.select("doc_id", "path", "mtime"), a.null)
        out.write(text)
        some = bool(text)
    elif a.count or a.count_matches:
        rows = list(render.render_counts(docs, spec, a.count_matches, not a.no_filename))
        put(rows)
        some = any(r.rsplit(":", 1)[-1] != "0" for r in rows)
    elif a.quiet:
        some = S.exists(docs, spec)
    elif a.files_with_matches or a.files_without_match:
        rows = (S.files_with if a.files_with_matches else S.files_without)(docs, spec)
        text = render.render_paths(rows, a.null, spec)
        out.write(text)
        some = bool(text)
    elif a.json:
        some = put(r["json"] for r in S.ordered(S.json_lines(docs, spec), spec).toLocalIterator())
    else:
        some = put(render.render_lines(docs, spec, layout))
    if a.stats:
        out.write("\n" + render.render_stats(docs, spec) + "\n")
    return 0 if some else 1


def main(argv: list[str] | None = None, spark: SparkSession | None = None, out=None) -> int:
    a, out = parser().parse_args(argv), out or sys.stdout
    if spark is None:
        builder = SparkSession.builder.appName("lexsieve")
        spark = (builder.master(f"local[{a.threads}]") if getattr(a, "threads", None) else builder).getOrCreate()
    try:
        if a.command == "search":
            return search(spark, a, out)
        if a.command == "type-list":
            for r in api.type_list(spark).collect():
                out.write(f"{r['name']}: {r['globs']}\n")
        elif a.command == "index":
            most = parse_filesize(a.max_filesize) or corpus.INDEX_BYTES
            facts = api.build_index(corpus.file_tree(spark, a.path, max_bytes=most), api.index_dir_for(spark, a.path), a.force, api.git_head(a.path), most, store=False)
            out.write(json.dumps({k: v for k, v in facts.items() if k != "segments"}) + "\n")
        elif a.command == "status":
            out.write(json.dumps(api.index_status(spark, api.index_dir_for(spark, a.path)).first().asDict()) + "\n")
        elif a.command == "clear":
            return 0 if api.clear_index(spark, api.index_dir_for(spark, a.path)) else 1
        return 0
    except (PatternError, ValueError, OSError, I.Locked) as e:
        print(f"lexsieve: {e}", file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())
