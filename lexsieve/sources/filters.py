"""Predicates on a document's path and size; all are conjunctive and reach the scan of a table that has the columns."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

from ..plans.spec import SearchSpec, parse_filesize
from .filetypes import FILE_TYPES

EXCLUDED_DIRS = (".git", ".lexsieve")


def glob_regex(glob: str) -> str:
    """Regular expression, for a whole relative path, of an ignore-file style glob.

    Without a slash (but at its end) a glob matches at any depth; ** crosses directories, * and ? don't; a match of a
    directory covers what lies below it; a trailing slash matches directories only.
    """
    only_dir = glob.endswith("/")
    body = glob.rstrip("/")
    anchored = "/" in body
    body = body.lstrip("/")
    out, i = "", 0
    while i < len(body):
        c = body[i]
        if body.startswith("**/", i) and (i == 0 or body[i - 1] == "/"):
            out, i = out + "(?:.*/)?", i + 3
        elif body.startswith("**", i):
            out, i = out + ".*", i + 2
        elif c == "*":
            out, i = out + "[^/]*", i + 1
        elif c == "?":
            out, i = out + "[^/]", i + 1
        elif c == "[" and (m := re.compile(r"\[(!|\^)?(\]?[^\]]*)\]").match(body, i)):
            inside = m[2].replace("\\", "\\\\").replace("[", "\\[").replace("&&", "&\\&")
            out, i = out + f"[{'^' if m[1] else ''}{inside}]", m.end()
        elif c == "{" and (end := body.find("}", i)) > 0:
            parts = body[i + 1 : end].split(",")
            out, i = out + "(?:" + "|".join(glob_regex("/" + p)[1 : -len("(?:/.*)?$")] for p in parts) + ")", end + 1
        elif c == "\\" and i + 1 < len(body):
            out, i = out + re.escape(body[i + 1]), i + 2
        else:
            out, i = out + re.escape(c), i + 1
    return "^" + ("" if anchored or glob.startswith("/") else "(?:.*/)?") + out + ("/.*$" if only_dir else "(?:/.*)?$")


def globs(path: Column, patterns: tuple[str, ...]) -> Column:
    """Overrides: a glob includes, a glob after ! excludes, the last match decides; with any include the rest is dropped."""
    includes = any(not g.startswith("!") for g in patterns)
    out = F.lit(not includes)
    for g in patterns:  # the last becomes the outermost
        exclude = g.startswith("!")
        out = F.when(path.rlike(glob_regex(g[1:] if exclude else g)), F.lit(not exclude)).otherwise(out)
    return out


def _of_glob(path: Column, glob: str) -> Column:
    name = F.element_at(F.split(path, "/"), -1)
    if glob.startswith("*.") and "*" not in glob[1:]:
        return F.endswith(path, F.lit(glob[1:]))
    return name.rlike("^" + re.escape(glob).replace(r"\*", ".*") + "$") if "*" in glob else name == glob


def of_type(path: Column, names: tuple[str, ...]) -> Column:
    """Whether the path is of one of the file types; an unknown name has no paths."""
    out = F.lit(False)
    for name in names:
        for glob in FILE_TYPES.get(name, ()):
            out = out | _of_glob(path, glob)
    return out


def depth(path: Column) -> Column:
    return F.size(F.split(path, "/"))


def hidden(path: Column) -> Column:
    return F.exists(F.split(path, "/"), lambda c: c.startswith(".") & ~c.isin(".", ".."))


def below(path: Column, folder: str) -> Column:
    folder = folder.rstrip("/")
    return F.lit(True) if folder in ("", ".") else (path == folder) | path.startswith(folder + "/")


def documents(docs: DataFrame, spec: SearchSpec, path: str = "path", size: str | None = None) -> DataFrame:
    """The documents that the spec's path and size filters leave."""
    p = F.col(path)
    out = docs.where(~F.exists(F.split(p, "/"), lambda c: c.isin(*EXCLUDED_DIRS)))
    if spec.globs:
        out = out.where(globs(p, spec.globs))
    if spec.types:
        out = out.where(of_type(p, spec.types))
    if spec.types_not:
        out = out.where(~of_type(p, spec.types_not))
    if spec.prefix:
        out = out.where(below(p, spec.prefix))
    if spec.max_depth is not None:
        out = out.where(depth(p) <= spec.max_depth)
    if not spec.hidden:
        out = out.where(~hidden(p))
    most = parse_filesize(spec.max_filesize)
    if most is not None and size:
        out = out.where(F.col(size) <= most)
    return out


def type_list(spark) -> DataFrame:
    """(name, globs) of all file types by name."""
    rows = [(k, ", ".join(v)) for k, v in sorted(FILE_TYPES.items())]
    return spark.createDataFrame(rows, "name string, globs string").coalesce(1).orderBy("name")
