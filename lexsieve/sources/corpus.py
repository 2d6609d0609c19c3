"""Corpora: a DataFrame of documents with doc_id (the key), text, and optionally path and size, from tables or file trees."""

from __future__ import annotations

import configparser
import os
import re
from collections.abc import Iterable
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.grams import fnv1a_64
from .filters import EXCLUDED_DIRS, glob_regex

#: Larger files aren't searched, or indexed.
SEARCH_BYTES, INDEX_BYTES = 256 << 20, 50 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as files: path is the URL without its scheme."""
    path = F.regexp_replace("url", "^[a-z]+://", "")
    return table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), path.alias("path"), F.col("html").alias("text"), F.octet_length("html").cast("bigint").alias("size"))


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(F.concat_ws("/", "conv_id", "turn").alias("doc_id"), "text")


def benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"), "text")


def is_binary(content: Column, first: int | None = None) -> Column:
    """Whether there is a NUL byte, in all of a BINARY or STRING column or in its first so many bytes."""
    raw = content.cast("binary")
    return F.contains(F.substring(raw, 1, first) if first else raw, F.lit(b"\0"))


def decoded(content: Column) -> Column:
    """Text of BINARY content; bad bytes become U+FFFD."""
    return F.make_valid_utf8(content.cast("string"))


# file trees


class _Rules:
    """Ignore rules of one folder's ignore file."""

    def __init__(self, folder: str, lines: list[str]):
        self.folder, self.rules = folder, []
        for line in lines:
            line = line.rstrip("\n").rstrip("\r")
            if not line.strip() or line.startswith("#"):
                continue
            keep = line.startswith("!")
            line = line[1:] if keep else line.removeprefix("\\")
            line = line.rstrip()
            self.rules.append((re.compile(glob_regex(line)), line.endswith("/"), keep))

    def verdict(self, path: str, is_dir: bool) -> bool | None:
        """True: ignored, False: kept, None: no rule speaks of it."""
        inside = os.path.relpath(path, self.folder) if self.folder else path
        out = None
        for rule, only_dir, keep in self.rules:
            if rule.match(inside + "/x" if is_dir and only_dir else inside):
                out = not keep
        return out


def global_rules() -> list[str]:
    """Lines of the user's own ignore file: core.excludesFile of the git configuration, else git/ignore in the configuration folder."""
    home, place = os.path.expanduser("~"), os.environ.get("XDG_CONFIG_HOME") or os.path.expanduser("~/.config")
    at = os.path.join(place, "git/ignore")
    for name in (os.path.join(place, "git/config"), os.path.join(home, ".gitconfig")):
        config = configparser.ConfigParser(strict=False, interpolation=None, allow_no_value=True, delimiters=("=",))
        try:
            with open(name, encoding="utf-8", errors="replace") as f:
                config.read_string("\n".join(line.strip() for line in f))
            at = os.path.expanduser(config.get("core", "excludesfile", fallback=at).strip('"'))
        except (OSError, configparser.Error):
            pass
    try:
        with open(at, encoding="utf-8", errors="replace") as f:
            return f.readlines()
    except OSError:
        return []


def walk(root: str, hidden: bool = False, follow: bool = False, ignore: bool = True, vcs_ignore: bool = True, max_depth: int | None = None) -> list[tuple[str, int, float, float, float]]:
    """(relative path, size, mtime, atime, ctime) of the files below root, by path; unreadable entries are passed over."""
    found = []

    def visit(folder: str, rules: list[_Rules], level: int) -> None:
        if max_depth is not None and level > max_depth:
            return
        names = ([".gitignore"] if vcs_ignore else []) + [".ignore"]
        own = list(rules)
        for name in names if ignore else []:
            try:
                with open(os.path.join(root, folder, name), encoding="utf-8", errors="replace") as f:
                    own.append(_Rules(folder, f.readlines()))
            except OSError:
                pass
        if ignore and vcs_ignore and not folder:
            if lines := global_rules():
                own.insert(0, _Rules("", lines))
            try:
                with open(os.path.join(root, ".git/info/exclude"), encoding="utf-8", errors="replace") as f:
                    own.insert(bool(lines), _Rules("", f.readlines()))
            except OSError:
                pass
        try:
            entries = sorted(os.scandir(os.path.join(root, folder)), key=lambda e: e.name)
        except OSError:
            return
        for e in entries:
            path = f"{folder}/{e.name}" if folder else e.name
            try:
                if e.name in EXCLUDED_DIRS or (e.name.startswith(".") and not hidden) or (e.is_symlink() and not follow):
                    continue
                is_dir = e.is_dir(follow_symlinks=follow)
                verdicts = [v for r in own if (v := r.verdict(path, is_dir)) is not None]
                if verdicts and verdicts[-1]:
                    continue
                if is_dir:
                    if not (follow and e.is_symlink() and os.path.realpath(e.path) in os.path.realpath(os.path.join(root, folder))):
                        visit(path, own, level + 1)
                elif e.is_file(follow_symlinks=follow):
                    s = e.stat(follow_symlinks=follow)
                    found.append((path, s.st_size, s.st_mtime, s.st_atime, s.st_ctime))
            except OSError:
                continue

    visit("", [], 1)
    return found


def path_id(path: str) -> int:
    """doc_id of a path, the same from listing to listing."""
    return fnv1a_64(path.encode(errors="surrogateescape")) >> 1


_LISTING = "doc_id bigint, path string, size bigint, mtime timestamp, atime timestamp, created timestamp"


def _at(seconds: float) -> datetime:
    return datetime.fromtimestamp(seconds, timezone.utc)


def listing(spark: SparkSession, root: str, **options) -> DataFrame:
    """(doc_id, path, size, mtime, atime, created) of the files of a folder; no file is read."""
    return spark.createDataFrame([(path_id(p), p, size, *map(_at, times)) for p, size, *times in walk(root, **options)], _LISTING)


def skipped(root: str, files: list[tuple], most: int = SEARCH_BYTES) -> list[str]:
    """A message for each file of a walk that won't be read."""
    out = []
    for path, size, *_ in files:
        if size > most:
            out.append(f"{path}: {size} bytes, more than {most}, not searched")
        elif not os.access(os.path.join(root, path), os.R_OK):
            out.append(f"{path}: can't be read")
    return out


class _Files(InputPartition):
    def __init__(self, files: list):
        self.files = files


class _TreeReader(DataSourceReader):
    PART_BYTES = 64 << 20

    def __init__(self, options: dict, only: frozenset[str] | None):
        self.only = only
        flag = lambda name, default: str(options.get(name, default)).lower() == "true"
        self.root = options["path"]
        self.options = {"hidden": flag("hidden", False), "follow": flag("follow", False), "ignore": flag("ignore", True), "vcs_ignore": flag("vcs_ignore", True)}
        if "max_depth" in options:
            self.options["max_depth"] = int(options["max_depth"])
        self.most = int(options.get("max_bytes", SEARCH_BYTES))

    def partitions(self) -> list[InputPartition]:
        parts, files, size = [], [], 0
        for f in walk(self.root, **self.options):
            if f[1] > self.most or self.only is not None and f[0] not in self.only:
                continue
            files.append((path_id(f[0]), *f))
            size += f[1]
            if size >= self.PART_BYTES:
                parts.append(_Files(files))
                files, size = [], 0
        return [*parts, _Files(files)]

    def read(self, partition: InputPartition):
        for n, path, size, mtime, atime, ctime in partition.files:
            try:
                with open(os.path.join(self.root, path), "rb") as f:
                    yield n, path, f.read(), size, _at(mtime), _at(atime), _at(ctime)
            except OSError:
                continue  # gone or unreadable


class FileTree(DataSource):
    """Files below a folder that driver and executors share, with ignore-file, hidden-file, link, depth and size rules."""

    only: frozenset[str] | None = None

    @classmethod
    def name(cls) -> str:
        return "filetree"

    def schema(self) -> str:
        return "doc_id bigint, path string, content binary, size bigint, mtime timestamp, atime timestamp, created timestamp"

    def reader(self, schema) -> DataSourceReader:
        return _TreeReader(self.options, self.only)


def file_tree(spark: SparkSession, root: str, text_mode: bool = False, only: Iterable[str] | None = None, **options) -> DataFrame:
    """A corpus (doc_id, path, text, size, mtime, atime, created) of a folder; binary files only with text_mode.

    doc_id is a hash of the path, which stays the same from listing to listing.  only: read no other paths.
    """
    spark.dataSource.register(FileTree if only is None else type("SomeFiles", (FileTree,), {"only": frozenset(only)}))
    files = spark.read.format("filetree").options(path=root, **{k: str(v) for k, v in options.items()}).load()
    if not text_mode:
        files = files.where(~is_binary(F.col("content")))
    return files.select("doc_id", "path", decoded(F.col("content")).alias("text"), "size", "mtime", "atime", "created")


def plain_tree(spark: SparkSession, root: str) -> DataFrame:
    """The same columns from Spark's own binaryFile source (any file system; no ignore rules; hidden files never)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    return files.select(F.xxhash64("path").alias("doc_id"), "path", decoded(F.col("content")).alias("text"), F.col("length").alias("size"), F.col("modificationTime").alias("mtime"))


