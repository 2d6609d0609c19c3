"""SearchSpec: what to search for and what to return; and its compiled pattern and pruning condition."""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import cached_property

from . import gram_query
from .dialect import Pattern, PatternError, compile_pattern, escape


@dataclass(frozen=True)
class SearchSpec:
    """Options of a search.  Names follow the usual command-line flags; defaults match plain line search."""

    patterns: tuple[str, ...]
    # matching
    ignore_case: bool = False
    smart_case: bool = False
    case_sensitive: bool = False  # cancels smart_case only
    fixed_strings: bool = False
    word: bool = False
    line: bool = False
    invert: bool = False
    multiline: bool = False
    dotall: bool = False
    text_mode: bool = False  # search binary files too
    # documents
    globs: tuple[str, ...] = ()
    types: tuple[str, ...] = ()
    types_not: tuple[str, ...] = ()
    prefix: str | None = None
    max_depth: int | None = None
    max_filesize: str | int | None = None
    hidden: bool = False
    # output
    before: int = 0
    after: int = 0
    context: int = 0
    max_count: int | None = None
    max_results: int = 0
    only_matching: bool = False
    passthru: bool = False
    replace: str | None = None
    trim: bool = False
    max_columns: int | None = None
    max_columns_preview: bool = False
    sort: str | None = None
    sort_reverse: bool = False

    def __post_init__(self):
        if isinstance(self.patterns, str):
            object.__setattr__(self, "patterns", (self.patterns,))
        object.__setattr__(self, "patterns", tuple(self.patterns))
        for name in ("globs", "types", "types_not"):
            value = getattr(self, name)
            object.__setattr__(self, name, (value,) if isinstance(value, str) else tuple(value))
        if not self.patterns:
            raise ValueError("no pattern")
        self.compiled  # noqa: B018 - an invalid pattern is an error here

    def but(self, **changes) -> SearchSpec:
        return replace(self, **changes)

    @property
    def folds(self) -> bool:
        """Whether case is ignored: on demand, or with smart_case if no pattern has an upper-case letter (and one has a letter)."""
        if self.ignore_case:
            return True
        letters = [c for p in self.patterns for c in p if c.isalpha()]
        return self.smart_case and not self.case_sensitive and bool(letters) and not any(c.isupper() for c in letters)

    @cached_property
    def compiled(self) -> Pattern:
        flags = "i" * self.folds + "m" * self.multiline + "s" * self.dotall
        parts = []
        for p in self.patterns:
            p = escape(p) if self.fixed_strings else p
            compile_pattern(p, flags)  # each must be valid by itself
            if self.word:
                p = rf"\b(?:{p})\b"
            parts.append(f"^(?:{p})$" if self.line else p)
        whole = parts[0] if len(parts) == 1 else "|".join(f"(?:{p})" for p in parts)
        return compile_pattern(whole, flags)

    @property
    def literal(self) -> str | None:
        """The text to look for if the search is for one plain string."""
        plain = self.fixed_strings and len(self.patterns) == 1 and not (self.folds or self.word)
        return self.patterns[0] if plain and "\n" not in self.patterns[0] else None

    @property
    def lines_before(self) -> int:
        return max(self.before, self.context)

    @property
    def lines_after(self) -> int:
        return max(self.after, self.context)

    def pruning(self, least: int = 3) -> object | None:
        """Condition on a document to hold a match, of literals of at least so many bytes; None if nothing can be said or lines without a match are wanted too."""
        if self.invert or self.passthru or self.folds:
            return None
        return gram_query.condition(self.compiled.node, least)

    @cached_property
    def needed(self) -> tuple[str, ...]:
        """Literals that every match holds, the longest first."""
        found = None if self.folds else gram_query.condition(self.compiled.node, 1)
        parts = found.parts if isinstance(found, gram_query.Both) else (found,)
        return tuple(sorted({p.literal for p in parts if isinstance(p, gram_query.Term)}, key=lambda x: (-len(x), x)))


def patterns_from_file(path: str) -> list[str]:
    """One pattern for each line that isn't empty."""
    with open(path, encoding="utf-8") as f:
        return [line.rstrip("\r\n") for line in f if line.rstrip("\r\n")]


def parse_filesize(text: str | int | None) -> int | None:
    """Bytes of '10', '10K', '5M', '1G', '10MB' (powers of 1024); None if it isn't a size."""
    if text is None or isinstance(text, int):
        return text
    body = text.strip().upper()
    if body.endswith("B") and len(body) > 1 and body[-2] in "KMG":
        body = body[:-1]
    power = {"K": 1, "M": 2, "G": 3}.get(body[-1:], 0)
    number = body[:-1] if power else body
    return int(number) * 1024**power if number.isascii() and number.isdigit() else None


__all__ = ["PatternError", "SearchSpec", "parse_filesize", "patterns_from_file"]
