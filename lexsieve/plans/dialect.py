"""The pattern dialect (finite automata style: no look-around, no back-references) and its translation.

`parse` reads a pattern into a small tree.  From the tree come the java.util.regex form that Spark's functions take, a
form for Python's `regex` module (used only where exact spans of possibly empty matches are needed), the least length of
a match, and the literals every match must hold (see gram_query).

Java form: flags (?dU) make `.` and `$` treat \\n alone as a line end and \\w \\d \\s \\b follow Unicode.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

_META = set("\\.+*?()|[]{}^$#&-~")
_POSIX = {"alnum": "0-9A-Za-z", "alpha": "a-zA-Z", "ascii": r"\x00-\x7F", "blank": r"\t ", "cntrl": r"\x00-\x1F\x7F", "digit": "0-9", "graph": "!-~", "lower": "a-z", "print": " -~", "punct": r"!-/:-@\[-`{-~", "space": r"\t\n\x0B\f\r ", "upper": "A-Z", "word": "0-9A-Za-z_", "xdigit": "0-9A-Fa-f"}
_SIMPLE = {"n": "\n", "t": "\t", "r": "\r", "f": "\f", "v": "\v", "a": "\a"}


class PatternError(ValueError):
    """The pattern isn't in the dialect."""


@dataclass
class Node:
    kind: str  # lit, any, class, look, group, cat, alt, rep, empty
    text: str = ""  # lit: its characters; class and look: Java form; group: opening
    kids: list[Node] = field(default_factory=list)
    low: int = 0
    high: int | None = None
    lazy: bool = False
    fold: bool = False  # lit: matched without regard to case

    def least(self) -> int:
        """Characters of the shortest match."""
        if self.kind == "lit":
            return len(self.text)
        if self.kind in ("any", "class"):
            return 1
        if self.kind in ("group", "cat"):
            return sum(k.least() for k in self.kids)
        if self.kind == "alt":
            return min(k.least() for k in self.kids)
        if self.kind == "rep":
            return self.low * self.kids[0].least()
        return 0

    def java(self, python: bool = False) -> str:
        """The java.util.regex form, or that of Python's `regex`."""
        if self.kind == "lit":
            return "".join(f"\\{c}" if c in _META else _visible(c) for c in self.text)
        if self.kind == "any":
            return "."
        if self.kind in ("class", "look"):
            if python:
                return {"$": r"\Z", r"\z": r"\Z"}.get(self.text) or re.sub(r"\\([pP])\{Is(\w+)\}", r"\\\1{\2}", self.text)
            return self.text
        if self.kind == "group":
            return self.text + "".join(k.java(python) for k in self.kids) + ")"
        if self.kind == "cat":
            return "".join(k.java(python) for k in self.kids)
        if self.kind == "alt":
            return "|".join(k.java(python) for k in self.kids)
        if self.kind == "rep":
            kid = self.kids[0]
            body = kid.java(python)
            if kid.kind == "rep" or kid.kind in ("cat", "alt", "look", "empty") or (kid.kind == "lit" and len(kid.text) > 1):
                body = f"(?:{body})"
            if (self.low, self.high) in ((0, None), (1, None), (0, 1)):
                mark = {(0, None): "*", (1, None): "+", (0, 1): "?"}[self.low, self.high]
            elif self.high == self.low:
                mark = f"{{{self.low}}}"
            else:
                mark = f"{{{self.low},{'' if self.high is None else self.high}}}"
            return body + mark + ("?" if self.lazy else "")
        return ""


def _visible(c: str) -> str:
    return {"\n": r"\n", "\t": r"\t", "\r": r"\r", "\f": r"\f", "\v": r"\x0B", "\a": r"\x07"}.get(c, c)


class _Parser:
    def __init__(self, pattern: str, fold: bool = False):
        self.s, self.i, self.names, self.groups = pattern, 0, {}, 0
        self.fold, self.spaced = fold, False

    def error(self, what: str) -> PatternError:
        return PatternError(f"{what} at {self.i} in {self.s!r}")

    def peek(self, text: str) -> bool:
        return self.s.startswith(text, self.i)

    def take(self) -> str:
        if self.i >= len(self.s):
            raise self.error("the pattern ends early")
        self.i += 1
        return self.s[self.i - 1]

    def parse(self) -> Node:
        node = self.alternation()
        if self.i < len(self.s):
            raise self.error("unopened group")
        return node

    def alternation(self) -> Node:
        fold, spaced = self.fold, self.spaced
        branches = [self.sequence()]
        while self.peek("|"):
            self.i += 1
            branches.append(self.sequence())
        self.fold, self.spaced = fold, spaced  # flags end with their group
        return branches[0] if len(branches) == 1 else Node("alt", kids=branches)

    def sequence(self) -> Node:
        kids: list[Node] = []
        while self.i < len(self.s) and self.s[self.i] not in "|)":
            if self.spaced and (self.s[self.i].isspace() or self.peek("#")):
                if self.peek("#"):
                    self.i = (self.s + "\n").index("\n", self.i)
                self.i += 1
                continue
            atom = self.atom()
            if atom is not None:
                kids.append(self.repeated(atom))
        merged: list[Node] = []
        for k in kids:
            if k.kind == "lit" and merged and merged[-1].kind == "lit" and merged[-1].fold == k.fold:
                merged[-1] = Node("lit", merged[-1].text + k.text, fold=k.fold)
            else:
                merged.append(k)
        return merged[0] if len(merged) == 1 else Node("cat", kids=merged) if merged else Node("empty")

    def repeated(self, atom: Node) -> Node:
        while self.i < len(self.s) and self.s[self.i] in "*+?{":
            c = self.take()
            if c == "{":
                m = re.compile(r"\s*(\d+)\s*(,\s*(\d*)\s*)?\}").match(self.s, self.i)
                if not m:
                    raise self.error("not a repetition")
                self.i = m.end()
                low = int(m[1])
                high = low if m[2] is None else int(m[3]) if m[3] else None
                if high is not None and high < low:
                    raise self.error("repetition from more to less")
            else:
                low, high = {"*": (0, None), "+": (1, None), "?": (0, 1)}[c]
            lazy = self.peek("?")
            self.i += lazy
            atom = Node("rep", kids=[atom], low=low, high=high, lazy=lazy)
        return atom

    def atom(self) -> Node | None:
        c = self.take()
        if c == "(":
            return self.group()
        if c == "[":
            return Node("class", self.klass())
        if c == ".":
            return Node("any")
        if c in "^$":
            return Node("look", c)
        if c == "\\":
            return self.escape()
        if c in "*+?{":
            self.i -= 1
            raise self.error("nothing to repeat")
        return Node("lit", c, fold=self.fold)

    def group(self) -> Node | None:
        opening = "("
        if self.peek("?"):
            self.i += 1
            if self.peek("P<") or (self.peek("<") and not self.peek("<=") and not self.peek("<!")):
                self.i += 2 if self.peek("P<") else 1
                m = re.compile(r"([A-Za-z_][\w.\[\]]*)>").match(self.s, self.i)
                if not m:
                    raise self.error("a bad group name")
                if m[1] in self.names:
                    raise self.error("a group name twice")
                self.i = m.end()
                self.groups += 1
                self.names[m[1]] = self.groups
                opening = "("  # groups are referred to by number
            else:
                m = re.compile(r"([a-zA-Z]*)(-[a-zA-Z]+)?([:)])").match(self.s, self.i)
                if not m:
                    raise self.error("look-around isn't supported")
                on, off = m[1], (m[2] or "-")[1:]
                if set(on + off) - set("imsUuxR"):
                    raise self.error("an unknown flag")
                if set(on + off) & set("URu"):
                    raise self.error("flags U, u and R aren't supported")
                fold, spaced = self.fold, self.spaced
                self.fold = "i" in on or (fold and "i" not in off)
                self.spaced = "x" in on or (spaced and "x" not in off)
                self.i = m.end()
                java_on, java_off = on.replace("x", ""), off.replace("x", "")
                flags = java_on + (f"-{java_off}" if java_off else "")
                if m[3] == ")":
                    return Node("look", f"(?{flags})") if flags else None
                node = self.alternation()
                self.close()
                self.fold, self.spaced = fold, spaced
                return Node("group", f"(?{flags}:", [node])
        else:
            self.groups += 1
        node = self.alternation()
        self.close()
        return Node("group", opening, [node])

    def close(self) -> None:
        if not self.peek(")"):
            raise self.error("unclosed group")
        self.i += 1

    def code(self, c: str) -> str:
        """The character of \\x.., \\u.... or \\U........"""
        if self.peek("{"):
            m = re.compile(r"\{([0-9A-Fa-f]+)\}").match(self.s, self.i)
        else:
            m = re.compile(r"([0-9A-Fa-f]{%d})" % {"x": 2, "u": 4, "U": 8}[c]).match(self.s, self.i)
        if not m or int(m[1], 16) > 0x10FFFF or 0xD800 <= int(m[1], 16) < 0xE000:
            raise self.error("a bad code point")
        self.i = m.end()
        return chr(int(m[1], 16))

    def property(self, c: str) -> str:
        m = re.compile(r"\{(\^?)([^{}]+)\}|([A-Za-z])").match(self.s, self.i)
        if not m:
            raise self.error("a bad class")
        self.i = m.end()
        name = m[2] or m[3]
        negated = (c == "P") != bool(m[1])
        kind, _, value = name.replace(":", "=").partition("=")
        if value:
            name = {"sc": "IsScript", "script": "IsScript"}.get(kind.lower(), "") and f"script={value}" or value
        long = {"letter": "L", "lowercase_letter": "Ll", "uppercase_letter": "Lu", "number": "N", "punctuation": "P", "symbol": "S", "mark": "M", "separator": "Z", "other": "C", "decimal_number": "Nd", "alphabetic": "IsAlphabetic", "lowercase": "IsLowercase", "uppercase": "IsUppercase", "white_space": "IsWhite_Space"}
        low = name.lower().replace(" ", "_").replace("-", "_")
        if low in long:
            name = long[low]
        elif not value and len(name) > 2 and not name.startswith("Is"):
            name = f"Is{name}"
        form = f"\\{'P' if negated else 'p'}{{{name}}}"
        return form

    def escape(self) -> Node:
        c = self.take()
        if c in _SIMPLE:
            return Node("lit", _SIMPLE[c], fold=self.fold)
        if c in "xuU":
            return Node("lit", self.code(c), fold=self.fold)
        if c in "dDsSwW":
            return Node("class", f"\\{c}")
        if c in "pP":
            return Node("class", self.property(c))
        if c in "bB":
            if c == "b" and (m := re.compile(r"\{(start|end)(-half)?\}").match(self.s, self.i)):
                self.i = m.end()
                return Node("look", {"start": r"(?<!\w)", "end": r"(?!\w)"}[m[1]] if m[2] else {"start": r"(?<!\w)(?=\w)", "end": r"(?<=\w)(?!\w)"}[m[1]])
            return Node("look", f"\\{c}")
        if c in "<>":
            return Node("look", r"(?<!\w)(?=\w)" if c == "<" else r"(?<=\w)(?!\w)")
        if c in "Az":
            return Node("look", f"\\{c}")
        if c.isascii() and not c.isalnum():
            return Node("lit", c, fold=self.fold)
        raise self.error("back-references and unknown escapes aren't supported")

    def klass(self) -> str:
        """Java form of a bracketed class; the opening bracket has been read."""
        out = "["
        if self.peek("^"):
            self.i += 1
            out += "^"
        first = True
        while True:
            if self.i >= len(self.s):
                raise self.error("unclosed class")
            if self.peek("]") and not first:
                self.i += 1
                return out + "]"
            if self.peek("--") and not first or self.peek("~~"):
                raise self.error("-- and ~~ in classes aren't supported")
            if self.peek("&&"):
                self.i += 2
                out += "&&"
                continue
            if self.peek("[:") and (m := re.compile(r"\[:(\^?)([a-z]+):\]").match(self.s, self.i)):
                if m[2] not in _POSIX:
                    raise self.error("an unknown POSIX class")
                out += f"[{m[1]}{_POSIX[m[2]]}]"
                self.i = m.end()
            elif self.peek("["):
                self.i += 1
                out += self.klass()
            else:
                low = self.member()
                if len(low) > 1:
                    out += low
                elif self.peek("-") and not self.peek("-]") and not self.peek("--"):
                    self.i += 1
                    high = self.member()
                    if len(high) > 1 or high < low:
                        raise self.error("a bad range")
                    out += f"{_in_class(low)}-{_in_class(high)}"
                else:
                    out += _in_class(low)
            first = False

    def member(self) -> str:
        """One character, or the Java form of a class escape."""
        c = self.take()
        if c != "\\":
            return c
        c = self.take()
        if c in "xuU":
            return self.code(c)
        if c in "dDsSwW":
            return f"\\{c}"
        if c in "pP":
            return self.property(c)
        if c in _SIMPLE:
            return _SIMPLE[c]
        if c.isascii() and not c.isalnum():
            return c
        raise self.error("an unknown escape in a class")


def _in_class(c: str) -> str:
    return f"\\{c}" if c in "\\[]^-&~#" else _visible(c)


@dataclass(frozen=True)
class Pattern:
    """A compiled pattern."""

    source: str
    node: Node = field(compare=False)
    names: dict[str, int] = field(compare=False)
    groups: int = 0
    flags: str = ""

    @property
    def java(self) -> str:
        return f"(?dU{self.flags})" + self.node.java()

    @property
    def python(self) -> str:
        """Form for the `regex` module, which has Unicode classes by default."""
        body = self.node.java(True)
        return (f"(?{self.flags})" if self.flags else "") + body

    @property
    def may_be_empty(self) -> bool:
        return self.node.least() == 0

    def template(self, text: str) -> str:
        """Spark replacement for a template with $n, $name, ${...} and $$.  An unknown group is empty."""
        out, i = "", 0
        while i < len(text):
            c = text[i]
            if c == "$":
                if text.startswith("$$", i):
                    out, i = out + r"\$", i + 2
                    continue
                m = re.compile(r"\$(?:\{([^}]*)\}|([A-Za-z0-9_]+))").match(text, i)
                if m:
                    name = m[1] if m[1] is not None else m[2]
                    number = int(name) if name.isdigit() else self.names.get(name)
                    if number is not None and number <= self.groups:
                        following = text[m.end() : m.end() + 1]
                        # java reads digits on while they name a group: a digit that follows is escaped
                        out += f"${number}"
                        if following.isdigit():
                            out += f"\\{following}"
                            i = m.end() + 1
                            continue
                    i = m.end()
                    continue
                out, i = out + r"\$", i + 1
                continue
            out, i = out + ("\\\\" if c == "\\" else c), i + 1
        return out


def compile_pattern(source: str, flags: str = "") -> Pattern:
    parser = _Parser(source, "i" in flags)
    parser.spaced = "x" in flags
    node = parser.parse()
    return Pattern(source, node, dict(parser.names), parser.groups, flags)


def escape(text: str) -> str:
    """A pattern of this text and nothing else."""
    return "".join(f"\\{c}" if c in _META else c for c in text)
