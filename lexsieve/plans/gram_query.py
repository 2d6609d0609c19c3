"""From a pattern to a necessary condition on n-grams, and from that to the documents that may match.

The condition is a tree of AND, OR and terms; ANY (None here) stands for no condition.  It never loses a match: what is
optional or not understood counts as ANY, branches of an alternation are united, and all n-grams of a required literal
must be present, since an n-gram depends on its own bytes alone.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from ..functions.grams import grams_of
from .dialect import Node, Pattern


@dataclass(frozen=True)
class Term:
    literal: str


@dataclass(frozen=True)
class Both:
    parts: tuple


@dataclass(frozen=True)
class Either:
    parts: tuple


def both(parts: list) -> object | None:
    parts = [p for p in parts if p is not None]
    return None if not parts else parts[0] if len(parts) == 1 else Both(tuple(parts))


def either(parts: list) -> object | None:
    return None if not parts or any(p is None for p in parts) else parts[0] if len(parts) == 1 else Either(tuple(parts))


def condition(node: Node, least: int = 3) -> object | None:
    """The literals, of at least so many bytes, that every match of `node` needs."""
    if node.kind == "lit":
        return None if node.fold or len(node.text.encode()) < least else Term(node.text)
    if node.kind == "group":
        return condition(node.kids[0], least)
    if node.kind == "cat":
        parts, run = [], ""
        for kid in node.kids:
            exact = kid
            while exact.kind == "group" and len(exact.kids) == 1:
                exact = exact.kids[0]
            if exact.kind == "lit" and not exact.fold:
                run += exact.text
                continue
            if exact.kind == "look" and not exact.text.startswith("(?"):
                continue  # an assertion takes no characters
            if run:
                parts.append(condition(Node("lit", run), least))
            run = ""
            parts.append(condition(kid, least))
        parts.append(condition(Node("lit", run), least) if run else None)
        return both(parts)
    if node.kind == "alt":
        return either([condition(k, least) for k in node.kids])
    if node.kind == "rep" and node.low > 0:
        return condition(node.kids[0], least)
    return None


def literals(pattern: Pattern) -> list[str]:
    """The distinct required or alternative literals of at least two bytes, sorted."""
    out: set[str] = set()

    def walk(n: Node) -> None:
        if n.kind == "lit" and len(n.text.encode()) > 1:
            out.add(n.text)
        for k in n.kids if n.kind != "rep" or n.low > 0 else []:
            walk(k)

    walk(pattern.node)
    return sorted(out)


def covering(literal: str) -> list[bytes]:
    """The sparse n-grams of a literal that lie in no other one of it, longest first."""
    grams = sorted(grams_of(literal.encode()), key=lambda g: (-len(g), g))
    out: list[bytes] = []
    for g in grams:
        if not any(g in h for h in out):
            out.append(g)
    return out


def terms(c: object | None) -> list[str]:
    if isinstance(c, Term):
        return [c.literal]
    return sorted({t for p in getattr(c, "parts", ()) for t in terms(p)})


def candidates(postings: DataFrame, c: object) -> DataFrame:
    """postings(ngram, doc_id) -> doc_id of the documents that meet the condition, each once.

    One scan (with the n-grams pushed down to the sorted files) and one aggregation for the whole tree.
    """
    grams = {t: covering(t) for t in terms(c)}
    wanted = sorted({g for gs in grams.values() for g in gs})
    hit = postings.where(F.col("ngram").isin([F.lit(g) for g in wanted]))
    sets = hit.groupBy("doc_id").agg(F.collect_set("ngram").alias("have"))

    def test(c: object):
        if isinstance(c, Term):
            need = F.array(*[F.lit(g) for g in grams[c.literal]])
            return F.size(F.array_except(need, F.col("have"))) == 0
        tests = [test(p) for p in c.parts]
        out = tests[0]
        for t in tests[1:]:
            out = out & t if isinstance(c, Both) else out | t
        return out

    return sets.where(test(c)).select("doc_id")


def wanted(c: object) -> list[bytes]:
    """The n-grams whose lists the condition needs."""
    return sorted({g for t in terms(c) for g in covering(t)})


def candidates_of_blocks(blocks: DataFrame, c: object) -> DataFrame:
    """blocks(ngram, block, at) of the wanted n-grams -> (block, at): the places of the documents that meet the condition.

    Lists are intersected and united block by block, so that what is shuffled is a row for each n-gram and block.
    """
    lists = blocks.groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("ngram", "at"))).alias("m"))
    none = F.array().cast(blocks.schema["at"].dataType)

    def documents(c: object):
        if isinstance(c, Term):
            parts = [F.coalesce(F.try_element_at(F.col("m"), F.lit(g)), none) for g in covering(c.literal)]
        else:
            parts = [documents(p) for p in c.parts]
        out = parts[0]
        for p in parts[1:]:
            out = F.array_union(out, p) if isinstance(c, Either) else F.array_intersect(out, p)
        return out

    return lists.select("block", documents(c).alias("at"))


def candidates_in_cases(postings: DataFrame, literal: str) -> DataFrame:
    """doc_id of documents that may hold the literal as it is, in lower case or in upper case.

    Mixed case is missed, so no search prunes by this.
    """
    forms = sorted({literal, literal.lower(), literal.upper()})
    return candidates(postings, either([condition(Node("lit", f)) for f in forms]))


def strength(n_candidates: int, n_docs: int, prunable: bool) -> str:
    """'useless' without a condition, 'weak' if no or more than half of the documents remain, else 'strong'."""
    if not prunable:
        return "useless"
    return "weak" if n_candidates == 0 or 2 * n_candidates > n_docs else "strong"
