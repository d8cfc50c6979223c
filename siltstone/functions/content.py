"""``content:`` functions on tokenised text, and the tokeniser.

A tokenised field is a column of text; its tokens are runs of letters and digits, lower-cased. Phrases are
looked for in the text rewritten as tokens between single spaces, which is one scan of a string; only the
distance of unordered terms needs the tokens' positions.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from siltstone.lang.ast import Ident, Lit, Node
from siltstone.lang.jexl import QueryError
from siltstone.plans.compiler import Compiler, function, truth

Args = tuple[Node, ...]


def spaced(text: Column) -> Column:
    """The tokens with one space before, between and behind."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " ")), F.lit(" "))


def tokens(text: Column) -> Column:
    return F.filter(F.split(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "), " "), lambda t: t != "")


TOKENS = "array<struct<term:string,pos:int,skips:int,score:float>>"


def _plain_letters() -> tuple[str, str]:
    """Accented letters of the Latin script and what they are without the accent, of one character each."""
    pairs = [(chr(c), unicodedata.normalize("NFD", chr(c))[0]) for c in range(0xC0, 0x250)]
    kept = [(a, b.lower()) for a, b in pairs if a != b and b.isascii()]
    return "".join(a for a, _ in kept), "".join(b for _, b in kept)


def analyse(text: Column, stop_words: set[str] = frozenset(), synonyms: dict[str, list[str]] | None = None, most: int | None = None, accents: bool = False, score: Callable[[Column, Column], Column] | None = None) -> Column:  # type: ignore[assignment]
    """The tokens of a text as structs (term, pos, skips, score).

    Stop words are left out, but keep their position; ``skips`` counts those right before a token. Tokens are cut to
    ``most`` characters and lose their accents unless these are kept. Synonyms come behind their term at the same
    position. ``score`` makes a score of a term and its position; else it is null.
    """
    plain = text if accents else F.translate(text, *_plain_letters())
    words = tokens(plain)
    words = words if most is None else F.transform(words, lambda w: F.substring(w, 1, most))
    made = lambda w, i, n: F.struct(w.alias("term"), i.cast("int").alias("pos"), n.cast("int").alias("skips"), (score(w, i) if score else F.lit(None)).cast("float").alias("score"))
    if not stop_words:
        found = F.transform(words, lambda w, i: made(w, i, F.lit(0)))
    else:
        placed = F.transform(words, lambda w, i: F.struct(w.alias("w"), i.alias("i")))
        kept = F.filter(placed, lambda x: ~x["w"].isin(*sorted(stop_words)))
        found = _with(kept, lambda ws: F.transform(ws, lambda x, k: made(x["w"], x["i"], x["i"] - F.coalesce(F.get(ws, k - 1)["i"], F.lit(-1)) - 1)))
    if synonyms:
        same = F.create_map(*[x for k, v in synonyms.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
        others = lambda x: F.coalesce(F.try_element_at(same, x["term"]), F.array().cast("array<string>"))
        found = F.flatten(F.transform(found, lambda x: F.concat(F.array(x), F.transform(others(x), lambda t: F.struct(t.alias("term"), x["pos"].alias("pos"), x["skips"].alias("skips"), x["score"].alias("score"))))))
    return found.cast(TOKENS)


def in_order(found: Column, terms: list[str], most: float | None = None) -> Column:
    """Whether tokens hold the terms one behind the other: a token follows those at the position before it, or before the ones it skips.

    With a bound only tokens that score at most so much count; one without a score counts always.
    """
    fits = lambda x, t: (x["term"] == t) & (F.lit(True) if most is None else F.coalesce(x["score"] <= most, F.lit(True)))

    def behind(ws: Column, ends: Column, k: int) -> Column:
        """Whether the terms from k on follow one of the positions."""
        if k == len(terms):
            return F.size(ends) > 0
        follows = lambda x: F.exists(ends, lambda p: (p < x["pos"]) & (p >= x["pos"] - x["skips"] - 1))
        return _with(F.transform(F.filter(ws, lambda x: fits(x, terms[k]) & follows(x)), lambda x: x["pos"]), lambda e: behind(ws, e, k + 1))

    first = F.transform(F.filter(found, lambda x: fits(x, terms[0])), lambda x: x["pos"])
    return _with(first, lambda ends: behind(found, ends, 1))


def _with(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once, however often it is named."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _analysed(c: Compiler, args: Args) -> list[Column]:
    """Columns of analysed tokens among the fields of a call."""
    return [F.col(f) for a in args if isinstance(a, Ident) and (f := c.catalog.analysed.get(a.name.upper()))]


def _split(c: Compiler, args: Args, numbers: int) -> tuple[list[Column], list[float], list[str]]:
    """Text columns, leading numbers and terms of a call; the offset map's name is skipped."""
    zones = [a for a in args if isinstance(a, Ident) and a.name.lower() != "termoffsetmap"]
    literals = [a.value for a in args if isinstance(a, Lit)]
    fields = [f for z in zones for f in c.values(z).fields] if zones else [f for f in c.catalog.fields.values() if f.tokenized]
    terms = [str(v).lower() for v in literals[numbers:]]
    if len(terms) < 2:
        raise QueryError("at least two terms are needed")
    texts = [F.array_join(F.transform(F.col(f.column), lambda x: f.raw(x)), " ") if f.multi else f.raw(F.col(f.column)) for f in fields]
    return texts, [float(v) for v in literals[:numbers]], terms  # type: ignore[arg-type]


def _any(tests: list[Column]) -> Column:
    out = F.lit(False)
    for t in tests:
        out = out | truth(t)
    return out


@function("content", "phrase")
def phrase(c: Compiler, args: Args) -> Column:
    """The terms next to each other, in this order. In a field of analysed tokens synonyms and skipped words count."""
    if found := _analysed(c, args):
        return _any([in_order(f, [str(a.value).lower() for a in args if isinstance(a, Lit)]) for f in found])
    texts, _, terms = _split(c, args, 0)
    return _any([F.contains(spaced(t), F.lit(f" {' '.join(terms)} ")) for t in texts])


def narrowest(words: Column, terms: list[str]) -> Column:
    """Least distance between first and last position of a set of positions, one for each term; null if one is missing.

    One pass over the positions of the terms, which keeps the last position of each term.
    """
    listed = F.array(*[F.lit(t) for t in terms])
    at = F.filter(F.transform(words, lambda w, i: F.struct(i.alias("i"), F.array_position(listed, w).cast("int").alias("k"))), lambda x: x["k"] > 0)
    start = F.struct(F.array_repeat(F.lit(-1), len(terms)).alias("last"), F.lit(2**31 - 1).alias("best"))

    def step(acc: Column, x: Column) -> Column:
        last = F.transform(acc["last"], lambda p, j: F.when(j == x["k"] - 1, x["i"]).otherwise(p))
        low = F.array_min(last)
        return F.struct(last.alias("last"), F.when(low >= 0, F.least(acc["best"], x["i"] - low)).otherwise(acc["best"]).alias("best"))

    best = F.aggregate(at, start, step)["best"]
    return F.when(best < 2**31 - 1, best)


@function("content", "within")
def within(c: Compiler, args: Args) -> Column:
    """One position of each term, in any order, no farther apart than the distance."""
    texts, [distance], terms = _split(c, args, 1)
    if distance < 0:
        raise QueryError("the distance is negative")
    return _any([_near(t, terms, int(distance)) for t in texts])


def _near(text: Column, terms: list[str], distance: int) -> Column:
    terms = list(dict.fromkeys(terms))
    # Texts that lack a term are told by plain searches; only the others are taken apart.
    line = spaced(text)
    have = F.lit(True)
    for t in terms:
        have = have & F.contains(line, F.lit(f" {t} "))
    return F.when(have, truth(narrowest(tokens(text), terms) <= distance)).otherwise(F.lit(False))


@function("content", "adjacent")
def adjacent(c: Compiler, args: Args) -> Column:
    texts, _, terms = _split(c, args, 0)
    return _any([_near(t, terms, len(terms) - 1) for t in texts])


@function("content", "scoredPhrase")
def scored_phrase(c: Compiler, args: Args) -> Column:
    """A phrase of tokens that score at most the given; the field must hold analysed tokens, which carry scores."""
    found = _analysed(c, args)
    if not found:
        raise QueryError("scores need a field of analysed tokens")
    most, *terms = [a.value for a in args if isinstance(a, Lit)]
    return _any([in_order(f, [str(t).lower() for t in terms], float(most)) for f in found])  # type: ignore[arg-type]


def excerpt(text: Column, terms: list[str], n: int, side: str = "both") -> Column:
    """The first hit of a phrase with ``n`` tokens before, after or on both sides; null without a hit."""
    line, hit = spaced(text), f" {' '.join(terms)} "
    at = F.instr(line, hit)
    before = F.substring_index(F.trim(F.substring(line, F.lit(1), at)), " ", -n)
    after = F.substring_index(F.trim(F.substring(line, at + F.lit(len(hit)), F.length(line))), " ", n)
    parts = ([before] if side in ("both", "before") and n else []) + [F.lit(" ".join(terms))] + ([after] if side in ("both", "after") and n else [])
    return F.when(at > 0, F.trim(F.concat_ws(" ", *parts)))
