"""Text decoded with the wrong character encoding (problem 10).

1. Garbled sequences are precomputed for all encoding pairs: what each character of the alphabet becomes when
   its UTF-8 bytes are read in a legacy encoding, once or twice, what the first two of any three UTF-8 bytes become
   (which stands for the characters beyond the alphabet, ideographs among them), and what each common neighbourhood of
   a character becomes when the bytes of one legacy encoding are read in another.
2. A multi-pattern automaton finds them. Texts without a match end here.
3. A match counts only if undoing it makes the place more usual. How usual a character is between its two
   neighbours is learnt from the whole corpus (frequencies of character triples over different texts, added up on the
   cluster; the triples that make up more than 1 / ``MOST_TRIPLES`` of all are broadcast, so fewer than that many, the
   others count through the classes of their neighbours), each text left out of its own evidence. Texts that look garbled throughout say nothing about
   what is usual, else a source that was decoded wrongly would vouch for itself. A sequence that was written on purpose, to show
   what garbling looks like, becomes no more usual when undone and stays.
4. Only the matched spans (for one-byte pairs: the words around them) are replaced, for the encoding pair that
   explains most, then for the next, so mixed and correct text is untouched.

A replacement character U+FFFD marks a passage whose original is lost, unless it stands alone between words.

Defined results: null and empty texts are not garbled. Repeated rows are judged alike. A text is restored as
far as it can be; where nothing can be had back, ``restored`` is null.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.storage import stage
from siltstone.workers import with_code

#: Encodings in which UTF-8 bytes may have been read.
READ_AS = ["cp1252", "latin-1", "iso8859-15", "mac_roman", "cp437", "cp850", "cp1250", "cp1251", "cp1254", "iso8859-2", "cp866", "koi8-r", "cp1253", "cp1255", "cp1256", "cp1257", "cp852"]
#: Pairs of one-byte encodings (true, read as).
PAIRS = [
    ("cp1252", "mac_roman"), ("mac_roman", "cp1252"), ("cp1250", "cp1252"), ("iso8859-2", "cp1252"), ("cp1251", "cp1252"), ("koi8-r", "cp1251"),
    ("cp1251", "koi8-r"), ("cp866", "cp1251"), ("cp1252", "cp437"), ("cp1252", "cp850"), ("cp437", "cp1252"), ("cp850", "cp1252"),
    ("koi8-r", "cp1252"), ("cp866", "cp1252"), ("cp1252", "cp1250"), ("cp1252", "cp1251"), ("iso8859-5", "cp1251"), ("cp1251", "mac_roman"),
    ("cp1253", "cp1252"), ("cp1254", "cp1252"), ("cp1255", "cp1252"), ("cp1256", "cp1252"), ("cp1257", "cp1252"), ("cp852", "cp1250"), ("mac_cyrillic", "cp1251"),
]
#: Encodings whose letters are the bytes of three-byte characters in plain text of their own language.
NOT_WIDE = {"cp866", "cp1256"}
#: Ranges of the characters that authors write, and of those that stand in between when a text is garbled several times.
ALPHABET = [(0x80, 0x17F), (0x192, 0x192), (0x2C6, 0x2DC), (0x370, 0x3FF), (0x400, 0x45F), (0x490, 0x491), (0x5D0, 0x5EA), (0x60C, 0x60C), (0x61B, 0x61F), (0x621, 0x64A), (0x2010, 0x203A), (0x20AC, 0x20AC), (0x2116, 0x2122), (0x2190, 0x2193), (0x2200, 0x2265), (0x2500, 0x256C), (0x3001, 0x3002), (0x300C, 0x300D), (0x3041, 0x30FC)]
NON_ASCII = re.compile(r"[^\x00-\x7f]")
QUOTES = "’‘‚“”„´`'\""
LOST = "�"
LEAST = 3.0
MOST = 0.6
#: Words that hold something other than ASCII.
WORD = re.compile(r"[\x21-\x7e]*[^\s\x00-\x7f]\S*")
#: An apostrophe where English, French and Italian have one.
ELIDED = re.compile(r"[a-zà-ÿ]’(s|t|ve|re|ll|d|m)\b|\b([ldncsjmt]|qu|un|(d|n|s)?[aeu]ll|dall|quest)’[^\W\d_]", re.I)
#: Signs that stand beside a letter in no orthography at hand.
STRAY = set("¸˙‡ˆ‰˘¯˛¨¦¬ƒ∂∆∏∑∫◊ﬁﬂ\uf8ff≈⁄¤¹³¾¼¶")
#: Signs that may stand between letters.
JOINERS = set("’‘'-–—…′″°·/“”„«»|│×")
#: Letters in a row that no Latin orthography has in a row; Cyrillic read as Latin does.
FOREIGN = re.compile(r"[À-ÖØ-öø-ÿ]{4,}")
#: A Cyrillic word with its cases swapped; KOI8-R has them the other way round.
SWAPPED = re.compile(r"\b[а-яё][А-ЯЁ]{3,}\b")
MOST_TRIPLES = 500_000
COMMON = 10  # documents in which a triple must occur to be garbled into a pattern


@lru_cache
def _bytes_to_chars(encoding: str) -> dict[int, str]:
    """Characters of the high bytes; bytes without one become control characters, as most readers do."""
    return {b: bytes([b]).decode(encoding, "ignore") or chr(b) for b in range(128, 256)}


@lru_cache
def _map(true: str, read: str) -> dict[str, str]:
    """Read character to true character of a one-byte pair."""
    t, r = _bytes_to_chars(true), _bytes_to_chars(read)
    return {r[b]: t[b] for b in r if r[b] != t[b]}


@lru_cache
def _table(pair: tuple[str, str]) -> dict[int, str]:
    return str.maketrans(_map(*pair))


def _spelled(text: str, encoding: str) -> str:
    table = _bytes_to_chars(encoding)
    return "".join(c if b < 128 else table[b] for c, b in ((chr(b), b) for b in text.encode()))


def sequences() -> dict[str, dict[str, str]]:
    """garbled sequence: {name of the reading: character}."""
    out: dict[str, dict[str, str]] = {}
    for lo, hi in ALPHABET:
        for c in map(chr, range(lo, hi + 1)):
            for e in READ_AS:
                once = _spelled(c, e)
                out.setdefault(once, {})[e] = c
                for f in (e, *(["cp1252", "latin-1"] if e in ("cp1252", "latin-1") else [])):
                    out.setdefault(_spelled(once, f), {})[f"{e}+{f}" if e != f else f"{e}*2"] = c
            out.setdefault(_spelled(c, "latin-1").replace("\xa0", " "), {}).setdefault("latin-1", c)
    return {s: d for s, d in out.items() if len(s) > 1}


@lru_cache
def wide(encoding: str) -> tuple[dict[str, str], re.Pattern[str]]:
    """What the first two bytes of any three of UTF-8 become, each with a third; and an expression for all three."""
    table = _bytes_to_chars(encoding)
    leads, more = [table[b] for b in range(0xE0, 0xF0)], [table[b] for b in range(0x80, 0xC0)]
    sets = ["[" + "".join(map(re.escape, x)) + "]" for x in (leads, more)]
    return {a + b: encoding for a in leads for b in more}, re.compile(f"{sets[0]}{sets[1]}{{2}}")


def undo_wide(encoding: str, three: str) -> str | None:
    """The character whose three bytes were read so; None if there is none, or the alphabet has it."""
    back = {c: b for b, c in _bytes_to_chars(encoding).items()}
    try:
        c = bytes(back[x] for x in three).decode()
    except UnicodeDecodeError:
        return None
    written = len(c) == 1 and (unicodedata.category(c)[0] in "LMN" or "\u3000" <= c <= "\u303f" or "\uff00" <= c <= "\uffef")
    return c if written and not any(lo <= ord(c) <= hi for lo, hi in ALPHABET) else None


#: Characters that triples tell apart: those of the alphabet and those that the encodings have. This bounds the
#: statistics, whatever scripts a corpus holds; any other character is one and the same letter to them.
TOLD = {chr(c) for lo, hi in ALPHABET for c in range(lo, hi + 1)} | {c for e in {*READ_AS, *sum(PAIRS, ())} for c in _bytes_to_chars(e).values()} | {LOST}
OTHER = "字"


class _Near(dict):
    """Each character as its neighbours see it."""

    def __missing__(self, c: str) -> str:
        self[c] = out = _seen(c)
        return out


def _seen(c: str) -> str:
    return c if "a" <= c <= "z" else "0" if c.isdigit() else " " if c.isspace() else c if c < "\x80" or c in TOLD else OTHER


_near = _Near().__getitem__


def _class(c: str) -> str:
    if c == " " or c == "0":
        return c
    return "l" if c.islower() else "U" if c.isupper() else "a" if c.isalpha() else "q" if c in QUOTES else "."


@lru_cache
def known_sequences() -> dict[str, dict[str, str]]:
    return sequences()


@lru_cache
def _finder() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for s, readings in known_sequences().items():
        found.add_word(s, (len(s), readings))
    found.make_automaton()
    return found


#: Places with something other than ASCII, with what is near; no pattern reaches more than ``MARGIN`` beyond such a place.
PLACES = re.compile(r"[^\x00-\x7f](?:[\x00-\x7f]{0,6}[^\x00-\x7f])*")
MARGIN = 3


def _hits(found: ahocorasick.Automaton, text: str) -> Iterator:
    """(end, value) of every pattern in the text; long runs of ASCII are not looked at."""
    for m in PLACES.finditer(text):
        yield from found.iter(text, max(0, m.start() - MARGIN), min(len(text), m.end() + MARGIN))


HELD = "\0"


def evidence(text: str) -> set[str]:
    """The triples of a text that may tell what is usual; ``HELD``, a triple and characters: what they may come from.

    None of a text in which an author's spelling is out of the question at a quarter of the places, as most one-byte
    pairs make it, or a word has its cases swapped; none around the sequences of a reading that explains half of what isn't ASCII, as UTF-8 bytes do.
    """
    at = [m.start() for m in NON_ASCII.finditer(text)]
    t = f" {text} "
    foreign = {m.start() + k for m in FOREIGN.finditer(text) for k in range(len(m[0]))}
    if sum(i in foreign or may_be_odd(t[i + 1]) and _odd(t[i], t[i + 1], t[i + 2]) for i in at) * 4 >= len(at) or SWAPPED.search(text):
        return set()
    explained: dict[str, dict[int, str]] = {}
    for end, (size, readings) in _hits(_finder(), text):
        for r, c in readings.items():
            explained.setdefault(r, {}).update((i, c) for i in range(end - size + 1, end + 1) if text[i] > "\x7f")
    held: dict[int, set[str]] = {}
    for places in explained.values():
        if len(places) * 2 >= len(at):
            for i, c in places.items():
                held.setdefault(i, set()).add(c)
    return {HELD * (i in held) + _near(t[i]) + t[i + 1] + _near(t[i + 2]) + "".join(sorted(held.get(i, ()))) for i in at if t[i + 1] in TOLD}


def triples(text: str) -> list[str]:
    t = f" {text} "
    return [_near(t[i]) + t[i + 1] + _near(t[i + 2]) for i in (m.start() for m in NON_ASCII.finditer(text)) if t[i + 1] in TOLD]


def count_triples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow function: (text) to (triple, n texts)."""
    for batch in batches:
        counts: Counter[str] = Counter()
        for text in batch.column("text").to_pylist():
            if text and not text.isascii():
                counts.update(evidence(text))
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["triple", "n"])


def _odd(a: str, c: str, b: str) -> bool:
    """Whether no author spells c so between a and b."""
    if c.isupper():
        return a.islower()
    if c.isalnum() and c not in STRAY:
        return False
    return c not in JOINERS and a.isalpha() and b.isalpha() or c in STRAY and (a.isalpha() or b.isalpha())


class _MayBeOdd(dict):
    """Whether a character is odd in some neighbourhood; small letters and most signs of words are in none."""

    def __missing__(self, c: str) -> bool:
        self[c] = out = c.isupper() or c in STRAY or not (c.isalnum() or c in JOINERS)
        return out


may_be_odd = _MayBeOdd().__getitem__


def _holds_odd(text: str) -> bool:
    """Whether a spelling of a text is out of the question somewhere."""
    t = f" {text} "
    return any(c in TOLD and _odd(_near(t[i]), c, _near(t[i + 2])) for i, c in ((m.start(), m[0]) for m in NON_ASCII.finditer(text)) if may_be_odd(c))


def _mixed(word: str) -> bool:
    """Whether Cyrillic and Latin letters meet, or European ones meet those of a script further on."""
    if not word or max(word) < "\u0400":
        return False
    letters = [c for c in word if c.isalpha() or c >= "\u0590" and unicodedata.category(c)[0] in "MN"]
    cyrillic, european = any("\u0400" <= c <= "\u04ff" for c in letters), any(c < "\u0590" for c in letters)
    return cyrillic and any(c < "\u0250" for c in letters) or european and any(c >= "\u0590" for c in letters)


def kind_of(triple: str) -> str:
    return _class(triple[0]) + triple[1] + _class(triple[2])


class Usage:
    """How usual a character is between two others."""

    def __init__(self, counts: dict[str, int], kinds: dict[str, int] | None = None):
        """``kinds`` are the sums over classes of neighbours, where ``counts`` doesn't hold all triples."""
        self.worked_out: dict[tuple, float] = {}
        self.kinds: Counter[str] = Counter(kinds)
        for t, n in counts.items() if kinds is None else ():
            self.kinds[kind_of(t)] += n
        self.counts = {t: n for t, n in counts.items() if n > 1}

    def of(self, a: str, c: str, b: str, own: int = 0) -> float:
        """Log of the smoothed document frequency; ``own`` takes the document itself out."""
        known = self.worked_out.get((a, c, b, own))
        if known is None:
            if len(self.worked_out) > 500_000:
                self.worked_out.clear()
            known = self.worked_out[a, c, b, own] = self._of(a, c, b, own)
        return known

    def _of(self, a: str, c: str, b: str, own: int) -> float:
        kind = self.kinds.get(_class(a) + c + _class(b), 0)
        return math.log(max(0, self.counts.get(a + c + b, 0) - own) + 0.002 * max(0, kind - own) + 0.01)


def neighbourhoods(counts: dict[str, int], kinds: dict[str, int] | None = None) -> dict[str, int]:
    """Garbled triples that are far less usual than what they come from: {sequence: bits of its pairs}."""
    usage = Usage(counts, kinds)
    lower, upper = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    common = {t for t, n in counts.items() if n >= COMMON}
    members = {"l": lower, "U": upper, " ": " "}
    for kind, n in usage.kinds.items():
        if n >= 20 * COMMON and kind[0] in members and kind[2] in members and (kind[0] + kind[2]) != "  ":
            common.update(a + kind[1] + b for a in members[kind[0]] for b in members[kind[2]])
    worth = {t: usage.of(*t) for t in common}
    out: dict[str, int] = {}
    for p, (true, read) in enumerate(PAIRS):
        back = {t: r for r, t in _map(true, read).items()}
        for t, usual in worth.items():
            if t[1] in back:
                g = "".join(back.get(c, c) for c in t)
                if usual - usage.of(_near(g[0]), g[1], _near(g[2]), 1) >= 1:
                    out[g] = out.get(g, 0) | 1 << p
    return out


class Mender:
    """Finds and undoes garbling; made once per worker from the corpus statistics."""

    def __init__(self, counts: dict[str, int], kinds: dict[str, int] | None = None, patterns: dict[str, int] | None = None):
        self.usage = Usage(counts, kinds)
        self.known = {k[1] for k in self.usage.kinds}
        self.gains: dict[tuple[str, str, str, str], tuple[float, bool]] = {}
        self.readings = known_sequences()
        self.found = ahocorasick.Automaton()
        patterns = neighbourhoods(counts, kinds) if patterns is None else patterns
        # A pattern may be in all three sets; what it says is kept for each.
        said: dict[str, list] = {s: [s, 0, ()] for s in self.readings}
        for s, pairs in patterns.items():
            if s not in self.readings:
                said[s] = [None, pairs, ()]
        for e in READ_AS:
            for s in wide(e)[0] if e not in NOT_WIDE else ():
                one = said.setdefault(s, [None, 0, ()])
                one[2] = (*one[2], e)
        for s, what in said.items():
            self.found.add_word(s, tuple(what))
        self.found.make_automaton()

    def _gain_of_sequence(self, before: str, seq: str, after: str, char: str, left: str, right: str) -> float:
        """How much more usual the place becomes; left and right are the neighbours once mended."""
        s = f"{before}{seq}{after}"
        was = min(self.usage.of(_near(s[i]), s[i + 1], _near(s[i + 2]), 1) for i in range(len(seq)) if ord(s[i + 1]) > 127)
        gain = self.usage.of(_near(left), char, _near(right)) - was
        if _mixed(left + char) or _mixed(char + right):
            gain -= 8
        elif char in "“”„":
            gain += 2
        elif char.isalpha():
            gain += 4 if left.isalpha() or right.isalpha() else 0
        elif char in "’‘":
            gain += 4 if left.isalnum() or right.isalnum() else 0
        else:
            gain += 4
        return gain

    def _spans(self, text: str, hits: list[tuple[int, str]], reading: str, beyond: bool = False) -> list[tuple[int, int, str, float]]:
        """Non-overlapping spans of one reading, leftmost and longest, with what they gain; ``beyond``: those of characters beyond the alphabet, too."""
        own = [(end - len(s) + 1, -len(s), self.readings[s][reading]) for end, s in hits if reading in self.readings[s]]
        if beyond:
            own += [(m.start(), -3, c) for m in wide(reading)[1].finditer(text) if (c := undo_wide(reading, m[0]))]
        spans, free = [], 0
        for start, size, c in sorted(own):
            if start >= free:
                spans.append((start, start - size, c))
                free = start - size
        out = []
        for k, (a, b, c) in enumerate(spans):
            left = spans[k - 1][2] if k and spans[k - 1][1] == a else text[a - 1] if a else " "
            right = spans[k + 1][2] if k + 1 < len(spans) and spans[k + 1][0] == b else text[b] if b < len(text) else " "
            gain = self._gain_of_sequence(text[a - 1] if a else " ", text[a:b], text[b] if b < len(text) else " ", c, left, right)
            out.append((a, b, c, gain))
        return out

    def _mend_sequences(self, text: str, hits: list[tuple[int, str]], beyond: set[str]) -> list[tuple[int, int, str, float]]:
        readings = {r for _, s in hits for r in self.readings[s]} | beyond
        best: list[tuple[int, int, str, float]] = []
        most = 0.0
        for r in sorted(readings):
            spans = self._spans(text, hits, r, r in beyond)
            # Where a reading explains one place for sure, little is needed for the next.
            sure = any(x[3] >= LEAST for x in spans)
            spans = [x for x in spans if x[3] >= (1 if sure else LEAST)]
            total = sum(x[3] * (x[1] - x[0]) for x in spans)
            if total > most:
                best, most = spans, total
        return best

    def _covering(self, text: str, hits: list[tuple[int, str]], beyond: set[str]) -> list[tuple[int, int, str, float]]:
        """The spans of a reading that explains all but a twentieth of what isn't ASCII; none in a text with little of that.

        So much doesn't come by chance, whatever the corpus says of the characters: those of a script that no other
        text has, or what is in between when a text was garbled several times.
        """
        n = len(NON_ASCII.findall(text))
        best: list[tuple[int, int, str, float]] = []
        most = -math.inf
        for r in sorted({r for _, s in hits for r in self.readings[s]} | beyond) if n >= 8 else ():
            spans = self._spans(text, hits, r, r in beyond)
            covered = sum(len(NON_ASCII.findall(text, a, b)) for a, b, *_ in spans)
            total = sum(x[3] * (x[1] - x[0]) for x in spans)
            if covered * 20 >= n * 19 and total > most:
                best, most = spans, total
        return best

    def _gain_of_word(self, left: str, word: str, mended: str, right: str) -> tuple[float, bool]:
        """How much more usual a word becomes, and whether its spelling can't be an author's."""
        key = (left, word, mended, right)
        known = self.gains.get(key)
        if known is None:
            if len(self.gains) > 200_000:
                self.gains.clear()
            known = self.gains[key] = self._work_out(*key)
        return known

    def _work_out(self, left: str, word: str, mended: str, right: str) -> tuple[float, bool]:
        was, now = f"{left}{word}{right}", f"{left}{mended}{right}"
        gain, odd = 0.0, False
        for i, c in enumerate(word):
            if c == mended[i] and ord(c) < 128:
                continue
            then = self.usage.of(_near(was[i]), was[i + 1], _near(was[i + 2]), 1)
            here = self.usage.of(_near(now[i]), now[i + 1], _near(now[i + 2])) if ord(mended[i]) > 127 else 0.0
            gain += max(-8.0, min(8.0, here - then))
            if c != mended[i]:
                odd |= mended[i].isalpha() and _odd(was[i], c, was[i + 2]) and not _odd(now[i], mended[i], now[i + 2])
                odd |= mended[i] == "’" and c.isalpha() and bool(ELIDED.search(now[: i + 1].rpartition(" ")[2] + now[i + 1 :]))
        return gain + 2 * odd, odd

    def _mend_words(self, text: str, pairs: set[int]) -> list[tuple[int, int, str, float]]:
        """The words that one pair of encodings explains, for the pair that explains most.

        A pair needs a word whose present spelling can't be an author's, or else two different words and most
        of all words that it would change.
        """
        words = [(m.start(), m.end(), m[0]) for m in WORD.finditer(text)]
        best: list[tuple[int, int, str, float]] = []
        most = 0.0
        for p in sorted(pairs):
            whole, spans, odd, changed = text.translate(_table(PAIRS[p])), [], False, 0
            for a, b, word in words:
                mended = whole[a:b]
                if mended == word:
                    continue
                changed += 1
                if _mixed(mended) and not _mixed(word):
                    continue
                gain, sure = self._gain_of_word(text[a - 1] if a else " ", word, mended, text[b] if b < len(text) else " ")
                if gain >= LEAST:
                    spans.append((a, b, mended, gain))
                    odd |= sure
            total = sum(x[3] for x in spans)
            if total > most and (odd or len({x[2] for x in spans}) > 1 and len(spans) >= MOST * changed and any(c.isalpha() for x in spans for c in x[2] if ord(c) > 127)):
                best, most = spans, total
        return best

    def mend(self, text: str | None) -> tuple[bool, str | None]:
        """Whether the text is garbled, and the text mended as far as it can be."""
        if not text or text.isascii():
            return False, None
        garbled, now, seen = False, text, {text}
        while True:  # until nothing is gained any more: a text may have been garbled any number of times
            us, pairs, beyond = [], 0, set()
            for end, (sequence, some, readings) in _hits(self.found, now):
                if sequence is not None:
                    us.append((end, sequence))
                pairs |= some
                beyond.update(readings)
            beyond = {e for e in beyond if wide(e)[1].search(now)} if beyond else beyond
            spans = self._mend_sequences(now, us, beyond) if us or beyond else []
            known = any(x[2] in self.known for x in spans)
            part = known and sum(len(NON_ASCII.findall(now, a, b)) for a, b, *_ in spans) * 20 < len(NON_ASCII.findall(now)) * 19
            whole = self._covering(now, us, beyond) if part or not known and (us or beyond) else []
            if known:
                spans = whole or spans
            else:
                # Characters that no text has give way to what a pair of one-byte encodings explains.
                # A spelling that can't be an author's is looked into even where the corpus is too small to tell.
                if _holds_odd(now):
                    pairs = (1 << len(PAIRS)) - 1
                if whole:
                    spans = whole
                elif pairs:
                    spans = self._mend_words(now, {p for p in range(len(PAIRS)) if pairs >> p & 1}) or spans
            if not spans:
                break
            garbled, parts, at = True, [], 0
            for a, b, c, _ in spans:
                parts += [now[at:a], c]
                at = b
            now = "".join(parts) + now[at:]
            if now in seen:
                break
            seen.add(now)
        if not garbled and LOST in text:
            return any(not (x[0] == " " and x[2] == " ") for x in triples(text) if x[1] == LOST), None
        return garbled, now if garbled else None


def mend_texts(learnt):
    """mapInArrow function: (doc_id, text) to (doc_id, restored, lost) of the garbled ones.

    ``learnt`` is the broadcast of the triples' counts, those of their classes and the patterns made of them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mender = None
        for batch in batches:
            if mender is None:  # once per worker, which keeps the broadcast between tasks
                mender = learnt.__dict__.get("mender") or Mender(*learnt.value)
                learnt.mender = mender
            out = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                garbled, mended = mender.mend(text)
                if garbled:
                    out.append((doc, mended, LOST in (mended or text)))
            if out:
                columns = list(zip(*out))
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], batch.column("doc_id").type), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.bool_())], names=["doc_id", "restored", "lost"])

    return run


def _kinds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow function: (triple, n) to (kind, n)."""
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array([kind_of(t) for t in batch.column("triple").to_pylist()], pa.string()), batch.column("n")], names=["kind", "n"])


def corpus_statistics(docs: DataFrame) -> tuple[dict[str, int], dict[str, int]]:
    """How many different texts vouch for each frequent triple around a character of ``TOLD``, and for each class of triples.

    Rows with equal texts count once, so a boilerplate text is one text. All of it is added up on the cluster; what
    comes to the driver are fewer than ``MOST_TRIPLES`` triples and the classes, which a character and seven sorts of
    neighbours on either side bound.
    """
    some = docs.select("text").where(r"text rlike '[^\\x00-\\x7f]'")
    counts = stage(with_code(some).dropDuplicates(["text"]).mapInArrow(count_triples, "triple string, n long").groupBy("triple").agg(F.sum("n").alias("n")), "triples")
    held = F.col("triple").startswith(HELD)
    known = "".join(r[0] for r in counts.where(~held).select(F.substring("triple", 2, 1)).distinct().collect())  # at most the characters of TOLD
    # What was held back counts after all where no text has any character that it may come from.
    free = counts.where(~held)
    left = F.substring("triple", 5, 2**31 - 1)
    late = counts.where(held).where(F.translate(left, known, "") == left if known else F.lit(True)).select(F.substring("triple", 2, 3).alias("triple"), "n")
    whole = stage(free.unionByName(late).groupBy("triple").agg(F.sum("n").alias("n")), "usage")
    total = whole.agg(F.sum("n")).first()[0] or 0
    frequent = whole.where((F.col("n") > 1) & (F.col("n") * MOST_TRIPLES > total)).toLocalIterator()
    kinds = with_code(whole).mapInArrow(_kinds, "kind string, n long").groupBy("kind").agg(F.sum("n").alias("n")).toLocalIterator()
    return {r["triple"]: r["n"] for r in frequent}, {r["kind"]: r["n"] for r in kinds}


def find_garbled(docs: DataFrame) -> DataFrame:
    """doc_id, restored, lost of every garbled row of ``docs`` (doc_id, text)."""
    counts, kinds = corpus_statistics(docs)
    learnt = docs.sparkSession.sparkContext.broadcast((counts, kinds, neighbourhoods(counts, kinds)))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(mend_texts(learnt), f"doc_id {kind}, restored string, lost boolean")
