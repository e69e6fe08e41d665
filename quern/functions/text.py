"""Text search as expressions: tokens, query grammar, stems, snippets."""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

K1, B, LEAST_IDF = 1.2, 0.75, 1e-6
FOLDED = "".join(chr(c) for c in range(0xC0, 0x250) if len(unicodedata.normalize("NFD", chr(c))) > 1)
PLAIN = "".join(unicodedata.normalize("NFD", c)[0] for c in FOLDED)


def tokens(c: Column, fold: bool = True) -> Column:
    """Lower-cased runs of letters and digits; accents of Latin letters are dropped unless ``fold`` is false."""
    low = F.lower(c)
    if fold:
        low = F.translate(low, FOLDED, PLAIN)
    return F.filter(F.split(low, r"[^\p{L}\p{N}]+"), lambda t: t != "")


def python_tokens(text: str, fold: bool = True) -> list[str]:
    low = text.lower()
    if fold:
        low = low.translate(str.maketrans(FOLDED, PLAIN))
    return [t for t in re.split(r"[\W_]+", low) if t]


@dataclass(frozen=True)
class Term:
    """One clause of a query: a word, a phrase of words, or a prefix."""

    words: tuple[str, ...]
    prefix: bool = False


def parse_query(text: str, fold: bool = True, stem: bool = False) -> list[Term]:
    """Bare words, "a phrase" and pre*; punctuation splits as it does in the indexed text."""
    out = []
    for m in re.finditer(r'"([^"]*)"|(\S+)', text):
        if m[1] is not None:
            words = tuple(python_tokens(m[1], fold))
            out += [Term(tuple(map(porter, words)) if stem else words)] if words else []
        else:
            words = python_tokens(m[2], fold)
            prefix = m[2].endswith("*")
            for k, w in enumerate(words):
                last = prefix and k == len(words) - 1
                out.append(Term((porter(w) if stem and not last else w,), last))
    return out


def occurrences(toks: Column, term: Term) -> Column:
    """How often the clause occurs in the token array."""
    if term.prefix:
        return F.size(F.filter(toks, lambda t: t.startswith(term.words[0])))
    if len(term.words) == 1:
        return F.size(F.filter(toks, lambda t: t == term.words[0]))
    joined = F.concat(F.lit(" "), F.array_join(toks, " "), F.lit(" "))  # one pass; the lookahead counts overlapping places too
    return F.regexp_count(joined, F.lit(f"(?= {' '.join(term.words)} )"))


def matches(toks: Column, terms: list[Term], every: bool) -> Column:
    """All (or any) clauses occur; a query without clauses matches nothing."""
    if not terms:
        return F.lit(False)
    hits = [F.array_contains(toks, t.words[0]) if len(t.words) == 1 and not t.prefix else occurrences(toks, t) > 0 for t in terms]
    out = hits[0]
    for h in hits[1:]:
        out = out & h if every else out | h
    return F.coalesce(out, F.lit(False))


def snippet(before: str = "<b>", after: str = "</b>", ellipsis: str = "…", width: int = 12, terms: list[Term] | None = None, stem: bool = False, fold: bool = True):
    """A pandas function of text: the ``width`` (at most 64) tokens with most hits, hits marked."""
    width = max(1, min(width, 64))
    words = {w for t in terms or [] if not t.prefix for w in t.words}
    prefixes = tuple(t.words[0] for t in terms or [] if t.prefix)

    def hit(token: str) -> bool:
        plain = "".join(python_tokens(token, fold))
        return (porter(plain) if stem else plain) in words or bool(prefixes) and plain.startswith(prefixes)

    def one(text: str | None) -> str | None:
        if text is None:
            return None
        spans = [m.span() for m in re.finditer(r"[^\W_]+", text)]
        hits = [hit(text[a:b]) for a, b in spans]
        if not spans:
            return text
        best = max(range(max(1, len(spans) - width + 1)), key=lambda k: (sum(hits[k : k + width]), -k))
        end = min(best + width, len(spans))
        out, at = [], spans[best][0]
        for k in range(best, end):
            a, b = spans[k]
            out += [text[at:a], before + text[a:b] + after if hits[k] else text[a:b]]
            at = b
        return (ellipsis if best else "") + "".join(out) + (ellipsis if end < len(spans) else "")

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(one)

    return run


_VOWELS = "aeiou"


def _consonant(w: str, i: int) -> bool:
    return w[i] not in _VOWELS and (w[i] != "y" or i == 0 or not _consonant(w, i - 1))


def _measure(w: str) -> int:
    shape = "".join("c" if _consonant(w, i) else "v" for i in range(len(w)))
    return len(re.findall("v+c", shape))


def _has_vowel(w: str) -> bool:
    return any(not _consonant(w, i) for i in range(len(w)))


def _double(w: str) -> bool:
    return len(w) > 1 and w[-1] == w[-2] and _consonant(w, len(w) - 1)


def _cvc(w: str) -> bool:
    n = len(w)
    return n > 2 and _consonant(w, n - 3) and not _consonant(w, n - 2) and _consonant(w, n - 1) and w[-1] not in "wxy"


_STEP2 = "ational:ate tional:tion enci:ence anci:ance izer:ize abli:able alli:al entli:ent eli:e ousli:ous ization:ize ation:ate ator:ate alism:al iveness:ive fulness:ful ousness:ous aliti:al iviti:ive biliti:ble"
_STEP3 = "icate:ic ative: alize:al iciti:ic ical:ic ful: ness:"
_STEP4 = "al ance ence er ic able ible ant ement ment ent ou ism ate iti ous ive ize".split()


def _table(w: str, rules: str) -> str:
    for suffix, new in sorted((r.split(":") for r in rules.split()), key=lambda r: -len(r[0])):
        if w.endswith(suffix):
            stem = w[: -len(suffix)]
            return stem + new if _measure(stem) > 0 else w
    return w


def porter(w: str) -> str:
    """The suffix stripping algorithm of Porter (1980)."""
    if len(w) < 3 or not w.isascii() or not w.isalpha():
        return w
    if w.endswith("sses") or w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        if _measure(w[:-3]) > 0:
            w = w[:-1]
    else:
        for suffix in ("ed", "ing"):
            if w.endswith(suffix) and _has_vowel(w[: -len(suffix)]):
                w = w[: -len(suffix)]
                if w.endswith(("at", "bl", "iz")):
                    w += "e"
                elif _double(w) and w[-1] not in "lsz":
                    w = w[:-1]
                elif _measure(w) == 1 and _cvc(w):
                    w += "e"
                break
    if w.endswith("y") and _has_vowel(w[:-1]):
        w = w[:-1] + "i"
    w = _table(_table(w, _STEP2), _STEP3)
    for suffix in sorted([*_STEP4, "ion"], key=len, reverse=True):
        if w.endswith(suffix):
            stem = w[: -len(suffix)]
            if _measure(stem) > 1 and (suffix != "ion" or stem[-1:] in ("s", "t")):
                w = stem
            break
    if w.endswith("e"):
        m = _measure(w[:-1])
        if m > 1 or m == 1 and not _cvc(w[:-1]):
            w = w[:-1]
    return w[:-1] if _measure(w) > 1 and _double(w) and w.endswith("l") else w


# The same algorithm as expressions of one word: no token leaves the JVM. In the patterns, a run of consonants or vowels is
# taken whole (possessively), so "y" is what the letter before it makes of it, and a stem too short can't borrow from the suffix.
_LEAD, _V, _C = "^(?:[^aeiou][^aeiouy]*+)?+", "[aeiouy][aeiou]*+", "[^aeiou][^aeiouy]*+"
_SOME, _MORE, _SPOKEN = f"{_LEAD}{_V}[^aeiou].*", f"{_LEAD}{_V}{_C}{_V}[^aeiou].*", f"{_LEAD}[aeiouy].*"  # measure over 0, over 1, with a vowel
_SHORT = "[^aeiou][^aeiouy]*+[aeiouy][^aeiouwxy]"  # of measure 1, and ends in consonant, vowel, consonant
_TWICE = r"([^aeioulszy])\1$|(?<![^aeiou])y(?:yy)++$|(?<=[^aeiouy])(?:yy)++$"  # a double consonant at the end, but for l, s, z


def let(value: Column, body) -> Column:
    """``body`` of ``value``, which is worked out once however often ``body`` names it."""
    return F.transform(F.array(value), body)[0]


def _mended(w: Column) -> Column:
    """A word that has lost -ed or -ing."""
    shorter = F.substring(w, F.lit(1), F.length(w) - 1)
    return F.when(w.rlike("(?:at|bl|iz)$"), F.concat(w, F.lit("e"))).when(w.rlike(_TWICE), shorter).when(w.rlike(f"^{_SHORT}$"), F.concat(w, F.lit("e"))).otherwise(w)


def _past(w: Column) -> Column:
    cut = F.regexp_replace(w, "(?:ed|ing)$", "")
    return F.when(w.endswith("eed"), F.regexp_replace(w, f"({_SOME})eed$", "$1ee")).when(w.rlike(f"{_SPOKEN}(?:ed|ing)$"), let(cut, _mended)).otherwise(w)


def _ruled(w: Column, rules: str) -> Column:
    out = F  # when() of nothing yet
    for suffix, new in sorted((r.split(":") for r in rules.split()), key=lambda r: -len(r[0])):
        out = out.when(w.endswith(suffix), F.regexp_replace(w, f"({_SOME}){suffix}$", f"$1{new}"))
    return out.otherwise(w)


def stemmed(w: Column) -> Column:
    """:func:`porter` of a word."""
    ends = "|".join([*_STEP4, "(?<=[st])ion"])

    def run(w: Column) -> Column:
        out = F.regexp_replace(w, "(?:(?<=ss|i)es|(?<!s)s)$", "")
        out = F.regexp_replace(let(out, _past), f"({_SPOKEN})y$", "$1i")
        out = let(let(out, lambda x: _ruled(x, _STEP2)), lambda x: _ruled(x, _STEP3))
        out = F.regexp_replace(out, f"^(?={_MORE})(?=.*?({ends})$)({_MORE})\\1$", "$2")  # the first place found has the longest ending
        out = F.regexp_replace(out, f"^(?!{_SHORT}e$)({_SOME})e$", "$1")
        return F.regexp_replace(out, f"^(?={_MORE})(.*l)l$", "$1")

    return let(w, lambda w: F.when(w.rlike("^[A-Za-z]{3,}\\z"), run(w)).otherwise(w))


def _kept(s: str) -> str:
    """What of a stem, or of the start of one, every word with this stem starts with. Only the last step that changed the
    word puts letters where it had others: -e behind two letters at least, -le (an -l later) behind three, -i behind one."""
    if s.endswith("le") and len(s) > 4:
        return s[:-2]
    return s[:-1] if any(s.endswith(tail) and len(s) >= least for tail, least in (("e", 3), ("l", 4), ("i", 2))) else s


def stem_all(toks: Column, terms: list[Term] | None = None) -> Column:
    """Token arrays with stems. With ``terms``, only tokens that can be found by these are stemmed; others stay, and no term finds them."""
    if terms is None:
        return F.transform(toks, stemmed)
    heads = sorted({_kept(w) for t in terms for w in t.words})
    if not heads:
        return toks
    return F.transform(toks, lambda t: F.when(reduce(lambda a, b: a | b, (t.startswith(h) for h in heads)), stemmed(t)).otherwise(t))
