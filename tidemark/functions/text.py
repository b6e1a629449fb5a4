"""Text expressions: cleaning, sentences, hashes, tokens, matching. Columns in, columns out; no Python per row."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def name_key(name: Column) -> Column:
    """A community's key: trimmed, lower case, without the prefix r/."""
    return F.regexp_replace(F.lower(F.trim(name)), "^r/", "")


def squashed(text: Column) -> Column:
    """Lower case, trimmed, runs of white space as one space."""
    return F.lower(F.regexp_replace(F.trim(text), r"\s+", " "))


def body_hash(text: Column) -> Column:
    return F.md5(squashed(text))


def norm_hash(text: Column) -> Column:
    """SHA-256 of lower-case letters and digits, words one space apart; equal for texts that differ in marks only."""
    kept = F.regexp_replace(F.lower(F.trim(text)), r"[^a-z0-9\s]", "")
    return F.sha2(F.regexp_replace(kept, r"\s+", " "), 256)


#: What goes out of a text, in order: code before anything that may stand in it; a link keeps its words, so it is opened
#: before bare addresses are taken; lines that quote another go whole; all white space is one space at last.
CLEANING = (
    (r"```[^`]*```|`[^`]*`", " "),
    (r"\[([^\]]*)\]\([^)]*\)", "$1"),
    (r"https?://\S+|[\w.+-]+@[\w-]+\.[\w.]+", " "),
    (r"(?m)^>.*$", ""),
    (r"\s+", " "),
)


def cleaned(text: Column) -> Column:
    """Without code, links, mail addresses and quoted lines; the words of links stay. Null of a null."""
    for pattern, by in CLEANING:
        text = F.regexp_replace(text, pattern, by)
    return F.trim(text)


def sentences(text: Column) -> Column:
    """Trimmed, non-empty pieces between marks that end a sentence."""
    return F.filter(F.transform(F.split(text, r"[.!?\n]+"), lambda s: F.trim(s)), lambda s: s != "")


def tokens(text: Column, least: int = 1) -> Column:
    """Lower-case runs of ASCII letters and digits of at least ``least``."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]{%d,}" % least), F.lit(0))


def word_pattern(terms: list[str]) -> str:
    """Whole words or phrases of ``terms``, any white space between their words, longest first."""
    parts = (r"\s+".join(map(re.escape, t.lower().split())) for t in sorted(terms, key=lambda t: (-len(t), t)))
    return r"\b(?:" + "|".join(parts) + r")\b"


def mentions(text: Column, terms: list[str]) -> Column:
    return F.lower(text).rlike(word_pattern(terms)) if terms else F.lit(False)


def occurrences(text: Column, term: str) -> Column:
    """How often ``term`` stands in the text, not overlapping, as any part of it."""
    return F.regexp_count(F.lower(text), F.lit(re.escape(term.lower())))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; 0 where both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(F.lit(0.0))


def cosine(a: Column, b: Column) -> Column:
    """Of unit vectors: their inner product, in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def slug(name: Column) -> Column:
    """``r/`` and the key; null where nothing is left."""
    key = name_key(F.coalesce(name, F.lit("")))
    return F.when(key != "", F.concat(F.lit("r/"), key))


def sentence_key(sentence: Column) -> Column:
    """Lower-case letters and digits, all else as white space, one space apart."""
    kept = F.regexp_replace(F.lower(sentence), r"[^a-z0-9\s]", " ")
    return F.trim(F.regexp_replace(kept, r"\s+", " "))


def sentence_hash(sentence: Column) -> Column:
    """SHA-256 of the key; empty of an empty key, null of a null."""
    key = sentence_key(sentence)
    return F.when(key == "", "").otherwise(F.sha2(key, 256))


def bigrams(words: Column) -> Column:
    """Neighbouring words joined by _, in order; empty of fewer than two."""
    n = F.size(words)
    return F.when(n > 1, F.zip_with(F.slice(words, 1, n - 1), F.slice(words, 2, n - 1), lambda a, b: F.concat(a, F.lit("_"), b))).otherwise(F.array().cast("array<string>"))


def char_shingles(text: Column, n: int = 5) -> Column:
    """The different runs of ``n`` characters of the lower-case text with white space as one space."""
    flat = F.regexp_replace(F.lower(text), r"\s+", " ")

    def of(chars: Column) -> Column:
        some = F.transform(F.slice(chars, 1, F.greatest(F.size(chars) - (n - 1), F.lit(0))), lambda c, i: F.concat(c, *(F.get(chars, i + k) for k in range(1, n))))
        return F.array_distinct(some)

    # characters as an array that is made once: substrings would be looked for from the text's beginning each time
    return F.element_at(F.transform(F.array(F.regexp_extract_all(flat, F.lit("(?s)."), F.lit(0))), of), 1)


def dedupe_tokens(text: Column) -> Column:
    """Words of two characters or more, pairs of them, and runs of five characters, as one array."""
    words = tokens(text, 2)
    return F.concat(words, bigrams(words), char_shingles(text))


def content_words(text: Column, stop: list[str], longer_than: int = 2) -> Column:
    """Tokens longer than ``longer_than`` that aren't stop words, with repeats."""
    skip = F.array(*map(F.lit, stop)) if stop else F.array().cast("array<string>")
    return F.filter(tokens(text, longer_than + 1), lambda w: ~F.array_contains(skip, w))


def mixed_tokens(text: Column) -> Column:
    """Different ASCII words of two letters or more and runs of two or more CJK ideographs."""
    return F.array_union(F.regexp_extract_all(F.lower(text), F.lit("[a-z][a-z0-9]+"), F.lit(0)), F.regexp_extract_all(text, F.lit("[一-龥]{2,}"), F.lit(0)))


def ellipsis(text: Column, longest: int = 200) -> Column:
    """The trimmed text, cut with three dots to ``longest`` characters if it is longer."""
    t = F.btrim(F.coalesce(text, F.lit("")))
    return F.when(F.length(t) > longest, F.concat(F.substring(t, 1, longest - 3), F.lit("..."))).otherwise(t)


def context(parts: Column, at: Column) -> Column:
    """Sentence ``at`` (from 0) of an array with those beside it, a space apart."""
    return F.array_join(F.slice(parts, F.greatest(at, F.lit(1)), F.when(at > 0, 3).otherwise(2)), " ")


def search_query(terms: list[str]) -> str:
    """A web search query: phrases of several words in quotes, all joined by OR; blanks and repeats left out."""
    seen = dict.fromkeys(" ".join(t.replace('"', " ").split()) for t in terms)
    return " OR ".join(f'"{t}"' if " " in t else t for t in seen if t)


def focus_phrases(description: str, connectors: tuple[str, ...] = ("and", "or", "with", "for")) -> list[str]:
    """A description's parts between marks and connecting words, each once, two characters or more."""
    parts = re.split(r"[,.;:!?\n]|\b(?:" + "|".join(connectors) + r")\b", description.lower())
    return list(dict.fromkeys(p for p in (" ".join(x.split()) for x in parts) if len(p) > 1))


def time_slices(since: int, until: int, days: int = 30, overlap: int = 7200) -> list[tuple[int, int]]:
    """(start, end) in seconds of slices that cover ``since`` to ``until``, each beginning ``overlap`` before the last ends.

    An overlap of a whole slice or more would never get on, and is an error.
    """
    step, overlap = 86_400 * max(1, days), max(0, overlap)
    if overlap >= step:
        raise ValueError("the overlap is as long as a slice")
    out, at = [], since
    while at < until:
        end = min(until, at + step)
        out.append((at, end))
        if end >= until:
            break
        at = end - overlap
    return out
