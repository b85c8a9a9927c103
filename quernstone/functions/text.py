"""Text functions: Column -> Column, all of them inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Function words of the corpus languages, for the language filter.
FUNCTION_WORDS = {"en": ["the", "of", "and", "to", "in", "is", "that", "for"], "fr": ["le", "la", "de", "et", "les", "des", "un", "que"], "de": ["der", "die", "und", "das", "in", "den", "von", "ist"], "es": ["el", "la", "de", "que", "y", "en", "los", "las"]}


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def let(value: Column, body) -> Column:
    """body(value), with value evaluated once even where body uses it inside a lambda."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def tokens(text: Column | str, casing: str = "root") -> Column:
    """Runs of letters and digits, lower-cased; casing "tr" maps the dotted and dotless capital I first."""
    t = F.translate(_c(text), "İI", "iı") if casing == "tr" else _c(text)
    return F.regexp_extract_all(F.lower(t), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def collapse_runs(words: Column | str) -> Column:
    """One of each run of equal words."""
    return let(_c(words), lambda w: F.filter(w, lambda x, i: (i == 0) | (x != F.get(w, i - 1))))


def grams(words: Column | str, n: int) -> Column:
    """n-grams as strings; none of fewer than n words."""
    joined = lambda w: F.transform(F.sequence(F.lit(1), F.size(w) - (n - 1)), lambda i: F.array_join(F.slice(w, i, n), " "))
    return let(_c(words), lambda w: F.when(F.size(w) >= n, joined(w)).otherwise(F.array().cast("array<string>")))


def gram_hashes(words: Column | str, n: int) -> Column:
    """64-bit hashes of the n-grams; none of fewer than n words."""
    hashed = lambda w: F.transform(F.sequence(F.lit(1), F.size(w) - (n - 1)), lambda i: F.xxhash64(F.slice(w, i, F.lit(n))))
    return let(_c(words), lambda w: F.when(F.size(w) >= n, hashed(w)).otherwise(F.array().cast("array<bigint>")))


def squash(text: Column | str) -> Column:
    """Blank runs to one space, ends trimmed."""
    return F.trim(F.regexp_replace(_c(text), r"[ \t\n\r\f\x0B]+", " "))


def mask_pii(text: Column | str) -> Column:
    """E-mail, URL, IBAN, phone numbers and handles by placeholders; the order matters, as later patterns would match parts of earlier ones."""
    t = F.regexp_replace(_c(text), r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "<EMAIL>")
    t = F.regexp_replace(t, r"https?://[^ \n]+", "<URL>")
    t = F.regexp_replace(t, r"[A-Z]{2}[0-9]{2}( ?[A-Z0-9]{4}){3,7}", "<IBAN>")
    t = F.regexp_replace(t, r"\+[0-9][0-9 ().-]{6,}[0-9]", "<PHONE>")
    return F.regexp_replace(t, r"@[A-Za-z0-9_]{3,}", "<HANDLE>")


def pii_kinds(text: Column | str) -> Column:
    """Names of the kinds found, in a fixed order, comma-joined."""
    t = _c(text)
    runs = F.filter(F.regexp_extract_all(t, F.lit(r"[0-9]+"), F.lit(0)), lambda r: F.length(r).between(13, 19))
    doubled = lambda r: F.transform(F.filter(F.split(F.reverse(r), ""), lambda d: d != ""), lambda d, i: d.cast("int") * (F.lit(1) + i % 2))
    luhn = lambda r: F.aggregate(doubled(r), F.lit(0), lambda a, x: a + F.when(x > 9, x - 9).otherwise(x)) % 10 == 0
    found = [
        F.when(t.rlike(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\.[A-Za-z]"), "email"),
        F.when(t.rlike(r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+"), "ip"),
        F.when(t.rlike(r"\+[0-9][0-9 ().-]{6,}[0-9]"), "phone"),
        F.when(F.exists(runs, luhn), "card"),
    ]
    return F.array_join(F.array_compact(F.array(*found)), ",")


def hygiene(text: Column | str) -> Column:
    """Names of the flaws of a text, in a fixed order, comma-joined."""
    t = _c(text)
    rules = {"replacement": "�", "control": r"[\x00-\x08\x0E-\x1F]", "entity": r"&(amp|lt|gt|quot|#[0-9]+);", "escaped": r"\\[nrt]", "template": r"\{\{|\}\}", "invisible": "[​‎‏﻿]"}
    return F.array_join(F.array_compact(F.array(*[F.when(t.rlike(r), name) for name, r in rules.items()])), ",")


def language_vote(words: Column | str, lang: str) -> Column:
    """True if the words hold at least two function words of the language and no other language has more."""
    w = _c(words)
    count = lambda name: F.size(F.filter(w, lambda x: x.isin(FUNCTION_WORDS[name])))
    others = F.greatest(*[count(o) for o in FUNCTION_WORDS if o != lang])
    return (count(lang) >= 2) & (count(lang) >= others)


def sentences(text: Column | str) -> Column:
    """Sentences: cut after . ! ? before white space and a capital letter, but not after one-letter abbreviations or ordinals."""
    return F.filter(F.split(_c(text), r"(?<=[.!?])(?<!\b\p{L}\.)(?<!\b\p{N}{1,2}\.)\s+(?=\p{Lu})"), lambda s: s != "")


def suffix_for(word: Column | str, back: str, front: str) -> Column:
    """Vowel harmony: the suffix `back` after a last vowel of a, o, u or dotless i, else `front`."""
    last = F.regexp_extract(F.lower(_c(word)), "([aeiouıöü])[^aeiouıöü]*$", 1)
    return F.concat(_c(word), F.when(last.isin("a", "o", "u", "ı"), back).otherwise(front))
