"""Column functions over text: relevance, recency, normalisation, fingerprints, slugs."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: words that a query's terms leave out.
STOPWORDS = ("the", "a", "an", "and", "or", "of", "to", "in", "for", "on", "is", "it")
SUFFIXES = ("", "s", "es", "ed", "ing")


def query_terms(query: str) -> list[str]:
    """Distinct lower-case terms of two characters or more, without stopwords, in order."""
    found = re.split(r"[^a-z0-9_.-]+", query.strip().lower())
    return list(dict.fromkeys(t for t in found if len(t) > 1 and t not in STOPWORDS))


def _edge(char: str, behind: bool) -> str:
    """An ASCII word boundary beside char: Java's own also counts letters beyond ASCII."""
    if re.match(r"[A-Za-z0-9_]", char):
        return "(?<![A-Za-z0-9_])" if behind else "(?![A-Za-z0-9_])"
    return "(?<=[A-Za-z0-9_])" if behind else "(?=[A-Za-z0-9_])"


def term_pattern(term: str) -> str:
    """A term between word boundaries, with an optional ending; a final e may be missing before one."""
    stem = re.escape(term[:-1]) + "e?" if term.endswith("e") else re.escape(term)
    last = "(?![A-Za-z0-9_])" if re.match(r"[A-Za-z0-9_]", term[-1]) else rf"(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"
    return f"{_edge(term[0], True)}{stem}(?:s|es|ed|ing)?{last}"


def damping(n: Column) -> Column:
    """1 up to 500 characters, then 1 / (1 + log10(n / 500)), 0.6 at least."""
    return F.when(n <= 500, 1.0).otherwise(F.greatest(F.lit(0.6), 1 / (1 + F.log10(n / 500))))


def relevance_of(matched: Column, density: Column, phrase: Column, n_terms: Column | int, chars: Column) -> Column:
    """0.7 of the terms' coverage, 0.15 of their density, 0.15 for the phrase, 1 at most, damped by length."""
    n = F.lit(n_terms) if isinstance(n_terms, int) else n_terms
    return F.least(F.lit(1.0), matched / n * 0.7 + density / n * 0.15 + F.when(phrase, 0.15).otherwise(0.0)) * damping(chars)


def relevance(content: Column, query: str) -> Column:
    """Word-bounded relevance of a content to one query, in 0..1; null or term-less counts as 0."""
    terms = query_terms(query)
    if not terms:
        return F.lit(0.0)
    lower = F.lower(content)
    counts = [F.coalesce(F.regexp_count(lower, F.lit(term_pattern(t))), F.lit(0)) for t in terms]
    matched = sum((F.when(c > 0, 1).otherwise(0) for c in counts), F.lit(0))
    density = sum((F.least(c, F.lit(5)) / 5 for c in counts), F.lit(0.0))
    phrase = query.strip().lower()
    bonus = lower.rlike(_edge(phrase[0], True) + re.escape(phrase) + _edge(phrase[-1], False)) if len(phrase) > 3 else F.lit(False)
    return F.coalesce(relevance_of(matched, density, bonus, len(terms), F.length(content)), F.lit(0.0))


def recency(ts: Column, as_of: Column) -> Column:
    """Half-life of 90 days; unknown 0.5, future 1."""
    age = (F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(ts.cast("timestamp"))) / 86_400_000_000
    return F.when(ts.isNull(), 0.5).when(age < 0, 1.0).otherwise(F.pow(F.lit(0.5), age / 90))


def composite(rel: Column, rec: Column, confidence: Column) -> Column:
    """0.70 relevance, 0.25 recency, 0.05 confidence, to 4 places."""
    return F.round(0.70 * rel + 0.25 * rec + 0.05 * F.coalesce(confidence, F.lit(0.0)), 4)


def normalise(content: Column) -> Column:
    """Line feeds only; runs of horizontal space inside a line squeezed, at its end dropped, at its start kept; no blank lines around."""
    h = " \\t\\f\\x0B\\x{A0}"
    s = F.regexp_replace(content, r"\r\n?", "\n")
    s = F.regexp_replace(s, f"(?md)[{h}]+$", "")
    s = F.regexp_replace(s, f"(?<=[^\\n{h}])[{h}]+", " ")
    return F.regexp_replace(s, r"\A\n+|\n+\z", "")


def fingerprint(content: Column, user: Column, content_type: Column, subject: Column) -> Column:
    """SHA-256 of the JSON array of normalised content, user, type and subject (or '')."""
    return F.sha2(F.to_json(F.array(normalise(content), user, content_type, F.coalesce(subject, F.lit("")))), 256)


def content_hash(content: Column, head: int | None = None) -> Column:
    """SHA-256 of the trimmed lower-case content, of its first head characters if given."""
    s = F.lower(F.regexp_replace(content, r"\A[\s\x{A0}]+|[\s\x{A0}]+\z", ""))
    return F.sha2(F.substring(s, 1, head) if head else s, 256)


def pair_key(new: Column, candidate: Column) -> Column:
    """SHA-256 of two contents with a bar between."""
    return F.sha2(F.concat(new, F.lit("|"), candidate), 256)


def cache_key(*parts: Column) -> Column:
    """The first 32 hex digits of the SHA-256 of the parts with a zero character between."""
    return F.substring(F.sha2(F.concat_ws("\x00", *parts), 256), 1, 32)


def legacy_relevance(content: Column, query: str) -> Column:
    """Share of the query's words that the content holds anywhere, each worth half as much again if it holds the whole query."""
    lower, terms = F.lower(content), query.lower().split()
    bonus = F.lit(1.0) + F.when(lower.contains(query.lower()), 0.5).otherwise(0.0)
    return sum((F.when(lower.contains(t), bonus).otherwise(0.0) for t in terms), F.lit(0.0)) / len(terms) if terms else F.lit(0.0)


def length_ratio(a: Column, b: Column) -> Column:
    """The shorter's share of the longer, after white space is squeezed; 1 for two empty texts."""
    return share_of_longer(squeezed_length(a), squeezed_length(b))


def squeezed_length(text: Column) -> Column:
    return F.length(F.trim(F.regexp_replace(F.lower(text), r"\s+", " ")))


def share_of_longer(x: Column, y: Column) -> Column:
    """The smaller's share of the larger of two lengths; 1 for two of 0."""
    return F.when(F.greatest(x, y) == 0, 1.0).otherwise(F.least(x, y) / F.greatest(x, y))


def event_time(epoch: Column, *texts: Column) -> Column:
    """The first that is given and valid: seconds since 1970, or an ISO text."""
    return F.coalesce(F.timestamp_seconds(F.when(epoch > 0, epoch)), *[F.try_to_timestamp(t) for t in texts])


def excerpt(content: Column, n: int = 300) -> Column:
    """The first n characters, with an ellipsis if there are more."""
    return F.concat(F.substring(content, 1, n), F.when(F.length(content) > n, "…").otherwise(""))


def any_word(content: Column, words: Iterable[str]) -> Column:
    """Whether the lower-case content holds any of the words as a substring."""
    out = F.lit(False)
    for w in words:
        out = out | F.lower(content).contains(w.lower())
    return out


def keywords(query: str) -> list[str]:
    """The query's words of two characters or more."""
    return [w for w in query.split() if len(w) >= 2]


def word_count(content: Column) -> Column:
    return F.size(F.filter(F.split(content, r"\s+"), lambda w: w != ""))


def slug(name: Column, lower: bool = False) -> Column:
    """Runs of other than letters, digits, dot, underscore and hyphen become one hyphen, none at the ends."""
    s = F.lower(name) if lower else name
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(s, "[^A-Za-z0-9._-]+", "-"), "-+", "-"), "^-|-$", "")


def person_name(name: Column) -> Column:
    """Lower case, other than ASCII letters and digits as single spaces, trimmed."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(name), "[^a-z0-9 ]+", " "), " +", " ")).alias("name")


def topic_head(content: Column) -> Column:
    """Three to five leading words of the squeezed lower-case content (60 characters at most), else its first 40 characters."""
    s = F.lower(F.trim(F.regexp_replace(content, r"\s+", " ")))
    head = F.regexp_extract(s, r"^([\w'-]+(?:\s[\w'-]+){2,4})", 1)
    return F.when(head != "", F.substring(head, 1, 60)).otherwise(F.substring(s, 1, 40))
