"""Predicates on the statement around a value."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparklode.functions.shapes import any_of, has_substring

#: Longest statement that is its own window.
WINDOW = 512


def quoted(value: Column) -> Column:
    """A regular expression that matches the value as it is."""
    return F.concat(F.lit(r"\Q"), F.replace(value, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))


def external(stmt: Column, value: Column) -> Column:
    """The statement without the value, save where the value stands as a key."""
    return F.regexp_replace(stmt, F.concat(quoted(value), F.lit("(?![\"'\t ]*:)")), F.lit(""))


def _segments(text: Column) -> Column:
    """Lower-case words of identifiers: camel case, snake case and the like come apart."""
    spaced = F.regexp_replace(F.regexp_replace(text, r"[_\-.]", " "), "([a-z])([A-Z])", "$1 $2")
    return F.split(F.lower(F.regexp_replace(spaced, "[:\"']", " ")), r"\s+")


def has_word(text: Column, words: Iterable[str]) -> Column:
    """A word is in the text, or one of its words; the latter is also the former."""
    return has_substring(text, tuple(w.lower() for w in words))


def has_segment(text: Column, word: str, unlike: Iterable[str] = ()) -> Column:
    """The word is a whole token or a camel-case segment, in a token that has none of the look-alikes."""
    tokens = F.regexp_extract_all(text, F.lit("([A-Za-z0-9$]+)"), F.lit(1))
    if unlike:
        tokens = F.filter(tokens, lambda t: ~F.lower(t).rlike(any_of(unlike)))
    # most texts fail the first test
    return F.lower(text).contains(word) & F.exists(tokens, lambda t: F.array_contains(F.split(F.lower(F.regexp_replace(t, "([a-z0-9])([A-Z])", "$1 $2")), " "), word))


def has_pair(text: Column, word: str, first: str, second: str) -> Column:
    """The word is one of the text's words, or its two halves follow each other there."""
    joined = F.concat(F.lit(" "), F.array_join(_segments(text), " "), F.lit(" "))
    return F.lower(text).contains(first) & F.lower(text).contains(second) & (joined.contains(f" {word} ") | joined.contains(f" {first} {second} "))


def bound_keys(stmt: Column, value: Column) -> Column:
    """Keys that stand directly left of the value where it is a literal of its own: key: value, key = value, key: a || value."""
    before = r"(?:^|[^\w$])([A-Za-z_$][\w$]*)\s*[\"']?\s*[:=]\s*(?:[A-Za-z0-9_$.\[\]()?!]*\s*\|\|\s*)?[\"']?\s*(?<![\w$])"
    return F.regexp_extract_all(stmt, F.concat(F.lit(before), quoted(value), F.lit(r"(?![\w$])")), F.lit(1))


def window_of(stmt: Column, first: Column) -> Column:
    """The statement if it is short, else the word that holds the value with one word on each side, else its beginning."""
    words = F.split(stmt, r"\s+")
    at = F.array_position(F.transform(words, lambda w: w.contains(first)), F.lit(True)).cast("int")
    near = F.array_join(F.slice(words, F.greatest(at - 1, F.lit(1)), F.when(at > 1, 3).otherwise(2)), " ")
    return F.when(F.length(stmt) <= WINDOW, stmt).when(at > 0, near).otherwise(F.substring(stmt, 1, WINDOW))
