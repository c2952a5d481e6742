"""String expressions, Column to Column.  All of them stay in whole-stage code or Catalyst's built-in functions."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

_ACCENTED = "áàâäãåāéèêëēíìîïīóòôöõøōúùûüūýÿñçšžÁÀÂÄÃÅĀÉÈÊËĒÍÌÎÏĪÓÒÔÖÕØŌÚÙÛÜŪÝŸÑÇŠŽ"
_PLAIN = "aaaaaaaeeeeeiiiiiooooooouuuuuyyncszAAAAAAAEEEEEIIIIIOOOOOOOUUUUUYYNCSZ"


def blank_to_null(c: Column) -> Column:
    """Trimmed text, or null where nothing is left."""
    return F.nullif(F.trim(c.cast("string")), F.lit(""))


def squeeze(c: Column) -> Column:
    """Runs of white space as one space, trimmed."""
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def norm_text(c: Column) -> Column:
    return F.lower(squeeze(c))


def norm_title(c: Column) -> Column:
    """The key by which stories are told apart: letters, digits and underscores, lower case."""
    return F.lower(F.trim(F.regexp_replace(c, r"[^\p{L}\p{N}_]+", " ")))


def match_text(c: Column) -> Column:
    """Lower-case ASCII words only, for loose comparison."""
    return F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))


def slug(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def trim_words(c: Column, n: int) -> Column:
    """The first n words; texts that are short enough stay as they are."""
    words = F.split(F.trim(c), r"\s+")
    return F.when(F.size(words) > n, F.array_join(F.slice(words, 1, n), " ")).otherwise(c)


def sentences(c: Column) -> Column:
    """Array of sentences: a break is white space after a full stop, question or exclamation mark."""
    return F.filter(F.split(c, r"(?<=[?!.])\s+"), lambda s: F.length(F.trim(s)) > 0)


def first_sentences(c: Column, n: int) -> Column:
    return F.array_join(F.slice(sentences(c), 1, n), " ")


def sentence_with(c: Column, needle: Column) -> Column:
    """First sentence or line that holds the needle, without case."""
    parts = F.split(c, r"(?<=[?!.])\s+|\n+")
    return F.try_element_at(F.filter(parts, lambda s: F.contains(F.lower(s), F.lower(needle))), F.lit(1))


def clause_after(sentence: Column, needle: Column) -> Column:
    """What follows the needle in a sentence, up to the sentence's end."""
    at = F.instr(F.lower(sentence), F.lower(needle))
    rest = F.substring(sentence, at + F.length(needle), F.length(sentence))
    return F.when(at > 0, F.trim(F.regexp_replace(rest, "[.!?].*$", "")))


def snippet(c: Column, at: Column, radius: int = 80) -> Column:
    """Text around a 1-based position."""
    begin = F.greatest(F.lit(1), at - radius)
    return F.substring(c, begin, at + radius - begin)


def byte_snippet(c: Column, most: int) -> Column:
    """At most so many bytes of UTF-8, never cutting a character."""
    sizes = F.sequence(F.least(F.lit(most), F.length(c)), F.lit(0), F.lit(-1))
    fits = F.filter(sizes, lambda n: F.octet_length(F.substring(c, F.lit(1), n)) <= most)
    return F.when(F.octet_length(c) <= most, c).otherwise(F.substring(c, F.lit(1), F.try_element_at(fits, F.lit(1))))


def ascii_only(c: Column) -> Column:
    return F.regexp_replace(c, r"[^\x00-\x7F]", "?")


def strip_accents(c: Column) -> Column:
    return F.translate(c, _ACCENTED, _PLAIN)


def name_tokens(c: Column) -> Column:
    """Tokens by which person names are compared: no accents, letters only, lower case."""
    plain = F.regexp_replace(F.lower(strip_accents(c)), "[-'’]", " ")
    return F.filter(F.split(F.trim(F.regexp_replace(plain, "[^a-z ]+", "")), " +"), lambda t: t != "")


def canonical_name(c: Column) -> Column:
    """All tokens; null for fewer than two."""
    t = name_tokens(c)
    return F.when(F.size(t) >= 2, F.array_join(t, " "))


def first_last_name(c: Column) -> Column:
    """First and last token; null for fewer than two."""
    t = F.filter(F.split(F.trim(F.lower(c)), r"\s+"), lambda x: x != "")
    return F.when(F.size(t) >= 2, F.concat_ws(" ", F.element_at(t, 1), F.element_at(t, -1)))


ROLE_WORDS = (
    "agent attorney chief commissioner deputy detainee director family general governor inmate inspector lawyer man mayor "
    "migrant officer police president representative resident secretary sheriff spokesperson victim woman"
).split()


def is_person_name(c: Column, roles: Sequence[str] = ROLE_WORDS) -> Column:
    """Two to five tokens, none a role, not all of them initials."""
    t = name_tokens(c)
    ok = F.size(t).between(2, 5) & ~F.arrays_overlap(t, F.array(*[F.lit(r) for r in roles])) & F.exists(t, lambda x: F.length(x) > 2)
    return F.coalesce(ok, F.lit(False))


def display_name(c: Column) -> Column:
    """`LAST, First` as `First Last`, capitalised."""
    parts = F.split(c, ",")
    turned = F.when(F.size(parts) > 1, F.concat_ws(" ", F.trim(F.element_at(parts, 2)), F.trim(F.element_at(parts, 1)))).otherwise(c)
    return F.initcap(squeeze(turned))


def alternation(terms: Iterable[str]) -> str:
    """Regular expression for any of the terms as whole words, without case; * stands for anything."""
    import re

    parts = [re.escape(t).replace(r"\*", ".*") for t in sorted(set(terms), key=lambda t: (-len(t), t))]
    return r"(?i)\b(?:" + "|".join(parts) + r")\b"


def contains_any(c: Column, terms: Iterable[str]) -> Column:
    """Any term as a substring, without case."""
    low = F.lower(c)
    out = F.lit(False)
    for t in sorted(set(terms)):
        out = out | F.contains(low, F.lit(t.lower()))
    return out


def hits(c: Column, terms: Iterable[str]) -> Column:
    """The terms found as substrings, without case, as an array in order."""
    low = F.lower(c)
    return F.filter(F.array(*[F.lit(t) for t in sorted({t.lower() for t in terms})]), lambda k: F.contains(low, k))


def word_hits(c: Column, terms: Iterable[str]) -> Column:
    """Terms found: of several words or more than four letters as substrings, else as whole words."""
    low = F.lower(c)
    tokens = F.split(F.regexp_replace(low, r"[^\p{L}\p{N}]+", " "), " ")
    return F.filter(
        F.array(*[F.lit(t) for t in sorted({t.lower() for t in terms})]),
        lambda k: F.when((F.length(k) > 4) | F.contains(k, F.lit(" ")), F.contains(low, k)).otherwise(F.array_contains(tokens, k)),
    )


def ladder(c: Column, rules: Sequence[tuple[str, str]], default: str | None = None) -> Column:
    """Label of the first pattern that matches."""
    out = F.lit(default)
    for label, pattern in reversed(rules):
        out = F.when(F.coalesce(c.rlike(pattern), F.lit(False)), label).otherwise(out)
    return out


def labels(c: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """All labels whose pattern matches, in order, from one projection."""
    return F.array_compact(F.array(*[F.when(c.rlike(p), label) for label, p in rules]))


def mention_counts(c: Column, term: Column) -> Column:
    return F.regexp_count(c, F.concat(F.lit(r"(?i)\b\Q"), term, F.lit(r"\E\b")))


def drop_repeat_half(c: Column) -> Column:
    """A text that is one string written twice, with or without a space, as that string."""
    return F.regexp_replace(c, r"^(.{3,}?)\s*\1$", "$1")


def drop_repeat_phrase(c: Column) -> Column:
    """A phrase of three words or more that comes again at once is cut; no repeated group, of which the matcher stacks every turn.

    The pattern tries every length from every word, so that long texts are matched only where some words stand again at
    a distance that a phrase next to its copy needs: one look for each multiple of each length.
    """
    cut = F.regexp_replace(c, r"(?i)\b(\w++\s++\w++\s++[\w\s]*\w)\s+\1\b", "$1")
    words = F.split(F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), r"\W+")
    with_ = lambda x, f: F.element_at(F.transform(F.array(x), f), 1)  # noqa: E731  x is computed once

    def again(w: Column, few: int, least: int, most: Column) -> Column:
        """Whether `few` words stand again n on, least <= n <= most, at any multiple of n - few + 1, of which a phrase of n words holds one."""
        last = F.size(w) - few
        at = lambda n: F.sequence(F.lit(0), F.floor((last - n) / (n - few + 1)).cast("int"))
        same = lambda i, n: F.forall(F.array(*[F.lit(j) for j in range(few)]), lambda j: F.get(w, i + j) == F.get(w, i + n + j))
        return F.when(most >= least, F.exists(F.sequence(F.lit(least), F.greatest(most, F.lit(least))), lambda n: F.exists(at(n), lambda k: same(k * (n - few + 1), n)))).otherwise(False)

    half = lambda w: F.floor(F.size(w) / 2).cast("int")
    may = with_(words, lambda w: again(w, 3, 3, F.least(F.lit(7), half(w))) | again(w, 8, 8, half(w)))
    return F.when((F.length(c) < 400) | may, cut).otherwise(c)
