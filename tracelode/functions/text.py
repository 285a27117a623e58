"""Column expressions over text: names, slugs, tokens, similarity, scores and escapes."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# Letters with marks and the letters that they fold to.
MARKED = "ÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝàáâãäåçèéêëìíîïñòóôõöùúûüýÿ"
PLAIN = "AAAAAACEEEEIIIINOOOOOUUUUYaaaaaaceeeeiiiinooooouuuuyy"
# Words that scorers leave out; resolution leaves out more.
STOP_WORDS = ("DE", "DO", "DA", "DOS", "DAS", "THE", "AND")
RESOLUTION_STOP_WORDS = (*STOP_WORDS, "PARA", "COM", "SEM")


def normalize_name(c: Column) -> Column:
    return F.upper(F.trim(F.coalesce(c.cast("string"), F.lit(""))))


def fold_accents(c: Column) -> Column:
    return F.translate(c, MARKED, PLAIN)


def slugify(c: Column, fallback: str = "query") -> Column:
    """Lower case without marks, runs of anything else as one hyphen."""
    slug = F.regexp_replace(F.regexp_replace(F.lower(fold_accents(c)), "[^a-z0-9]+", "-"), "^-|-$", "")
    return F.when(F.length(F.coalesce(slug, F.lit(""))) > 0, slug).otherwise(F.lit(fallback))


def normalize_text(c: Column) -> Column:
    """Upper case without marks, anything but letters and digits as one blank."""
    return F.trim(F.regexp_replace(F.upper(fold_accents(F.coalesce(c, F.lit("")))), "[^A-Z0-9]+", " "))


def tokens(c: Column, least: int = 3, stop: tuple[str, ...] = STOP_WORDS) -> Column:
    """Distinct words of normalised text with at least so many characters."""
    return F.array_distinct(F.filter(F.split(normalize_text(c), " "), lambda t: (F.length(t) >= least) & ~t.isin(*stop)))


def camel_tokens(c: Column, least: int = 3) -> Column:
    """Distinct lower-case words of a name in camel case or with separators."""
    spaced = F.regexp_replace(F.coalesce(c, F.lit("")), "([a-z0-9])([A-Z])", "$1 $2")
    return F.array_distinct(F.filter(F.split(F.lower(spaced), "[^a-z0-9]+"), lambda t: F.length(t) >= least))


def similarity(a: Column, b: Column) -> Column:
    """1 less the edit distance over the longer length; 0 if both are empty."""
    longer = F.greatest(F.length(a), F.length(b))
    return F.when(longer > 0, 1 - F.levenshtein(a, b) / longer).otherwise(F.lit(0.0))


@dataclass(frozen=True)
class Scorer:
    """Constants of a fuzzy score; two variants are in use and differ on purpose. every_token: words count also where one text contains the other."""

    equal: int
    contains: int
    per_token: int
    all_tokens: int
    some_tokens: int
    least_similarity: float
    least_length_ratio: float = 0.0
    stop: tuple[str, ...] = STOP_WORDS
    least_letters: int = 1
    every_token: bool = False


RESOLUTION = Scorer(180, 120, 26, 54, 14, 0.78, stop=RESOLUTION_STOP_WORDS, least_letters=2, every_token=True)
EXECUTIVE = Scorer(160, 115, 24, 48, 12, 0.72, 0.5)


def token_match(a: Column, b: Column, s: Scorer) -> Column:
    """Whether words of letters are alike. The edit distance is at least the difference of the lengths, so it is taken only where that leaves room."""
    ratio = F.least(F.length(a), F.length(b)) / F.greatest(F.length(a), F.length(b))
    return (a == b) | F.contains(a, b) | F.contains(b, a) | ((ratio >= max(s.least_length_ratio, s.least_similarity - 1e-6)) & (similarity(a, b) >= s.least_similarity))


def given_as(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value evaluated once; functions of arrays don't share what stands in them twice."""
    return F.transform(F.array(value), use)[0]


def score_value(query: Column, value: Column, s: Scorer = RESOLUTION) -> Column:
    """Score of one value: equal, one contains the other (letters and digits alone), or query tokens that some value token matches.

    An empty value scores 0, although every text contains the empty text; so does a query without a word of three letters.
    """
    return score_text(query, F.array(value), s, True)


def score_text(query: Column, values: Column, s: Scorer = RESOLUTION, nulls: bool = False) -> Column:
    """Best score over an array of values; nulls: whether a null counts as an empty text."""
    words = lambda c, least: F.filter(F.split(c, " "), lambda t: (F.length(t) >= least) & ~t.isin(*s.stop))
    bare = lambda c: F.replace(c, F.lit(" "), F.lit(""))

    def score(q: Column, asked: Column, text: Column) -> Column:
        by_token = lambda hits: F.when(hits > 0, s.per_token * hits + F.when(hits == F.size(asked), s.all_tokens).otherwise(s.some_tokens)).otherwise(0)
        count = lambda given: F.size(F.filter(asked, lambda a: F.exists(given, lambda b: token_match(a, b, s))))
        by_words = lambda use: given_as(words(text, s.least_letters), lambda given: given_as(count(given), use))
        of = lambda v: (
            F.when((F.size(asked) == 0) | (F.length(v) == 0), 0)
            .when(q == v, s.equal)
            .when(F.contains(v, q) | F.contains(q, v), by_words(lambda h: F.greatest(F.lit(s.contains), by_token(h))) if s.every_token else F.lit(s.contains))
            .otherwise(by_words(by_token))
        )
        return given_as(bare(text), of)

    texts = F.transform(values if nulls else F.filter(values, lambda v: v.isNotNull()), normalize_text)
    scores = given_as(normalize_text(query), lambda n: given_as(bare(n), lambda q: given_as(words(n, 3), lambda asked: F.array_max(F.transform(texts, lambda t: score(q, asked, t))))))
    return F.coalesce(scores, F.lit(0)).cast("int")


def glob_regex(glob: str) -> str:
    """A glob (**, *, ?) as an unanchored, case-insensitive pattern."""
    out, i = "(?i)", 0
    while i < len(glob):
        if glob.startswith("**", i):
            out, i = out + ".*", i + 2
            continue
        ch = glob[i]
        out += "[^/]*" if ch == "*" else "[^/]" if ch == "?" else "\\" + ch if ch in "\\.+^${}()|[]" else ch
        i += 1
    return out


def escaped(c: Column, pairs: tuple[tuple[str, str], ...]) -> Column:
    for a, b in pairs:
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def xml_escape(c: Column) -> Column:
    return escaped(F.coalesce(c, F.lit("")), (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")))


def dot_escape(c: Column) -> Column:
    return F.concat(F.lit('"'), escaped(F.coalesce(c, F.lit("")), (("\\", "\\\\"), ('"', '\\"'))), F.lit('"'))


def csv_quote(c: Column) -> Column:
    return F.concat(F.lit('"'), F.replace(F.coalesce(c.cast("string"), F.lit("")), F.lit('"'), F.lit('""')), F.lit('"'))


def half_up(c: Column, digits: int = 0) -> Column:
    """Rounds halves towards positive infinity, also below zero."""
    return F.floor(c * 10**digits + 0.5) / 10**digits


def percent(a: Column, b: Column) -> Column:
    """a of b in whole percent; 0 of nothing."""
    return F.when(b > 0, F.floor(100.0 * a / b + 0.5)).otherwise(F.lit(0)).cast("bigint")


def duration_ms(c: Column) -> Column:
    """Milliseconds of 0, 500ms, 30s or 2m; null if it is none of these."""
    n, unit = F.try_to_number(F.regexp_extract(c, "^([0-9]+)", 1), F.lit("999999999")).cast("bigint"), F.lower(F.regexp_extract(c, "^[0-9]+ *(ms|s|m|)$", 1))
    return F.when(~c.rlike("(?i)^[0-9]+ *(ms|s|m)?$"), None).when(unit == "m", n * 60000).when(unit == "s", n * 1000).otherwise(n)
