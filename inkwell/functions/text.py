"""Scalar text functions as Spark columns."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from inkwell import params


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is evaluated once however often ``body`` uses it.

    Projections are merged by copying expressions, and a copy inside a lambda would run for each element.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(text: Column) -> Column:
    """Without white space at either end, the ideographic space included."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def blank_to_null(text: Column) -> Column:
    return F.nullif(strip(text), F.lit(""))


def count_of(text: Column, word: Column) -> Column:
    """Occurrences of ``word`` in ``text`` that don't overlap, found from the left; 0 for an empty word."""
    gone = F.length(text) - F.length(F.replace(text, word, F.lit("")))
    return F.when(F.length(word) > 0, F.floor(gone / F.length(word))).otherwise(0).cast("long")


def contains_any(text: Column, words: Sequence[str]) -> Column:
    found = F.lit(False)
    for word in words:
        found = found | text.contains(word)
    return found


def present(text: Column, words: Sequence[str]) -> Column:
    """How many of ``words`` occur in ``text``."""
    return sum((text.contains(w).cast("int") for w in words), F.lit(0))


def total_of(text: Column, words: Sequence[str]) -> Column:
    return sum((count_of(text, F.lit(w)) for w in words), F.lit(0).cast("long"))


def replace_first(text: Column, word: str) -> Column:
    """``text`` without the first occurrence of ``word``."""
    at = F.instr(text, word)
    return F.when(at > 0, F.concat(F.substring(text, F.lit(1), at - 1), F.substring(text, at + len(word), F.length(text)))).otherwise(text)


def normalised(text: Column) -> Column:
    """Digits, ASCII letters and Han characters only."""
    return F.regexp_replace(text, "[^0-9A-Za-z一-鿿]", "")


def tokens(text: Column, stop_words: Sequence[str] = params.STOP_WORDS) -> Column:
    """Parts between separators of two characters or more that aren't stop words. White space separates, so none is left to strip."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), params.SEPARATORS), lambda t: (F.length(t) >= 2) & ~t.isin(*stop_words))


def terms(text: Column, stop_words: Sequence[str] = params.STOP_WORDS, stop_ngrams: Sequence[str] = params.STOP_NGRAMS) -> Column:
    """struct(shorts, bigrams, trigrams): tokens of 2 to 4 characters, and n-grams of longer ones.

    The long tokens are joined by newlines, which separate tokens and so are part of none, and one pass of a
    pattern that looks ahead from each character finds their n-grams.
    """

    def of(held: Column) -> Column:
        long_ones = F.array_join(F.filter(held, lambda t: F.length(t) > 4), "\n")

        def grams(n: int) -> Column:
            return F.filter(F.regexp_extract_all(long_ones, F.lit(rf"(?=([^\n]{{{n}}}))[^\n]"), F.lit(1)), lambda g: ~g.isin(*stop_ngrams))

        return F.struct(F.filter(held, lambda t: F.length(t) <= 4).alias("shorts"), grams(2).alias("bigrams"), grams(3).alias("trigrams"))

    return let(tokens(text, stop_words), of)


def significant_terms(text: Column) -> Column:
    return let(terms(text), lambda found: F.concat(found["shorts"], found["bigrams"], found["trigrams"]))


#: Kinds of terms and the parts of ``terms`` that hold them.
TERM_KINDS = {"s": "shorts", "b": "bigrams", "t": "trigrams"}


def typed_terms(text: Column, stop_words: Sequence[str] = params.STOP_WORDS, stop_ngrams: Sequence[str] = params.STOP_NGRAMS, kinds: str = "sbt") -> Column:
    """Distinct struct(kind, term) of the given ``kinds``; one array to explode."""

    def typed(found: Column, kind: str) -> Column:
        return F.transform(F.array_distinct(found[TERM_KINDS[kind]]), lambda t: F.struct(F.lit(kind).alias("kind"), t.alias("term")))

    return let(terms(text, stop_words, stop_ngrams), lambda found: F.concat(*[typed(found, k) for k in kinds]))


def hashed_terms(text: Column, stop_words: Sequence[str] = params.STOP_WORDS, stop_ngrams: Sequence[str] = params.STOP_NGRAMS, kinds: str = "sbt") -> Column:
    """``term_hash`` of the distinct terms of the given ``kinds``."""

    def hashed(found: Column, kind: str) -> Column:
        return F.transform(F.array_distinct(found[TERM_KINDS[kind]]), lambda t: term_hash(F.lit(kind), t))

    return let(terms(text, stop_words, stop_ngrams), lambda found: F.concat(*[hashed(found, k) for k in kinds]))


def term_hash(kind: Column, term: Column) -> Column:
    """64 bits of a kind and a term: a key that joins faster than strings. Two of a million terms share it in one of 10**7 tables."""
    return F.xxhash64(kind, term)


def lines_of(text: Column) -> Column:
    return F.split(text, "\n")


def first_number(text: Column, pattern: str = r"(\d+)") -> Column:
    """The first number that ``pattern``'s group matches; null without a match."""
    return F.nullif(F.regexp_extract(text, pattern, 1), F.lit("")).try_cast("long")


def typed_scalar(raw: Column) -> Column:
    """Frontmatter scalar as struct(kind, value): null, boolean, string (quoted or not), long or double."""
    text = strip(raw)
    quoted = F.length(text).between(2, 1 << 30) & (((F.left(text, F.lit(1)) == "'") & (F.right(text, F.lit(1)) == "'")) | ((F.left(text, F.lit(1)) == '"') & (F.right(text, F.lit(1)) == '"')))
    inner = F.substring(text, F.lit(2), F.length(text) - 2)
    kind = (
        F.when(text.isNull() | (text == "") | (F.lower(text) == "null"), "null")
        .when(F.lower(text).isin("true", "false"), "boolean")
        .when(quoted, "string")
        .when(text.rlike(r"^-?\d+$"), "long")
        .when(text.try_cast("double").isNotNull(), "double")
        .otherwise("string")
    )
    value = F.when(kind == "boolean", F.lower(text)).when(quoted, inner).when(kind != "null", text)
    return F.struct(kind.alias("kind"), value.alias("value"))
