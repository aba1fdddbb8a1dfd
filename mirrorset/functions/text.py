"""Text cleaning as native column expressions (no Python in the hot path)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Every character Python's str.strip() removes (none lies above U+3000).
WHITESPACE = "".join(chr(code) for code in range(0x3001) if chr(code).isspace())
QUOTES = "\"'"

# Cell texts a CSV reader takes as missing.
NA_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
]
# Labels (any case) that count as missing.
NULL_LABELS = ["none", "null", "", "nan"]

# A reply holding both phrases talks about itself.
META_PHRASES = ("given the constraints", "the assistant")

# Character classes that agree with Python's Unicode-aware \s and \d.
WS_CLASS = r"[\s\x1C-\x1F]"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and hand it to ``body``, which may use it often.

    A column used in several places is a copied expression, and array functions
    evaluate each copy; a lambda variable is evaluated once.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(col: Column) -> Column:
    """Trim every Unicode white space at both ends (``trim`` drops spaces only)."""
    return F.trim(col, F.lit(WHITESPACE))


def strip_quotes(col: Column) -> Column:
    return F.trim(col, F.lit(QUOTES))


def squeeze(col: Column) -> Column:
    """Each run of white space becomes one space."""
    return F.regexp_replace(col, f"(?U){WS_CLASS}+", " ")


def canonical_null(col: Column) -> Column:
    """Missing-value tokens become null; other texts stay as they are."""
    return F.when(~col.isin(NA_TOKENS), col)


def canonical_label(col: Column) -> Column:
    """As :func:`canonical_null`, and null-like labels of any case become null."""
    return F.when(~col.isin(NA_TOKENS) & ~F.lower(col).isin(NULL_LABELS), col)


def slug(col: Column) -> Column:
    """Path-safe run key: ``: / . -`` become ``_``."""
    return F.regexp_replace(col, r"[:/.\-]", "_")


def clean_response(col: Column) -> Column:
    """Strip a reply and drop the code fence around it.

    A reply that opens with a fence loses its first and last line when it has
    more than two, then all fences left.
    """

    def unfence(text: Column) -> Column:
        def inner(lines: Column) -> Column:
            kept = F.array_join(F.slice(lines, F.lit(2), F.size(lines) - 2), "\n")
            return F.when(F.size(lines) > 2, kept).otherwise(text)

        body = let(F.split(text, "\n", -1), inner)
        return strip(F.replace(body, F.lit("```"), F.lit("")))

    return let(strip(col), lambda text: F.when(text.startswith("```"), unfence(text)).otherwise(text))


def clean_generated(col: Column) -> Column:
    """Strip white space, then quote characters, at both ends."""
    return strip_quotes(strip(col))


def normalize_text(col: Column) -> Column:
    """Loose form of a sentence, compared when exact equality fails."""
    text = F.regexp_replace(strip(col), f"(?U)^[-•*\\d.]+{WS_CLASS}*", "")
    text = strip(F.replace(F.replace(text, F.lit("..."), F.lit("")), F.lit("…"), F.lit("")))
    text = strip(F.lower(text))
    text = F.translate(text, QUOTES, "")
    return F.rtrim(squeeze(text), F.lit(". "))


def heuristic_ok(col: Column, phrases: tuple[str, str] = META_PHRASES) -> Column:
    """False for null and for texts that hold both meta phrases (any case)."""
    lowered = F.lower(col)
    meta = lowered.contains(phrases[0]) & lowered.contains(phrases[1])
    return F.coalesce(~meta, F.lit(False))


# A sign of a word.
WORD = r"(?U)[^\s\x1C-\x1F]"


def word_count(col: Column) -> Column:
    return F.coalesce(F.regexp_count(col, F.lit(f"{WORD}+")), F.lit(0))


# Fixed value: estimated tokens of a word.
TOKENS_A_WORD = 1.3


def token_estimate(col: Column) -> Column:
    """About 1.3 tokens a word, rounded down."""
    return F.floor(word_count(col) * F.lit(TOKENS_A_WORD))
