"""Free-text replies to arrays, each parser one native column expression.

A parsed pair is ``STRUCT<sentence STRING, phrases ARRAY<STRING>>``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import WS_CLASS, let, squeeze, strip, strip_quotes

PAIRS = "array<struct<sentence:string,phrases:array<string>>>"

# Lead-ins dropped from a candidate list; the first hit in this order wins.
LEAD_INS = [
    "here are", "the alternatives are", "alternative phrases:", "alternatives:",
    "possible replacements:", "suggestions:", "here are the alternatives:",
    "the alternative phrases are:", "replacements:",
]


def split_phrases(col: Column, separators: str = "[,;]") -> Column:
    parts = F.transform(F.split(col, separators, -1), strip)
    return F.filter(parts, lambda p: p != "")


def _pair(sentence: Column, phrases: Column) -> Column:
    return F.struct(sentence.alias("sentence"), phrases.alias("phrases"))


def _complete(pairs: Column) -> Column:
    """Pairs that have both a sentence and a phrase."""
    return F.filter(
        pairs,
        lambda p: F.coalesce((p["sentence"] != "") & (F.size(p["phrases"]) > 0), F.lit(False)),
    )


def parse_structured(col: Column) -> Column:
    """``SENTENCE:``/``PHRASES:`` lines in sections parted by ``---``.

    In a section the last line of each kind wins, even an empty one.
    """

    def last(lines: Column, tag: str) -> Column:
        hits = F.filter(lines, lambda line: line.startswith(tag))
        return strip(F.substr(F.try_element_at(hits, F.lit(-1)), F.lit(len(tag) + 1)))

    def section_pair(section: Column) -> Column:
        lines = F.transform(F.split(section, "\n", -1), strip)
        return let(
            lines,
            lambda ls: _pair(last(ls, "SENTENCE:"), split_phrases(last(ls, "PHRASES:"), ",")),
        )

    return _complete(F.transform(F.split(col, "---", -1), section_pair))


# First signs of all keywords in any case; the last one is the Kelvin sign, whose small letter is k.
_KEYWORD_SIGNS = "kKpPtTwW\u212a"


def _labelled_line(prefix: str, keyword: str) -> str:
    """``<prefix> sentence … <keyword>: phrases`` on one line, for Java's engine.

    The sentence runs up to a quote or the line end when the keyword follows
    that point (groups 1, 2), else up to the last keyword inside the run
    (groups 3, 4). Parting the two cases keeps the search linear in the line
    length, where a greedy run before a lazy gap would try every pair of cuts.
    Lines without a colon are passed over, and a keyword is compared, letter by letter in any
    case, only where one of the signs that such a keyword starts with stands.
    """
    head = rf"{prefix}[\"']*(?=[^\n:]*+:)"
    tail = rf"(?-iu:(?=[{_KEYWORD_SIGNS}])){keyword}:{WS_CLASS}*([^\n]+)"
    return (
        rf"(?dUium){head}(?:([^\"'\n]++)[\"']*+[^\n]*?{tail}"
        rf"|([^\"'\n]+){tail})"
    )


# A leading number is skipped where a match may start: at a line start (for the
# dash spelling also after a comma), or where it ends a line and so swallows the
# line break. No other start can match sooner or capture otherwise.
_NUMBER = rf"(?:\d+\.?{WS_CLASS}*)?"
_NUMBER_BREAK = rf"(?<!\d)\d+\.?[^\S\n]*\n{WS_CLASS}*"
_LINE_START = rf"(?:^{_NUMBER}|{_NUMBER_BREAK})"
_RUN_START = rf"(?:(?<![^,\n]){_NUMBER}[\"']*|[\"']+|{_NUMBER_BREAK}[\"']*)"

NATURAL_LABELLED = _labelled_line(rf"(?:sentence|text):{WS_CLASS}*", "(?:phrases?|words?|terms?)")
NATURAL_KEYWORD = _labelled_line(_LINE_START, "(?:key phrases?|phrases?|words?)")
# Dashes have no case; without these flags a sign is compared as it is.
_DASH = "(?-iu:[-–—])"
NATURAL_DASH = (
    rf"(?dUium){_RUN_START}([^\"'\n,]+)[\"']*{WS_CLASS}*{_DASH}{WS_CLASS}*([^\n]+)"
)


def _extract(col: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract_all(col, F.lit(pattern), F.lit(group))


# Noncharacters that mark the groups of a match in a rewritten text.
_OPEN, _MIDDLE, _CLOSE = "\ufdd0", "\ufdd1", "\ufdd2"


def _two_groups(col: Column, pattern: str, groups: tuple[str, str]) -> Column:
    """All matches as pairs of two groups, by one pass of the pattern.

    The pass rewrites each match to its groups between marks, and the marks are
    then split; a group written ``$1$3`` is whichever of both took part. A text
    that holds a mark itself is read group by group instead.
    """
    first, second = groups
    marked = F.regexp_replace(
        col, F.lit(pattern), F.lit(f"{_OPEN}{first}{_MIDDLE}{second}{_CLOSE}")
    )
    pieces = F.split(marked, _OPEN, -1)
    # The first piece lies before the first match. Dropping it by index names the
    # split once; each mention of it would run the pattern again.
    found = F.transform(
        F.filter(pieces, lambda _, i: i > 0), lambda p: F.substring_index(p, _CLOSE, 1)
    )
    fast = F.transform(
        found,
        lambda p: _pair(
            strip(F.substring_index(p, _MIDDLE, 1)),
            split_phrases(strip(F.substring_index(p, _MIDDLE, -1))),
        ),
    )

    def group(written: str) -> Column:
        parts = [_extract(col, pattern, int(g)) for g in written.split("$")[1:]]
        if len(parts) == 1:
            return parts[0]
        return F.zip_with(parts[0], parts[1], lambda x, y: F.when(x != "", x).otherwise(y))

    slow = F.zip_with(
        group(first), group(second), lambda s, p: _pair(strip(s), split_phrases(strip(p)))
    )
    has_mark = F.lit(False)
    for mark in (_OPEN, _MIDDLE, _CLOSE):
        has_mark = has_mark | col.contains(mark)
    return _complete(F.when(has_mark, slow).otherwise(fast))


def parse_natural(col: Column, strict: bool = False) -> Column:
    """Three loose spellings of sentence and phrases; all hits are kept.

    ``strict`` first drops lines of dashes only, which the third spelling
    would otherwise take for a phrase.
    """
    if strict:
        col = F.regexp_replace(col, r"(?dm)^\s*-{3,}\s*$", "")
    def spelling(text: Column, signs: str, pattern: str, groups: tuple[str, str]) -> Column:
        """Matches of one spelling, looked for only in texts with one of its signs."""
        has_sign = F.lit(False)
        for sign in signs:
            has_sign = has_sign | text.contains(sign)
        return F.when(has_sign, _two_groups(text, pattern, groups)).otherwise(
            F.when(text.isNotNull(), F.array().cast(PAIRS))
        )

    return let(
        col,
        lambda text: F.concat(
            spelling(text, ":", NATURAL_LABELLED, ("$1$3", "$2$4")),
            spelling(text, ":", NATURAL_KEYWORD, ("$1$3", "$2$4")),
            spelling(text, "-–—", NATURAL_DASH, ("$1", "$2")),
        ),
    )


def parse_fallback(col: Column) -> Column:
    """All ``SENTENCE:`` and ``PHRASES:`` hits, zipped to the shorter length."""
    sentences = _extract(col, rf"(?dU)SENTENCE:{WS_CLASS}*(.+)", 1)
    phrases = _extract(col, rf"(?dU)PHRASES:{WS_CLASS}*(.+)", 1)
    return _complete(
        F.zip_with(sentences, phrases, lambda s, p: _pair(strip(s), split_phrases(p, ",")))
    )


def reply_lines(col: Column) -> Column:
    """Stripped lines that are not empty, in order."""
    return F.filter(F.transform(F.split(col, "\n", -1), strip), lambda line: line != "")


def bullet_phrases(line: Column) -> Column:
    """Phrases after the last colon of a line; none without a colon."""
    return F.when(line.contains(":"), split_phrases(F.substring_index(line, ":", -1))).otherwise(
        F.array().cast("array<string>")
    )


def parse_candidates(col: Column) -> Column:
    """A list of replacement phrases out of a comma, semicolon, line or bar list."""

    def drop_lead_in(text: Column) -> Column:
        def cut(lowered: Column) -> Column:
            length = F.lit(0)
            for lead in reversed(LEAD_INS):
                length = F.when(lowered.startswith(lead), F.lit(len(lead))).otherwise(length)
            return length

        return let(
            let(F.lower(text), cut),
            lambda n: F.when(n > 0, strip(F.substr(text, n + 1))).otherwise(text),
        )

    def drop_numbers(text: Column) -> Column:
        text = F.regexp_replace(text, rf"(?dUm)^\d+\.{WS_CLASS}*", "")
        return F.regexp_replace(text, rf"(?dUm)^[-•*]{WS_CLASS}*", "")

    def pieces(text: Column) -> Column:
        separator = (
            F.when(text.contains(","), F.lit(","))
            .when(text.contains(";"), F.lit(";"))
            .when(text.contains("\n"), F.lit("\n"))
            .otherwise(F.lit("[|]"))
        )
        return F.transform(
            F.split(text, separator, -1), lambda p: squeeze(strip_quotes(strip(p)))
        )

    phrases = let(let(strip(col), lambda t: drop_numbers(drop_lead_in(t))), pieces)
    return F.filter(phrases, lambda p: F.length(p) > 1)


def parse_yes_no(col: Column) -> Column:
    """True when the reply has YES anywhere (so "yesterday" is a yes)."""
    return F.upper(strip(col)).contains("YES")


def parse_two_answers(col: Column) -> Column:
    """``STRUCT<is_ori, is_target>``: first and last word hold YES.

    With fewer than two words the sentence counts as still original.
    """

    def answers(words: Column) -> Column:
        both = F.size(words) >= 2
        first, last = F.try_element_at(words, F.lit(1)), F.try_element_at(words, F.lit(-1))
        return F.struct(
            F.when(both, first.contains("YES")).otherwise(F.lit(True)).alias("is_ori"),
            F.when(both, last.contains("YES")).otherwise(F.lit(False)).alias("is_target"),
        )

    spaced = F.replace(F.upper(strip(col)), F.lit(","), F.lit(" "))
    words = F.filter(F.split(spaced, f"(?U){WS_CLASS}+", -1), lambda w: w != "")
    return F.when(col.isNotNull(), let(words, answers))


def parse_label(col: Column) -> Column:
    """A predicted label: stripped, not checked against the label list."""
    return strip(col)


def parse_cascade(col: Column, bullets: Column | None = None) -> Column:
    """``STRUCT<strategy, pairs>``: the first parser that finds a pair wins.

    ``bullets`` holds the pairs of the line matcher, which needs the rows of the
    batch; it is tried third, before the positional fallback.
    """

    def pick(strategy: str, pairs: Column) -> Column:
        return F.struct(F.lit(strategy).alias("strategy"), pairs.alias("pairs"))

    steps = [("structured", parse_structured), ("natural", parse_natural)]
    if bullets is not None:
        steps.append(("bullet", lambda _: bullets))
    steps.append(("fallback", parse_fallback))

    def first_of(text: Column, rest: list) -> Column:
        if not rest:
            return pick("none", F.array().cast(PAIRS))
        strategy, parser = rest[0]
        return let(
            parser(text),
            lambda p: F.when(F.size(p) > 0, pick(strategy, p)).otherwise(first_of(text, rest[1:])),
        )

    return let(col, lambda text: first_of(text, steps))
