"""Deterministic stand-ins for model replies, over every row of the given tables.

Each reply follows from an md5 of the row's keys, so Spark and SQL write the same
text. They are test doubles for the checks only.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"([^\s,.|]+)"


def first_word(text: Column) -> Column:
    return F.regexp_extract(text, WORD, 1)


def last_word(text: Column) -> Column:
    return F.reverse(F.regexp_extract(F.reverse(text), WORD, 1))


FIRST_WORD_SQL = f"regexp_extract(text, '{WORD}', 1)"
LAST_WORD_SQL = f"reverse(regexp_extract(reverse(text), '{WORD}', 1))"


def digit(tag: str, *keys: str | Column) -> Column:
    """One hex digit drawn from the keys."""
    texts = [(F.col(k) if isinstance(k, str) else k).cast("string") for k in keys]
    return F.substring(F.md5(F.concat_ws(":", F.lit(tag), *texts)), 1, 1)


def digit_sql(tag: str, *keys: str) -> str:
    return f"substr(md5(concat_ws(':', '{tag}', {', '.join(keys)})), 1, 1)"


def words(text: Column) -> Column:
    """First and last word of a text, without empty ones."""
    return F.filter(F.array(first_word(text), last_word(text)), lambda w: w != "")


WORDS_SQL = f"list_filter([{FIRST_WORD_SQL}, {LAST_WORD_SQL}], lambda w: w <> '')"


# --- pattern replies ---------------------------------------------------------

def _said(text: Column, row_id: Column) -> Column:
    d = digit("say", row_id)
    return (
        F.when(d < "8", text)
        .when(d < "b", F.concat(F.lit('"'), text, F.lit('"')))
        .when(d < "d", F.regexp_replace(text, " [^ ]+$", "..."))
        .when(d < "e", F.concat(F.lit("12. "), text))
        .when(d < "f", F.replace(text, F.lit(" "), F.lit("  ")))
        .otherwise(F.lit("Nothing like this is in the batch"))
    )


SAID_SQL = f"""
  CASE WHEN d < '8' THEN text
       WHEN d < 'b' THEN '"' || text || '"'
       WHEN d < 'd' THEN regexp_replace(text, ' [^ ]+$', '...')
       WHEN d < 'e' THEN '12. ' || text
       WHEN d < 'f' THEN replace(text, ' ', '  ')
       ELSE 'Nothing like this is in the batch' END
"""


def pattern_reply(rows: Column, label: Column, batch_no: Column) -> Column:
    """A reply to a batch in one of the formats the parsers know, or junk."""
    d = digit("format", label, batch_no)

    def each(template) -> Column:
        return F.array_join(
            F.transform(
                rows,
                lambda r: template(_said(r["text"], r["id"]), F.array_join(words(r["text"]), ", ")),
            ),
            "\n",
        )

    structured = each(lambda s, p: F.concat(F.lit("SENTENCE: "), s, F.lit("\nPHRASES: "), p, F.lit("\n---")))
    natural = each(lambda s, p: F.concat(F.lit("1. Sentence: "), s, F.lit(" Phrases: "), p))
    bullet = each(lambda s, p: F.concat(F.lit("* "), s, F.lit(" : "), p))
    spread = each(lambda s, p: F.concat(F.lit("SENTENCE:\n"), s, F.lit("\nPHRASES:\n"), p))
    return (
        F.when(d < "4", structured)
        .when(d < "6", F.concat(F.lit("```\n"), structured, F.lit("\n```")))
        .when(d < "9", natural)
        .when(d < "c", bullet)
        .when(d < "e", spread)
        .otherwise(F.lit("I cannot help with that."))
    )


# --- later replies -----------------------------------------------------------

def candidate_reply(d: Column, phrase: Column) -> Column:
    def fill(template: str) -> Column:
        parts = template.split("{}")
        out = [F.lit(parts[0])]
        for part in parts[1:]:
            out += [phrase, F.lit(part)]
        return F.concat(*out)

    return (
        F.when(d < "4", fill('Here are the alternatives: {} one, "{} two", x'))
        .when(d < "8", fill("1. {} one\n2. {} two"))
        .when(d < "c", fill("- {} one; '{}  two'"))
        .when(d < "e", fill("{} one | {} two"))
        .when(d < "f", fill("Suggestions: {} only"))
    )


CANDIDATE_REPLY_SQL = """
  CASE WHEN d < '4' THEN 'Here are the alternatives: ' || matched_phrase || ' one, "' || matched_phrase || ' two", x'
       WHEN d < '8' THEN '1. ' || matched_phrase || ' one' || chr(10) || '2. ' || matched_phrase || ' two'
       WHEN d < 'c' THEN '- ' || matched_phrase || ' one; ''' || matched_phrase || '  two'''
       WHEN d < 'e' THEN matched_phrase || ' one | ' || matched_phrase || ' two'
       WHEN d < 'f' THEN 'Suggestions: ' || matched_phrase || ' only' END
"""

META_REPLY = "Given the Constraints, the assistant cannot rewrite this."


def generation_reply(d: Column, phrases: Column, text: Column) -> Column:
    return (
        F.when(d == "0", F.lit(None))
        .when(d == "1", F.lit(META_REPLY))
        .when(d == "2", F.lit(' "" '))
        .otherwise(F.concat(F.lit(' "'), F.try_element_at(phrases, F.lit(1)), F.lit(" "), text, F.lit("\"\n")))
    )


GENERATION_REPLY_SQL = f"""
  CASE WHEN d = '0' THEN NULL
       WHEN d = '1' THEN '{META_REPLY}'
       WHEN d = '2' THEN ' "" '
       ELSE ' "' || candidate_phrases[1] || ' ' || ori_text || '"' || chr(10) END
"""


def semantic_reply(d: Column) -> Column:
    return (
        F.when(d < "b", F.lit("YES"))
        .when(d < "d", F.lit(" yes, both\n"))
        .when(d < "f", F.lit("No."))
    )


SEMANTIC_REPLY_SQL = """
  CASE WHEN d < 'b' THEN 'YES' WHEN d < 'd' THEN ' yes, both' || chr(10) WHEN d < 'f' THEN 'No.' END
"""


def discriminator_reply(d: Column) -> Column:
    return (
        F.when(d < "8", F.lit("NO, YES"))
        .when(d < "a", F.lit("no and then yes"))
        .when(d < "b", F.lit("YES, NO"))
        .when(d < "c", F.lit("yes"))
        .when(d < "d", F.lit("NO,NO"))
        .when(d < "f", F.lit("Yes, Yes"))
    )


DISCRIMINATOR_REPLY_SQL = """
  CASE WHEN d < '8' THEN 'NO, YES' WHEN d < 'a' THEN 'no and then yes' WHEN d < 'b' THEN 'YES, NO'
       WHEN d < 'c' THEN 'yes' WHEN d < 'd' THEN 'NO,NO' WHEN d < 'f' THEN 'Yes, Yes' END
"""


def prediction_reply(d: Column, truth: Column) -> Column:
    return F.concat(
        F.lit(" "),
        F.when(d < "a", truth)
        .when(d < "d", F.lit("concept A"))
        .when(d < "e", F.lit("concept C"))
        .when(d < "f", F.lit("I am not sure")),
        F.lit("\n"),
    )


PREDICTION_REPLY_SQL = """
  CASE WHEN d < 'a' THEN y_true WHEN d < 'd' THEN 'concept A' WHEN d < 'e' THEN 'concept C'
       WHEN d < 'f' THEN 'I am not sure' END
"""


def failure(reply: Column, text: str = "timeout") -> Column:
    """The error of a call that gave no reply."""
    return F.when(reply.isNull(), F.lit(text))
