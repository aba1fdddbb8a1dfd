"""Chat messages as ``ARRAY<STRUCT<role, content>>`` columns.

The wording of the prompts is free; the fields they carry and the reply formats
they ask for must agree with the parsers in ``replies``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MESSAGES = "array<struct<role:string,content:string>>"

# Temperature, token limit and stop strings of each stage.
STAGE_DEFAULTS = {
    "pattern": (1.0, 4096, None),
    "candidates": (1.0, 2048, None),
    "generation": (1.0, 1024, ["\n"]),
    "semantic": (1.0, 512, None),
    "discriminator": (1.0, 256, None),
    "scoring": (0.0, 4096, ["\n"]),
}
# Model families with a fixed temperature and no stop strings.
FIXED_TEMPERATURE_FAMILIES = ["gpt-5", "gpt-4o"]


def message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def request_id(stage: str, *keys: Column) -> Column:
    """Stable id of a request: the same stage and keys always hash alike.

    Each key is led by its length, so no two key lists share one text.
    """
    parts = [F.lit(stage)]
    for key in keys:
        text = F.coalesce(key.cast("string"), F.lit(""))
        parts += [F.length(text).cast("string"), text]
    return F.md5(F.concat_ws(":", *parts))


def _say(template: str, **fields: Column) -> Column:
    """Fill ``{name}`` slots of a template with columns."""
    parts: list[Column] = []
    rest = template
    while "{" in rest:
        before, rest = rest.split("{", 1)
        name, rest = rest.split("}", 1)
        if before:
            parts.append(F.lit(before))
        parts.append(F.coalesce(fields[name], F.lit("")))
    parts.append(F.lit(rest))
    return F.concat(*parts)


def _chat(system: str, user: str, **fields: Column) -> Column:
    return F.array(message("system", _say(system, **fields)), message("user", _say(user, **fields)))


PATTERN_SYSTEM = "You find the words in a sentence that carry its label."
PATTERN_USER = (
    "Every sentence below has the label '{label}'.\n"
    "For each one, copy it unchanged and name one to three phrases that carry the label.\n"
    "{lines}\n"
    "Reply in this form, one block per sentence:\n"
    "SENTENCE: <sentence>\n"
    "PHRASES: <phrase>, <phrase>\n"
    "---"
)
CANDIDATE_SYSTEM = "You suggest replacement phrases that move a sentence to another label."
CANDIDATE_USER = (
    "Sentence: {text}\n"
    "The phrase '{phrase}' carries the label '{label}'.\n"
    "Suggest five to seven phrases to put in its place so that the sentence reads as '{target}'.\n"
    "Reply with the phrases only, separated by commas."
)
GENERATION_SYSTEM = "You rewrite a sentence so that it holds one of the given phrases."
GENERATION_USER = (
    "Rewrite the sentence from label '{label}' to label '{target}'.\n"
    "Use one of these phrases word for word: {phrases}\n"
    "Do not use the word '{target}' and do not keep the label '{label}'.\n"
    "Sentence: {text}\n"
    "Reply with the new sentence only."
)
SEMANTIC_SYSTEM = "You check rewritten sentences."
SEMANTIC_USER = (
    "Original: {text}\n"
    "Replaced phrase: {phrase}\n"
    "Allowed phrases: {phrases}\n"
    "Rewritten: {counterfactual}\n"
    "Does the rewritten sentence use an allowed phrase word for word and keep the topic?\n"
    "Reply YES or NO."
)
DISCRIMINATOR_SYSTEM = "You classify sentences."
DISCRIMINATOR_USER = (
    "Sentence: {counterfactual}\n"
    "First: does it belong to '{label}'? Second: does it belong to '{target}'?\n"
    "Reply with two words, each YES or NO, separated by a comma."
)
SCORING_SYSTEM = "Sort each sentence into one of these labels: {labels}. Reply with the label only."


def pattern_messages(label: Column, lines: Column) -> Column:
    return _chat(PATTERN_SYSTEM, PATTERN_USER, label=label, lines=lines)


def candidate_messages(text: Column, phrase: Column, label: Column, target: Column) -> Column:
    return _chat(
        CANDIDATE_SYSTEM, CANDIDATE_USER, text=text, phrase=phrase, label=label, target=target
    )


def generation_messages(text: Column, label: Column, target: Column, phrases: Column) -> Column:
    return _chat(
        GENERATION_SYSTEM,
        GENERATION_USER,
        text=text,
        label=label,
        target=target,
        phrases=F.array_join(phrases, ", "),
    )


def semantic_messages(text: Column, phrase: Column, phrases: Column, counterfactual: Column) -> Column:
    return _chat(
        SEMANTIC_SYSTEM,
        SEMANTIC_USER,
        text=text,
        phrase=phrase,
        phrases=F.array_join(phrases, ", "),
        counterfactual=counterfactual,
    )


def discriminator_messages(counterfactual: Column, label: Column, target: Column) -> Column:
    return _chat(
        DISCRIMINATOR_SYSTEM,
        DISCRIMINATOR_USER,
        counterfactual=counterfactual,
        label=label,
        target=target,
    )


def scoring_system(labels: Column) -> Column:
    return message("system", _say(SCORING_SYSTEM, labels=F.array_join(labels, ", ")))


def to_dialect(messages: Column) -> Column:
    """``STRUCT<system, contents>`` for clients that take the system text apart.

    The last system message is lifted out (an empty one counts as none),
    ``assistant`` becomes ``model``, other roles than ``user`` are dropped.
    """
    system = F.filter(messages, lambda m: m["role"] == "system")
    last = F.try_element_at(F.transform(system, lambda m: m["content"]), F.lit(-1))
    turns = F.filter(messages, lambda m: m["role"].isin("user", "assistant"))
    contents = F.transform(
        turns,
        lambda m: F.struct(
            F.when(m["role"] == "assistant", F.lit("model")).otherwise(m["role"]).alias("role"),
            m["content"].alias("content"),
        ),
    )
    return F.struct(F.nullif(last, F.lit("")).alias("system"), contents.alias("contents"))


def render(messages: Column) -> Column:
    """One text per message list, ``role: content`` on lines."""
    return F.array_join(
        F.transform(messages, lambda m: F.concat(m["role"], F.lit(": "), m["content"])), "\n"
    )


def is_quota_error(error: Column) -> Column:
    """True for errors that tell of a used-up quota."""
    return F.coalesce(error.contains("429") | error.contains("RESOURCE_EXHAUSTED"), F.lit(False))
