"""Parsers against hand-made rows, built replies and, on random texts, the patterns of the SQL views."""

import random
import re

from catalog.views import NATURAL_SQL
from mirrorset.functions import replies, text

TOKENS = [
    "a", "b ", " ", "  ", "\n", "\n\n", ",", ";", '"', "'", ":", "-", "–", "---", "1", "12.", "3. ",
    "sentence:", "Sentence: ", "TEXT:", "phrases:", "Key Phrases: ", "word:", "Words: ", "terms:",
    "SENTENCE:", "SENTENCE: ", "PHRASES:", "PHRASES: ", "foo", "é", "\t", "\xa0", "*", "•", "|", ".",
    "```", "here are ", "Suggestions:", "...", "…",
]


def random_texts(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choices(TOKENS, k=rng.randint(0, 14))) for _ in range(n)]


def pairs(result):
    return None if result is None else [(p["sentence"], list(p["phrases"])) for p in result]


def matched(value):
    """What the three loose spellings of the SQL views find, as Python reads them: matches with a sentence and a phrase."""
    hits = [hit for pattern in NATURAL_SQL for hit in re.findall(pattern, value)]
    split = [(sentence.strip(), [p.strip() for p in phrases.replace(";", ",").split(",")]) for sentence, phrases in hits]
    return [(sentence, [p for p in phrases if p]) for sentence, phrases in split if sentence and any(phrases)]


def test_natural_agrees_with_plain_regex(evaluate):
    texts = random_texts(6000, 1)
    for value, got in zip(texts, evaluate(replies.parse_natural, texts)):
        assert pairs(got) == matched(value), repr(value)


def test_natural_hand_rows(evaluate):
    got = evaluate(
        replies.parse_natural,
        ["Sentence: 'foo' Phrases: a; b", "1. SENTENCE: foo bar\nPHRASES: bar\n---\n2. SENTENCE: baz\nPHRASES: q"],
    )
    assert pairs(got[0]) == [("foo", ["a", "b"]), ("Sentence:", ["a", "b"])]
    assert pairs(got[1]) == [("PHRASES: bar", ["--"])]


def test_natural_strict_ignores_separator_lines(evaluate):
    value = "1. SENTENCE: foo bar\nPHRASES: bar\n---\n2. SENTENCE: baz\nPHRASES: q"
    assert pairs(evaluate(lambda c: replies.parse_natural(c, strict=True), [value])[0]) == []


def test_natural_stays_linear_on_long_lines(evaluate):
    plain = "lorem ipsum " * 4000
    worst = plain + "phrases: " + plain + "\n" + plain
    got = evaluate(replies.parse_natural, [plain, worst])
    assert pairs(got[0]) == []
    assert len(pairs(got[1])) == 1


def test_structured(evaluate):
    value = "SENTENCE: a b\nPHRASES: x, y ,\n---\nSENTENCE: c\nPHRASES: z\nSENTENCE: d\n---\nSENTENCE: only\n---"
    assert pairs(evaluate(replies.parse_structured, [value])[0]) == [("a b", ["x", "y"]), ("d", ["z"])]


def built_section(rng):
    """A section made from lines whose meaning is known, and the pair it stands for, or None."""
    sentence, phrases, lines = "", [], []
    for _ in range(rng.randint(0, 5)):
        indent, kind = rng.choice(["", " ", "\t", "\xa0"]), rng.randint(0, 3)
        if kind == 0:
            sentence = rng.choice(["", "a b", "c: d", "é", "PHRASES: x", "sentence: low"])
            lines.append(f"{indent}SENTENCE:{rng.choice(['', ' '])}{sentence} ")
        elif kind == 1:
            phrases = rng.sample(["x", "y z", "é;w", "SENTENCE:"], rng.randint(0, 3))
            lines.append(f"{indent}PHRASES: {rng.choice([',', ' , ', ', ,']).join(phrases)}{rng.choice(['', ',', ' ,'])}")
        else:
            lines.append(indent + rng.choice(["", "noise", "1. SENTENCE: q", "sentence: q", "Phrases: q", "--x"]))
    return "\n".join(lines), (sentence, phrases) if sentence and phrases else None


def test_structured_on_built_replies(evaluate):
    rng = random.Random(2)
    built = [[built_section(rng) for _ in range(rng.randint(1, 4))] for _ in range(3000)]
    texts = [rng.choice(["---", "\n---\n"]).join(section for section, _ in sections) for sections in built]
    for value, sections, got in zip(texts, built, evaluate(replies.parse_structured, texts)):
        assert pairs(got) == [pair for _, pair in sections if pair], repr(value)


def test_fallback_hand_rows(evaluate):
    rows = {
        "1. SENTENCE:\nq\nPHRASES: m\nSENTENCE: w": [("q", ["m"])],
        "SENTENCE: a PHRASES: b\nPHRASES: c": [("a PHRASES: b", ["b"])],
        "PHRASES: early, one\nnoise\nx SENTENCE:\t late ": [("late", ["early", "one"])],
        "SENTENCE: a\nSENTENCE: b\nPHRASES: x\nPHRASES: , y ,": [("a", ["x"]), ("b", ["y"])],
        "SENTENCE: a\nPHRASES: ,\nSENTENCE: b\nPHRASES: y": [("b", ["y"])],
        "SENTENCE:  \n\n é z \nPHRASES:\xa0k;l": [("é z", ["k;l"])],
        "sentence: a\nphrases: b": [],
        "SENTENCE: only": [],
        "PHRASES: only": [],
        "SENTENCE:": [],
        "": [],
    }
    for (value, want), got in zip(rows.items(), evaluate(replies.parse_fallback, [*rows])):
        assert pairs(got) == want, repr(value)


def test_cascade_order(evaluate):
    got = evaluate(
        replies.parse_cascade,
        ["SENTENCE: a b\nPHRASES: x, y", "foo - bar", "x\nSENTENCE:\nq\nPHRASES:\nm", "junk", None],
    )
    assert [g["strategy"] for g in got] == ["structured", "natural", "fallback", "none", "none"]
    assert pairs(got[2]["pairs"]) == [("q", ["m"])]


def test_candidates_hand_rows(evaluate):
    got = evaluate(
        replies.parse_candidates,
        [
            'Here are the alternatives: good, "great", x',
            "1. calm place\n2. quiet room",
            "- one thing\n• two  things\n* 'three'",
            "aa; bb; bb",
            "aa | b | cc",
            "Suggestions: just one",
            "alternatives: ",
        ],
    )
    assert got == [
        ["the alternatives: good", "great"],
        ["calm place", "quiet room"],
        ["one thing", "two things", "three"],
        ["aa", "bb", "bb"],
        ["aa", "cc"],
        ["just one"],
        [],
    ]


def test_verdicts(evaluate):
    assert evaluate(replies.parse_yes_no, ["yesterday", "No.", None]) == [True, False, None]
    got = evaluate(replies.parse_two_answers, ["NO, YES", "yes", "NO maybe YES", "", None])
    assert [tuple(g) if g else None for g in got] == [
        (False, True), (True, False), (False, True), (True, False), None,
    ]


def test_clean_response(evaluate):
    got = evaluate(
        text.clean_response,
        ["```json\na\nb\n```", "```a```", " \n q \t", "```x\ny", "a ``` b", "\xa0k　"],
    )
    assert got == ["a\nb", "a", "q", "x\ny", "a ``` b", "k"]


def test_normalize(evaluate):
    got = evaluate(text.normalize_text, ['- "It\'s  GOOD..." ', "12. Foo\tbar . .", "• a…", "..."])
    assert got == ["its good", "foo bar", "a", ""]


def test_heuristic(evaluate):
    got = evaluate(
        text.heuristic_ok,
        ["Given the CONSTRAINTS, The Assistant", "the assistant", None, "fine"],
    )
    assert got == [False, True, False, True]


def test_missing_values(evaluate):
    assert evaluate(text.canonical_label, ["None", "NONE", "null", "", "joy", "NaN", None]) == [
        None, None, None, None, "joy", None, None,
    ]
    assert evaluate(text.canonical_null, ["none", "None", "N/A", "", "x"]) == ["none", None, None, None, "x"]
    assert evaluate(text.slug, ["qwen:7b-chat", "a/b.c"]) == ["qwen_7b_chat", "a_b_c"]


def test_tokens(evaluate):
    assert evaluate(text.token_estimate, ["a b c", "", " x\n", None]) == [3, 0, 1, 0]


def test_natural_keywords_in_any_case(evaluate):
    texts = ["a b: 'q' Key Phraſes: x", "a TERMſ: x", "Text: b ſentence WORD: y; z", "no sign here\na, b — c", "a word : b\nc words: d"]
    for value, got in zip(texts, evaluate(replies.parse_natural, texts)):
        assert pairs(got) == matched(value), repr(value)
