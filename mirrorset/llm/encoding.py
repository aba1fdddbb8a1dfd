"""Tokenizer runs that encode each distinct word once per Python worker.

Both tokenizer files cut a text into words before they merge, so ids of a text are
the ids of its words put together. Only cuts that the tokenizer would make itself
are used; everything else stays in one piece and goes to the library as it is.
"""

from __future__ import annotations

import functools
import itertools
import re
from collections.abc import Callable

import numpy as np
from tokenizers import Tokenizer, pre_tokenizers

from .staging import FORGET

SPACES_MEET = re.compile(r"\s\s|^\s|\s$")
LONE_SPACE = re.compile(r"(?<=\S) (?=\S)")
LATIN_WORD = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:;=?@\[-`{}~]*)")
LATIN = [chr(c) for c in (*range(65, 91), *range(97, 123), *range(0xC0, 0x100)) if c not in (0xD7, 0xF7)]
#: Marks of which the pattern above takes one after letters.
STOPS = frozenset(".,:;!?")
LONGEST_KEPT = 48
SAMPLE = ["word", "étéß", "aÿ", "thererone", "qu"]
#: Bytes that a worker remembers words in, and what an entry takes beside its characters and ids.
KEPT_BYTES, ENTRY_BYTES = 96 << 20, 200
#: How often the second table of words runs full before the first one is filled anew.
ROUNDS = 8


def for_letters(whole: Tokenizer, lead: str, packed: list[bytes]) -> Callable[[str], bytes]:
    """Packed ids of a word of small Latin letters after ``lead``: merged by the tokenizer's model itself.

    Normaliser and patterns leave such words as they are, so only bytes are written as the model's characters.
    That is tried out on a few words; a tokenizer of another kind is asked as a whole.
    """
    model, written = whole.model, pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
    if hasattr(model, "_resize_cache"):
        model._resize_cache(0)  # words are remembered here already
    table = {ord(c): written.pre_tokenize_str(c)[0][0] for c in [" ", *LATIN]}
    led, tokenize = lead.translate(table), model.tokenize

    def merged(word: str) -> bytes:
        # ASCII letters are written as they are
        return b"".join([packed[t.id] for t in tokenize(led + (word if word.isascii() else word.translate(table)))])

    def asked(word: str) -> bytes:
        return b"".join([packed[i] for i in whole.encode(lead + word, add_special_tokens=False).ids])

    return merged if all(merged(w) == asked(w) for w in SAMPLE) else asked


class Words(dict):
    """Packed ids by word; a new word is encoded when it is looked up.

    Letters and the punctuation after them are words of their own to the tokenizer, so they are put together
    from what is known. ``kept`` bounds the bytes of words in this table, and of those in ``older``. Frequent words come
    early, so this table stays once it is full; rarer ones then go to ``older``, which is emptied when it is full.
    After ``ROUNDS`` of that, texts may have changed: this table is filled anew, out of ``older`` too.
    """

    def __init__(self, tokenizer: Tokenizer, packed: list[bytes], lead: str, lower: bool, kept: int) -> None:
        self.tokenizer, self.packed = tokenizer, packed
        self.letters = for_letters(tokenizer, lead, packed)
        self.lead, self.lower, self.kept = lead, lower, kept
        self.older: dict[str, bytes] = {}
        self.into: dict[str, bytes] = self
        self.rounds = 0
        self.marks: dict[str, bytes] = {"": b""}
        self.long: list[str] = []
        self.held = 0

    def _encode(self, text: str) -> bytes:
        return b"".join([self.packed[i] for i in self.tokenizer.encode(text, add_special_tokens=False).ids])

    def _mark(self, text: str) -> bytes:
        if text not in self.marks:
            if len(text) > 8 or len(self.marks) > 10_000:
                return self._encode(text)
            self.marks[text] = self._encode(text)
        return self.marks[text]

    def __missing__(self, word: str) -> bytes:
        ids = self.older.get(word)
        if ids is None:
            # most new words are plain letters
            if word.isascii() and word.isalpha() and (not self.lower or word.islower()):
                ids = self.letters(word)
            else:
                ids = self._composed(word)
        elif self.into is self.older:
            return ids
        self.into[word] = ids
        n = len(word)
        self.held += ENTRY_BYTES + 2 * n + len(ids)
        if n > LONGEST_KEPT:
            self.long.append(word)
        return ids

    def _composed(self, word: str) -> bytes:
        # most others are plain letters with a stop or comma
        letters, marks = word[:-1], word[-1:]
        if not (marks in STOPS and letters.isascii() and letters.isalpha()):
            if (parts := LATIN_WORD.fullmatch(word)) is None:
                return self._encode(self.lead + word)
            letters, marks = parts.groups()
        if self.lower:
            letters = letters.lower()
        return self.letters(letters) if letters == word else self[letters] + self._mark(marks)

    def age(self) -> None:
        """Forget very long words, and what a table holds beyond its share."""
        for word in self.long:
            self.held -= ENTRY_BYTES + 2 * len(word) + len(self.into.pop(word, b""))
        self.long.clear()
        if self.held > self.kept:
            self.held = 0
            if self.into is self.older:
                self.rounds += 1
            if self.rounds == ROUNDS:
                self.rounds, self.into = 0, self
                self.clear()
            else:
                self.into = self.older = {}


class WordEncoder:
    """``spaces`` says what the tokenizer does with a space: "lead" joins it to the next word, "drop" loses it."""

    def __init__(self, path: str, spaces: str, kept: int = KEPT_BYTES) -> None:
        tokenizer = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2" if tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4")
        packed = [i.to_bytes(self.dtype.itemsize, "little") for i in range(tokenizer.get_vocab_size(with_added_tokens=True))]
        self.spaces = spaces
        # where spaces lead, most words have one; both tables take half of a share each
        own = kept if spaces == "drop" else kept // 8
        self.words = Words(tokenizer, packed, "", spaces == "drop", own // 2)
        self.led = Words(tokenizer, packed, " ", False, (kept - own) // 2)

    def _one(self, text: str) -> bytes:
        word, led = self.words.__getitem__, self.led.__getitem__
        if self.spaces == "drop":
            return b"".join(map(word, text.replace("\n", " ").replace("\t", " ").split(" ")))
        # a text where white space meets white space is one line, cut at lone spaces only; most texts are told apart without the pattern
        words = text.split() or [""]
        if " ".join(words) == text.replace("\n", " "):
            ends = itertools.accumulate(line.count(" ") + 1 for line in text.split("\n")) if "\n" in text else [len(words)]
            lines = [words[a:b] for a, b in itertools.pairwise([0, *ends])]
        elif SPACES_MEET.search(text):
            lines = [LONE_SPACE.split(text)]
        else:
            lines = [line.split(" ") for line in text.split("\n")]
        return word("\n").join([b"".join([word(words[0]), *map(led, words[1:])]) for words in lines])

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as packed little-endian numbers of ``dtype``."""
        out = []
        for text in texts:
            out.append(self._one(text))
            self.words.age()
            self.led.age()
        return out


@functools.lru_cache(maxsize=1)
def encoder(path: str, spaces: str, kept: int = KEPT_BYTES) -> WordEncoder:
    return WordEncoder(path, spaces, kept)


FORGET.append(encoder.cache_clear)
