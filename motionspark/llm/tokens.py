"""Token ids of whole texts by a public tokenizer, with a bounded word memo in each Python worker.

Prose repeats words, so most of a tokenizer's time goes into merging the same words again. A text whose only white space
is single blanks and line feeds between printable characters is cut there and each word is encoded once per worker; any
other text goes through the tokenizer whole. Both give the ids that the tokenizer gives for the whole text.
"""

from __future__ import annotations

import re
from array import array
from functools import lru_cache

#: Characters that no tokenizer's pattern takes for white space, beside which a blank or line feed can be cut.
SAFE = "!-~¡-ᙿḀ-῿‐-‧‰-⁞⁰-⿿、-퟿\U00010000-\U0010ffff"
UNSAFE = re.compile(f"[^{SAFE} \n]")
#: Words that one memo holds at most (about 150 bytes each); words beyond it are encoded whenever they come.
MEMO_WORDS = 600_000
#: Longest word that a memo keeps.
MEMO_CHARS = 64
#: Bytes as byte-level vocabularies write them: printable Latin-1 as it is, the others from U+0100 on, in order.
PRINTABLE = {*range(33, 127), *range(161, 173), *range(174, 256)}
BYTE_CHARS = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in PRINTABLE)}
#: Letters of these alphabets are letters in every Unicode version.
LETTERS_BELOW = "\u0250"


class Memo(dict):
    """word -> ids as little-endian unsigned 32-bit bytes."""

    def __init__(self, encode, room: int):
        super().__init__()
        self.encode, self.room = encode, room

    def __missing__(self, word: str) -> bytes:
        ids = self.encode(word)
        if len(self) < self.room and len(word) <= MEMO_CHARS:
            self[word] = ids
        return ids


class TextEncoder:
    """``path``: a tokenizer file. ``blanks``: "kept" if a blank belongs to the word after it (byte-level vocabularies),
    "dropped" if the vocabulary ignores white space and case, "whole" to encode whole texts only."""

    def __init__(self, path: str, blanks: str, room: int = MEMO_WORDS):
        from tokenizers import Tokenizer

        if blanks not in ("kept", "dropped", "whole"):
            raise ValueError("blanks is kept, dropped or whole")
        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = True
        self.blanks, self.model = blanks, self.tok.model
        self.letters = Memo(self._letters, room)
        self.bare = Memo(self._word, room if blanks == "dropped" else room // 4)
        self.led = Memo(lambda word: self._word(word, " "), room)
        self.feed = self._pieces("\n") if blanks == "kept" else b""
        self.marks = {mark: self._pieces(mark) for mark in ".,"}

    def _pieces(self, word: str) -> bytes:
        if self.tok.normalizer is not None:
            word = self.tok.normalizer.normalize_str(word)
        ids = array("I")
        for piece, _ in self.tok.pre_tokenizer.pre_tokenize_str(word):
            ids.extend([t.id for t in self.model.tokenize(piece)])
        return ids.tobytes()

    def _letters(self, word: str) -> bytes:
        """Ids of letters of one case, with or without a blank before them: always one piece."""
        piece = word.encode().decode("latin-1").translate(BYTE_CHARS)
        return array("I", [t.id for t in self.model.tokenize(piece)]).tobytes()

    def _word(self, word: str, blank: str = "") -> bytes:
        head, mark = (word[:-1], word[-1]) if word[-1:] in self.marks else (word, "")
        if head.isalpha() and max(head) < LETTERS_BELOW:
            if self.blanks == "dropped":
                head = head.lower()
                if not head.isalpha():  # a capital whose small form has a combining mark
                    return self._pieces(word)
            ids = self.letters[blank + head]
            return ids + self.marks[mark] if mark else ids
        return self._pieces(blank + word)

    def whole(self, text: str) -> bytes:
        return array("I", self.tok.encode(text, add_special_tokens=False).ids).tobytes()

    def encode(self, text: str) -> bytes:
        """The ids of ``text`` as little-endian unsigned 32-bit bytes, without special tokens."""
        if not text:
            return b""
        if self.blanks == "whole" or not regular(text):
            return self.whole(text)
        if self.blanks == "dropped":
            return b"".join(map(self.bare.__getitem__, text.replace("\n", " ").split(" ")))
        parts = []
        for line in text.split("\n"):
            first, *rest = line.split(" ")
            parts.append(self.feed)
            parts.append(self.bare[first])
            parts.extend(map(self.led.__getitem__, rest))
        return b"".join(parts[1:])


def regular(text: str) -> bool:
    """True if single blanks and line feeds between safe characters are the only white space of ``text``."""
    return not (
        text[0] in " \n" or text[-1] in " \n" or "  " in text or " \n" in text or "\n " in text or "\n\n" in text or UNSAFE.search(text)
    )


@lru_cache(maxsize=4)
def encoder(path: str, blanks: str) -> TextEncoder:
    """One encoder a Python worker, kept between its tasks."""
    return TextEncoder(path, blanks)
