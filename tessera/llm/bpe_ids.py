"""Token ids of whole texts from a ``tokenizers`` file, fast enough for a corpus.

Byte-level BPE cuts text before every blank that stands next to a non-blank, so a text's ids are the ids of its pieces,
joined. Each Python worker keeps a bounded table from piece to packed ids and asks the tokenizer only for new pieces.
A text in which such a cut is not certain (three blanks in a row, or two at its end) goes to the tokenizer whole.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np

END = b"\x00\x00\x00\x00"
#: Pieces that a task remembers: about 200 bytes each. Tasks start anew, so workers hold none between them.
REMEMBER = 1_200_000
_UNSURE = re.compile(r"\s\s(?:\s|\Z)")
_MARKS = (".", ",", "!", "?", ";", ":")


def _alphabet() -> dict[int, str]:
    """The character that byte-level vocabularies write for each byte: itself if it prints, else the next one from 256 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(256, 512))
    return {b: chr(b if b in plain else next(others)) for b in range(256)}


_ALPHABET = _alphabet()
_BLANK = _ALPHABET[0x20]


@lru_cache(maxsize=2)
def _load(path: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class _Known(dict):
    """Piece to packed ids; asks for a new one. When half of what may be remembered is new, the older half goes: pieces in use stay."""

    def __init__(self, learn: Callable[[str], bytes], most: int):
        super().__init__()
        self.learn, self.half, self.older = learn, max(1, most // 2), {}

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= self.half:
            self.older = dict(self)
            self.clear()
        ids = self.older.get(piece) or self.learn(piece)
        self[piece] = ids
        return ids


class PackedEncoder:
    """``encode(texts)`` gives each text's ids as little-endian unsigned 32-bit bytes, without an end id."""

    def __init__(self, path: str, remember: int = REMEMBER):
        self.tokenizer = _load(path)
        self.tokenize = self.tokenizer.model.tokenize
        self.known = _Known(self._learn, remember)
        self.packed = [struct.pack("<I", i) for i in range(self.tokenizer.get_vocab_size())]
        self.line_feed = self._ask("\n")
        self.marks = {m: self._ask(m) for m in _MARKS}
        specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, specials))) if specials else None

    def _ask(self, text: str) -> bytes:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _learn(self, piece: str) -> bytes:
        """The ids of a new piece."""
        tail = piece[1:]
        if tail.isalpha() and (piece[0] == " " or piece[0].isalpha()):
            return self._word(piece)
        # a line feed before a word, and a mark after one, are always tokens of their own
        feed = piece[:1] == "\n"
        word = tail if feed else piece
        mark = self.marks.get(word[-1:])
        if mark:
            word = word[:-1]
        if (word[1:] if word[:1] == " " else word).isalpha():
            return (self.line_feed if feed else b"") + (self.known.get(word) or self._word(word)) + (mark or b"")
        return self._ask(piece)

    def _word(self, word: str) -> bytes:
        """The ids of letters after at most one blank: they are one word to the model."""
        if word.isascii():  # letters stand for themselves
            text = _BLANK + word[1:] if word[0] == " " else word
        else:
            text = word.encode().decode("latin-1").translate(_ALPHABET)
        packed = self.packed
        return b"".join([packed[t.id] for t in self.tokenize(text)])

    def encode(self, texts: list[str]) -> list[bytes]:
        look, out = self.known.__getitem__, []
        for text in texts:
            if _UNSURE.search(text) or (self.special and self.special.search(text)):
                out.append(self._ask(text))
                continue
            # every piece but the first starts with its blank; lines are cut before the line feed
            pieces = text.replace(" ", "\x00 ").replace("\n", "\x00\n").split("\x00") if "\x00" not in text else re.split(r"(?=[ \n])", text)
            out.append(b"".join(map(look, pieces)))
        return out


def small_batches(texts: list[str], most: int = 4 << 20) -> Iterator[tuple[int, list[str]]]:
    """(start, texts) of runs of at most about ``most`` characters, so that a worker's memory stays bounded."""
    start = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > most:
            yield start, texts[start:i]
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield start, texts[start:]
