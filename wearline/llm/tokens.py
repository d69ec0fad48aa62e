"""Token ids of whole texts by the public word-level BPE file, at the speed of a dictionary.

The tokenizer drops white space and never joins what white space parts, so a text's ids are its chunks' ids in a
row. Each Python worker remembers the ids of short chunks and words it has met, in dictionaries bounded by their bytes.
"""

from __future__ import annotations

import os
import re
from array import array

from wearline.llm.common import give_back

#: Bytes the dictionaries may take, and those of signs among them (time and memory depend on it, not results).
REMEMBERED_BYTES = 168 << 20
SIGNS_BYTES = 4 << 20
#: Most that an entry of a short key can take: key and value at their widest, and a slot. Usual ones take half of it.
ENTRY_BYTES = 480
#: Longer keys are looked up each time and not remembered.
LONGEST = 32
#: Letters whose lower case and normal form are single code points, and signs that form one token run behind them.
_SIMPLE = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:!?%&*#$|]*)")


def _byte_letters() -> list[str]:
    """Printable stand-in of each byte, as byte-level vocabularies write it: printable bytes stand for themselves,
    the others follow from code point 256 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    others = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(others)) for b in range(256)]


class Remembering(dict):
    """A dictionary that finds missing values and remembers those of short keys. When half its bytes are taken, what it
    holds becomes the old half: keys met again move over, the others go with the next change, so frequent keys stay."""

    def __init__(self, find, limit: int = REMEMBERED_BYTES):
        super().__init__()
        self._find, self._most, self._old = find, max(1, limit // 2 // ENTRY_BYTES), {}

    def __missing__(self, key):
        value = self._old.get(key)
        if value is None:
            value = self._find(key)
        if len(key) <= LONGEST:
            if len(self) >= self._most:
                self._old = dict(self)
                self.clear()
            self[key] = value
        return value


class WordTokenizer:
    """Ids as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._model = self._tokenizer.model
        self._letters = _byte_letters()
        # Words are chunks too, and runs of signs are few: one dictionary has most of the room.
        self._signs = Remembering(self._whole, SIGNS_BYTES)
        self._chunks = Remembering(self._chunk, REMEMBERED_BYTES - SIGNS_BYTES)

        if array("I").itemsize != 4 or os.sys.byteorder != "little":
            raise RuntimeError("ids are packed on little-endian machines with 32-bit ints")

    def _whole(self, text: str) -> bytes:
        return array("I", self._tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _word(self, word: str) -> bytes:
        if not word.isascii():
            letters = self._letters
            word = "".join([letters[b] for b in word.encode()])
        return array("I", [token.id for token in self._model.tokenize(word)]).tobytes()

    def _chunk(self, chunk: str) -> bytes:
        if chunk.isascii() and chunk.islower() and chunk.isalpha():
            return self._word(chunk)
        simple = _SIMPLE.fullmatch(chunk)
        if simple is None:
            return self._whole(chunk)
        word, signs = simple.groups()
        lower = word.lower()
        if lower == chunk:
            return self._word(chunk)
        ids = self._chunks[lower]
        return ids + self._signs[signs] if signs else ids

    def encode(self, text: str) -> bytes:
        """Ids of a text without line feeds between sentences of interest; equal to the tokenizer's own."""
        return b"".join(map(self._chunks.__getitem__, text.replace("\n", " ").split(" ")))

    def sentences(self, text: str) -> list[bytes]:
        """Ids of each sentence (up to a stop and a space, or a line feed); joined, they are the ids of the text."""
        chunks = self._chunks.__getitem__
        marked = text.replace(". ", ".\n").replace("! ", "!\n").replace("? ", "?\n")
        return [b"".join(map(chunks, sentence.split(" "))) for sentence in marked.split("\n")]


_loaded: dict[str, WordTokenizer] = {}


def forget() -> None:
    """Let go of what this Python worker remembers. Workers go on to tasks of other stages, which need the room: those
    that hold much of their own, and no tokenizer, call this first. It changes time and memory, not results."""
    if _loaded:
        _loaded.clear()
        give_back()


def word_tokenizer(path: str) -> WordTokenizer:
    """The tokenizer of this Python worker, loaded once."""
    if path not in _loaded:
        _loaded[path] = WordTokenizer(path)
    return _loaded[path]
