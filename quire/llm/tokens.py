"""Token ids of whole texts, word by word, with a bounded cache in each Python worker.

Both tokenizers split a text at white space before any merge, so the ids of a text are the
ids of its chunks in order; natural text repeats its chunks, and each is encoded once by
the ``tokenizers`` library. What is cached is bounded, what is encoded is not.
"""

from __future__ import annotations

import os
import re
import unicodedata
from array import array

import regex

#: The characters that the pre-tokenizers' ``\s`` takes as white space.
SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"

BYTE_VOCABULARY = "byte_bpe_50k.json"
WORD_VOCABULARY = "word_bpe_49k.json"
#: Chunks that a worker remembers, and the longest chunk that is worth remembering.
CACHED_CHUNKS = 500_000
CACHED_LENGTH = 40
#: The same for pieces of plain texts, of which there are fewer, and for words of other texts.
CACHED_PIECES = 200_000
CACHED_WORDS = 200_000

_BESIDE_SPACE = re.compile(f" [{SPACE}]|[{SPACE}] ")
_CHUNK = re.compile(f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+")
#: The two pre-tokenizers' splits, with their white space written out.
_SUFFIXES = "'s|'t|'re|'ve|'m|'ll|'d"
BYTE_SPLIT = regex.compile(rf"{_SUFFIXES}| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
WORD_SPLIT = regex.compile(rf"{_SUFFIXES}|\p{{L}}+|\p{{N}}|[^{SPACE}\p{{L}}\p{{N}}]+")
#: Characters whose classes and lower case no Unicode version changes, and which normalisation leaves alone.
_PLAIN = re.compile("[\t\n\r -~\xa1-\u012f]*")
#: The same splits where all characters are ASCII.
_ASCII_BYTE_SPLIT = re.compile(rf"{_SUFFIXES}| ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+", re.ASCII)
_ASCII_WORD_SPLIT = re.compile(rf"{_SUFFIXES}|[A-Za-z]+|[0-9]|[^\sA-Za-z0-9]+", re.ASCII)
#: The word split where all characters are plain.
_LATIN_LETTERS, _LATIN_NUMBERS = ("".join(c for c in map(chr, range(0xA1, 0x130)) if unicodedata.category(c)[0] == kind) for kind in "LN")
_PLAIN_WORD_SPLIT = re.compile(rf"{_SUFFIXES}|[A-Za-z{_LATIN_LETTERS}]+|[0-9{_LATIN_NUMBERS}]|[^\t\n\r A-Za-z0-9{_LATIN_LETTERS}{_LATIN_NUMBERS}]+")
_CONTROL = re.compile("[\x1c-\x1f]")
_ASCII_WORD = re.compile("[^\t-\r ]+")


def vocabulary(name: str) -> str:
    """Where a public vocabulary file is on this machine. A path is returned as it is."""
    if os.sep in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def chunks(text: str) -> tuple[str, list[str]]:
    """A text as a first chunk and the words after it, each standing for " " + word.

    Joining the ids of the chunks gives the ids of the text under the byte-level
    pre-tokenizer: a chunk starts where white space follows something else, which is
    always a boundary. Only for texts in which no space stands beside other white space.
    """
    first, *rest = text.split(" ")
    return first, rest


class Remembered(dict):
    """Chunk -> what ``make`` gives for it; stops growing at ``most``."""

    def __init__(self, make, most: int = CACHED_CHUNKS):
        self.make, self.most = make, most

    def __missing__(self, chunk):
        value = self.make(chunk)
        if len(self) < self.most and len(chunk) <= CACHED_LENGTH:
            self[chunk] = value
        return value


class ByChunk:
    """Bytes of a text, joined from what ``make(chunk)`` gives for its chunks."""

    def __init__(self, make):
        self.spaced = Remembered(lambda word: make(" " + word))
        self.whole = Remembered(make)

    def __call__(self, text: str) -> bytes:
        if _BESIDE_SPACE.search(text):
            return b"".join(map(self.whole.__getitem__, _CHUNK.findall(text)))
        first, rest = chunks(text)
        return self.whole[first] + b"".join(map(self.spaced.__getitem__, rest))


class ByteIds(ByChunk):
    """Little-endian unsigned 32-bit ids under a byte-level vocabulary file."""

    def __init__(self, name: str = BYTE_VOCABULARY):
        super().__init__(encoder(loaded(name), BYTE_SPLIT, _ASCII_BYTE_SPLIT, lower=False))


class WordIds:
    """The same under a vocabulary that drops white space and folds case.

    What is plain and has no special string, a text or a word of another text, is split here, and its pieces are
    remembered: words with what stands beside them are many more. The library has all other words."""

    def __init__(self, name: str = WORD_VOCABULARY):
        library = loaded(name)
        encode = encoder(library, WORD_SPLIT, _ASCII_WORD_SPLIT, lower=True)
        merge, letters = library.model.tokenize, byte_letters()
        self.specials = special_strings(library)
        self.known = Remembered(lambda word: self.of_plain(word) if self.is_plain(word) else encode(word), CACHED_WORDS)
        self.pieces = Remembered(lambda p: array("I", [t.id for t in merge(p.encode().decode("latin-1").translate(letters))]).tobytes(), CACHED_PIECES)

    def is_plain(self, text: str) -> bool:
        return bool(_PLAIN.fullmatch(text)) and not any(map(text.__contains__, self.specials))

    def of_plain(self, text: str) -> bytes:
        split = _ASCII_WORD_SPLIT if text.isascii() else _PLAIN_WORD_SPLIT
        return b"".join(map(self.pieces.__getitem__, split.findall(text.lower())))

    def __call__(self, text: str) -> bytes:
        if self.is_plain(text):
            return self.of_plain(text)
        words = _ASCII_WORD.findall(text) if _CONTROL.search(text) else text.split()
        return b"".join(map(self.known.__getitem__, words))


def byte_letters() -> dict[int, str]:
    """Byte -> the letter that byte-level vocabulary files write it as: printable ones as they are."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(other)}


def loaded(name: str):
    """The library of a vocabulary file, which neither cuts nor pads."""
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(vocabulary(name))
    library.no_truncation()
    library.no_padding()
    return library


def special_strings(library) -> list[str]:
    return [t.content for t in library.get_added_tokens_decoder().values()]


def encoder(library, split: regex.Pattern, ascii_split: re.Pattern, lower: bool):
    """The library: text -> ids as bytes, without added special tokens.

    Chunks of ASCII or Latin letters skip the library's offset bookkeeping: they are split here,
    and its model merges the pieces. All else goes through the whole library.
    """
    merge, letters = library.model.tokenize, byte_letters()
    specials = special_strings(library)

    def encode(text: str) -> bytes:
        own = text.lower() if lower else text
        special = any(map(text.__contains__, specials))
        if not special and text.isascii():
            return array("I", [t.id for p in ascii_split.findall(own) for t in merge(p.translate(letters))]).tobytes()
        if not special and _PLAIN.fullmatch(text):
            return array("I", [t.id for p in split.findall(own) for t in merge(p.encode().decode("latin-1").translate(letters))]).tobytes()
        return array("I", library.encode(text, add_special_tokens=False).ids).tobytes()

    return encode


_WORKERS_OWN: dict = {}


def per_worker(kind, *args):
    """An object that a Python worker keeps between its tasks, until it is asked for another one: what one
    operator remembers is let go when the next one begins."""
    key = (kind, args)
    if key not in _WORKERS_OWN:
        _WORKERS_OWN.clear()
        _WORKERS_OWN[key] = kind(*args)
    return _WORKERS_OWN[key]
