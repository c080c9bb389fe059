"""Token ids of whole texts by the ``tokenizers`` library, with a bounded cache of chunks.

In the two public vocabularies no token reaches over white space: one drops
white space, the other joins a single leading blank to the word behind it.  So
the ids of a text are the ids of its chunks one after the other, and a chunk
that was met before need not be encoded again.  A plain word goes straight to
the library's BPE model, any other chunk through the whole tokenizer, and a
text with characters outside the plain ranges or with a control string of the
vocabulary, which the library takes as one token, goes there uncut.
"""

from __future__ import annotations

import os
import re
from array import array
from functools import lru_cache

WORD = "word_bpe_49k.json"
BYTE = "byte_bpe_50k.json"
CACHED_CHUNKS = 600_000  # of one generation; there are two
FEWER_CHUNKS = 300_000  # for stages whose workers hold more than texts and ids
# Printable ASCII, tab, newline, blank, and the letters of Latin-1 and Latin
# Extended A (but dotted I), none of which combine with a neighbour.
_OTHER = re.compile("[^\t\n\x20-\x7eÀ-ÖØ-öø-įı-ſ]")
_PIECES = re.compile(r"\s*\S+|\s+")
_PLAIN = re.compile(r"( ?[a-zA-ZÀ-ÖØ-öø-įı-ſ]+)([.,;:!?]*)")


def vocabulary_path(name: str) -> str:
    """Where the file of a public tokenizer lies; a path is taken as it is."""
    if os.path.sep in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_letters() -> dict[int, str]:
    """The letter that byte-level BPE writes for each byte: printable ones stand
    for themselves, the others follow from code point 256 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}


class _Chunks(dict):
    """Ids of chunks as little-endian bytes.  When it is full it becomes the
    older generation, from which chunks that come again move over."""

    def __init__(self, encode, most: int):
        self.encode, self.most, self.older = encode, most, {}

    def __missing__(self, chunk: str) -> bytes:
        ids = self.older.get(chunk)
        if ids is None:
            ids = self.encode(chunk)
        if len(self) >= self.most:
            self.older = self.copy()
            self.clear()
        self[chunk] = ids
        return ids


class Encoder:
    """Encodes texts to little-endian unsigned 32-bit ids.

    The ids are those of ``encode(text, add_special_tokens=False)``, so a control
    string of the vocabulary inside a text is that control token.  Null counts as
    empty, and an empty text has no ids.
    """

    def __init__(self, name: str, cached_chunks: int = CACHED_CHUNKS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary_path(name))
        self.control = [token.content for token in self.tokenizer.get_added_tokens_decoder().values()]
        base = os.path.basename(name)
        self.by_words, self.cached = base == WORD, base in (WORD, BYTE)
        self.model = self.tokenizer.model
        letters = byte_letters()
        self.letters = {b: letters[b] for b in range(256)}
        self.known = _Chunks(self._chunk, cached_chunks)

    def library(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _chunk(self, chunk: str) -> bytes:
        plain = _PLAIN.fullmatch(chunk)
        if plain is None:
            return self.library(chunk)
        word, stop = plain.groups()
        if stop:
            # A word and the stops behind it are encoded apart by both vocabularies.
            return self.known[word] + self.known[stop]
        if self.by_words:
            word = word.lower()
        word = word.encode().decode("latin-1").translate(self.letters)
        return array("I", [token.id for token in self.model.tokenize(word)]).tobytes()

    def _split(self, text: str) -> list[str]:
        if self.by_words:
            return text.split()
        if "  " in text or "\t" in text or " \n" in text or "\n " in text or "\n\n" in text:
            return _PIECES.findall(text)
        # Every white space stands alone: a blank goes to the word behind it, a
        # newline is a chunk of its own.
        return text.replace("\n", " \n ").replace(" ", "\0 ").replace("\0 \n\0 ", "\0\n\0").split("\0")

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if not self.cached or _OTHER.search(text) or any(string in text for string in self.control):
            return self.library(text)
        return b"".join(map(self.known.__getitem__, self._split(text)))


@lru_cache(maxsize=2)
def encoder(name: str, cached_chunks: int = CACHED_CHUNKS) -> Encoder:
    """One encoder a worker process and vocabulary; its cache serves all tasks."""
    return Encoder(name, cached_chunks)
