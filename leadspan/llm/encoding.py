"""Encoding with the word-end BPE tokenizer, word by word.

Its pre-tokenizer never lets a piece span white space, so a text's ids are the ids of its words one after the other, and
a word's ids can be remembered. Words of lower-case Latin letters with at most one final stop or comma go straight to
the BPE model, other words of Latin-1 characters by the pieces they are cut into; words with other characters go through the
whole tokenizer, and so do whole texts that hold an added token's literal.
"""

from __future__ import annotations

import os
import re
from array import array
from functools import lru_cache

import numpy as np

REMEMBERED_WORDS = 500_000  # per Python worker
LETTERS = "abcdefghijklmnopqrstuvwxyzßàáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿ"
PLAIN = re.compile(f"([{LETTERS}]+)([.,]?)")


class WordEncoder:
    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark runs one worker for each core
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content.lower() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.dtype = np.dtype("<u2") if self.tokenizer.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        # without letters, so that texts need no lower-casing to be searched for it
        self.mark = re.match("[^a-z]*", os.path.commonprefix(self.added))[0]
        self.code = "H" if self.dtype.itemsize == 2 else "I"
        self.known: dict[str, bytes] = {"": b""}
        self.pieces: dict[str, bytes] = {}
        self.bpe = self.tokenizer.model.tokenize
        as_bytes = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.spelled = str.maketrans({c: as_bytes.pre_tokenize_str(c)[0][0] for c in LETTERS})
        self.stops = {c: self._whole(c) for c in ".,"} | {"": b""}

    def _packed(self, ids: list[int]) -> bytes:
        return array(self.code, ids).tobytes()

    def _piece(self, spelled: str) -> bytes:
        return self._packed([t.id for t in self.bpe(spelled)])

    def _whole(self, word: str) -> bytes:
        return self._packed(self.tokenizer.encode(word, add_special_tokens=False).ids)

    def _cut(self, word: str) -> bytes:
        """A lower-case Latin-1 word, whose normal form it is itself, piece by piece; numbers and signs recur."""
        out = []
        for piece, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(word):
            ids = self.pieces.get(piece)
            if ids is None:
                ids = self._piece(piece)
                if len(self.pieces) < REMEMBERED_WORDS:
                    self.pieces[piece] = ids
            out.append(ids)
        return b"".join(out)

    def _word(self, word: str, latin: bool) -> bytes:
        plain = PLAIN.fullmatch(word)
        if plain is None:
            found = self._cut(word) if latin else self._whole(word)
        else:
            stem, stop = plain.groups()
            found = self.known.get(stem) if stop else None
            if found is None:
                found = array(self.code, [t.id for t in self.bpe(stem if stem.isascii() else stem.translate(self.spelled))]).tobytes()
            if stop:
                found += self.stops[stop]
        if len(self.known) < REMEMBERED_WORDS:
            self.known[word] = found
        return found

    def encode(self, text: str | None) -> bytes:
        """Ids as little-endian integers of ``dtype``."""
        text = text or ""
        if self.mark in text and any(t in lower for lower in [text.lower()] for t in self.added):
            return self._whole(text)
        try:
            text.encode("latin-1")
            text, latin = text.lower(), True  # for these characters what the tokenizer does itself
        except UnicodeEncodeError:
            latin = False
        words = text.replace("\n", " ").split(" ")
        out = list(map(self.known.get, words))
        at = -1
        for _ in range(out.count(None)):
            at = out.index(None, at + 1)
            out[at] = self._word(words[at], latin)
        return b"".join(out)


@lru_cache(maxsize=2)
def encoder(path: str) -> WordEncoder:
    """One encoder for each Python worker, kept between tasks."""
    return WordEncoder(path)
