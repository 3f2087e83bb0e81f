"""Encoding whole texts with a public tokenizer file, word by word.

word_bpe_49k drops white space and never joins over it, so a text's ids are those of its
words (runs without ASCII white space), one after the other. New words go through the
tokenizer's own normaliser, splitter and model, many at a time; their ids are remembered in a
memory of bounded size, out of which words go that weren't met for the longest."""

from __future__ import annotations

import os
import string
from array import array
from collections.abc import Iterator

import numpy as np

from .common import kept, words

TOKENIZER = "word_bpe_49k.json"
#: Texts that are encoded together, and new words that the tokenizer gets together.
TEXTS_AT_ONCE, WORDS_AT_ONCE = 500, 1000
_MARKS = string.punctuation.encode()


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class WordEncoder:
    """ids() and counts() of texts; None counts as the empty text."""

    def __init__(self, path: str, most_words: int = 450_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer, self.most = Tokenizer.from_file(path), most_words
        self.normalize, self.split, self.tokenize = self.tokenizer.normalizer.normalize_str, self.tokenizer.pre_tokenizer.pre_tokenize_str, self.tokenizer.model.tokenize
        self.dtype = np.dtype("<u2") if self.tokenizer.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        #: words met lately, and those met before: each holds at most about most_words
        self.known, self.older = {}, {}

    def _bytes(self, ids: list[int]) -> bytes:
        return array("H" if self.dtype.itemsize == 2 else "I", ids).tobytes()

    def _alone(self, word: bytes) -> bytes:
        return self._bytes(self.tokenizer.encode(word.decode(), add_special_tokens=False).ids)

    def _learn(self, found: set[bytes]) -> None:
        """Make all these words known."""
        new = {w for w in found if w not in self.known}  # a difference would walk through all that is known
        if len(self.known) + len(new) > self.most:
            self.known, self.older, new = {}, self.known, found
        again = {w for w in new if w in self.older}
        self.known.update((w, self.older[w]) for w in again)
        new = new - again
        # the strings of special tokens are found before all else
        alone = {w for w in new if b"<|" in w}
        self.known.update((w, self._alone(w)) for w in alone)
        # marks behind a letter are a piece of their own, and A-Z counts as a-z
        whole, stems, marks = list(new - alone), [], []
        for w in whole:
            stem = w.rstrip(_MARKS)
            if len(stem) == len(w) or not stem[-1:].isalpha():
                stem = w
            marks.append(w[len(stem) :])
            stems.append(stem.lower() if w.isascii() else stem)
        missing = [w for w in {*stems, *marks} if w and w not in self.known]
        for at in range(0, len(missing), WORDS_AT_ONCE):
            part = missing[at : at + WORDS_AT_ONCE]
            self.known.update(zip(part, self._together(part), strict=True))
        ids = self.known.__getitem__
        self.known.update(zip(whole, [ids(x) + ids(y) if y else ids(x) for x, y in zip(stems, marks, strict=True)], strict=True))

    def _together(self, part: list[bytes]) -> list[bytes]:
        """Ids of words without ASCII white space and special tokens."""
        normal = self.normalize(b" ".join(part).decode()).split(" ")
        if len(normal) != len(part):  # some word holds other white space
            return [self._alone(w) for w in part]
        # ASCII letters are one piece, whose bytes are its letters
        out = {w: [t.id for t in self.tokenize(w)] for w in normal if w.isascii() and w.isalpha()}
        rest = list(dict.fromkeys(w for w in normal if w not in out))
        out.update((w, []) for w in rest)
        ends, at, end = np.cumsum([len(w) + 1 for w in rest]).tolist(), -1, 0
        for piece, (start, _) in self.split(" ".join(rest)):
            while start >= end:
                at += 1
                end = ends[at]
            out[rest[at]] += [t.id for t in self.tokenize(piece)]
        return [self._bytes(out[w]) for w in normal]

    def _joined(self, part: list[bytes]) -> bytes:
        try:
            return b"".join(map(self.known.__getitem__, part))
        except KeyError:
            self._learn(set(part))
            return b"".join(map(self.known.__getitem__, part))

    def encode(self, text: str | None) -> bytes:
        """All ids of the text as little-endian unsigned integers of self.dtype."""
        return b"".join(map(self._joined, words((text or "").encode())))

    def encode_batch(self, texts: list[str | None]) -> Iterator[bytes]:
        """As encode() of each text; the new words of some hundred short texts are learned together."""
        for at in range(0, len(texts), TEXTS_AT_ONCE):
            part = texts[at : at + TEXTS_AT_ONCE]
            split = [t.encode().split() if t and len(t) < 50_000 else None for t in part]
            self._learn(set().union(*filter(None, split)))
            for w, t in zip(split, part, strict=True):
                yield self.encode(t) if w is None else self._joined(w)


def encoder(path: str) -> WordEncoder:
    """The process's encoder of a file: later tasks of a worker find the words of earlier ones."""
    return kept(("encoder", path), lambda: WordEncoder(path))
