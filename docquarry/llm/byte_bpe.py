"""Byte-level BPE through a sentencepiece model that is written directly from the vocabulary.

A file of ranks becomes a model of sentencepiece's BPE kind: each token is a piece, its bytes
mapped one to one to characters, with the negative rank as score, so that the piece of the
smallest rank is joined first; text is taken as it is (identity normalisation, no prefix, no
escaped spaces). Ids are ranks. A text is split into pre-tokens by a pattern, each is encoded by
itself, and ids are decoded by mapping pieces back to bytes."""

from __future__ import annotations

import base64
import functools
import struct
from array import array
from collections.abc import Callable, Iterator
from itertools import islice

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from .common import kept

RANKS = "byte_bpe_50k.tiktoken"
#: Characters of text whose pre-tokens are held at a time, and bytes of values that are worked on together.
PART, BATCH = 1 << 20, 1 << 23
#: Bytes of pre-tokens that a process remembers twice over, and the longest of them.
MEMORY, LONGEST = 40 << 20, 64


@functools.cache
def byte_characters() -> list[str]:
    """The character of each byte: printable Latin-1 is itself, others follow from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = iter(range(0x100, 0x200))
    return [chr(b if b in plain else next(other)) for b in range(256)]


def read_ranks(path: str) -> list[bytes]:
    """The tokens of a file of lines `base64 rank`, by rank; ranks must have no gaps."""
    with open(path, "rb") as f:
        found = sorted((int(rank), base64.b64decode(token)) for token, rank in map(bytes.split, filter(bytes.strip, f)))
    if [r for r, _ in found] != list(range(len(found))):
        raise ValueError("ranks must count from 0 without gaps")
    return [t for _, t in found]


def _number(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _field(tag: int, value: bytes | int | float) -> bytes:
    """A protocol buffer field: text or message, integer, or 32-bit float."""
    if isinstance(value, bytes):
        return _number(tag << 3 | 2) + _number(len(value)) + value
    if isinstance(value, float):
        return _number(tag << 3 | 5) + struct.pack("<f", value)
    return _number(tag << 3) + _number(value)


def serialise(tokens: list[bytes]) -> bytes:
    """A sentencepiece model of these tokens; the unknown piece, which can't occur, comes last."""
    # Field numbers and kinds of sentencepiece's published model format.
    pieces, trainer, normaliser = 1, 2, 3
    piece, score, kind, unknown = 1, 2, 3, 2
    model_type, bpe, vocabulary_size, unknown_id = 3, 2, 4, 40
    name, dummy_prefix, extra_space, escape_space = 1, 3, 4, 5
    letters = byte_characters()
    out = [_field(pieces, _field(piece, "".join(letters[b] for b in t).encode()) + _field(score, -float(rank))) for rank, t in enumerate(tokens)]
    out.append(_field(pieces, _field(piece, b"<unk>") + _field(score, -float(len(tokens))) + _field(kind, unknown)))
    out.append(_field(trainer, _field(model_type, bpe) + _field(vocabulary_size, len(tokens) + 1) + _field(unknown_id, len(tokens))))
    out.append(_field(normaliser, _field(name, b"identity") + _field(dummy_prefix, 0) + _field(extra_space, 0) + _field(escape_space, 0)))
    return b"".join(out)


class Codec:
    """encode() texts to little-endian unsigned 32-bit ids, decode() these to bytes."""

    def __init__(self, path: str, pattern: str):
        import regex
        import sentencepiece

        tokens = read_ranks(path)
        self.model = sentencepiece.SentencePieceProcessor(model_proto=serialise(tokens))
        self.split = regex.compile(pattern)
        self.letters = byte_characters()
        back = {c: b for b, c in enumerate(self.letters)}
        self.tokens = [bytes(back[c] for c in self.model.id_to_piece(i)) for i in range(len(tokens))]
        #: pre-tokens met lately and those met before, with their ids, and the bytes of the former
        self.known, self.older, self.held = {}, {}, 0

    def _learn(self, new: set[str]) -> dict[str, bytes]:
        """Ids of all these pre-tokens; the short ones are remembered."""
        found = {w: self.older[w] for w in new if w in self.older}
        fresh = [w for w in new if w not in found]
        mapped = [w if w.isascii() and w.isalpha() else w.encode("latin-1" if w.isascii() else "utf-8").decode("latin-1").translate(self.letters) for w in fresh]
        found.update((w, array("I", ids).tobytes()) for w, ids in zip(fresh, self.model.encode(mapped, num_threads=1), strict=True))
        short = {w: x for w, x in found.items() if len(w) <= LONGEST}
        size = sum(2 * len(w) + len(x) + 160 for w, x in short.items())
        if self.held + size > MEMORY:
            self.known, self.older, self.held = {}, self.known, 0
        self.known.update(short)
        self.held += size
        return found

    def _parts(self, text: str) -> Iterator[list[str]]:
        """The pre-tokens of a long text, a part at a time."""
        found = self.split.finditer(text)
        while part := [m[0] for m in islice(found, PART // 4)]:
            yield part

    def _ids(self, split: list[list[str]]) -> list[bytes]:
        """Ids of several lists of pre-tokens, whose new ones go to the model together."""
        try:
            return [b"".join(map(self.known.__getitem__, part)) for part in split]
        except KeyError:
            words = set().union(*split)
            own = {w: self.known[w] for w in words if w in self.known}
            own.update(self._learn(words - own.keys()))
            return [b"".join(map(own.__getitem__, part)) for part in split]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text; texts of about a PART are worked on together."""
        out, split, held = [], [], 0
        for text in texts:
            text = text or ""
            if len(text) > PART:
                out += self._ids(split)
                out.append(b"".join(x for part in self._parts(text) for x in self._ids([part])))
                split, held = [], 0
                continue
            split.append(self.split.findall(text))
            held += len(text)
            if held > PART:
                out += self._ids(split)
                split, held = [], 0
        return out + self._ids(split)

    def decode(self, ids: list[bytes | None]) -> list[bytes]:
        return [b"".join(map(self.tokens.__getitem__, array("I", x or b""))) for x in ids]


def ranks_path(name: str = RANKS) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def _codec(path: str, pattern: str) -> Codec:
    return kept(("byte_bpe", path, pattern), lambda: Codec(path, pattern))


def _column(rows: DataFrame, source: str, name: str, work: Callable) -> DataFrame:
    """All columns and one more, made from one of them, some rows of bounded bytes at a time."""
    if name in rows.columns:
        raise ValueError(f"there is a column {name} already")
    at = rows.columns.index(source)

    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        several = work()
        for batch in found:
            sizes = pc.fill_null(pc.binary_length(batch.column(at)), 0).to_pylist()
            start, held = 0, 0
            for n, size in enumerate(sizes, 1):
                held += size
                if held >= BATCH or n == len(sizes):
                    part = batch.slice(start, n - start)
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(several(part.column(at).to_pylist()), pa.binary())], [*part.schema.names, name])
                    start, held = n, 0

    schema = rows.select("*", F.lit(None).cast("binary").alias(name)).schema
    return rows.mapInArrow(batches, schema)


def encoded(docs: DataFrame, text: str = "text", path: str | None = None, pattern: str | None = None, ids: str = "ids") -> DataFrame:
    """All columns and ids: the text's token ids as little-endian unsigned 32-bit integers.

    A null text counts as empty, an empty one has no ids. Very long texts are split a part at a
    time; a pre-token of any length goes to the model whole. Strings of special tokens are
    ordinary text. Repeated rows are encoded each, columns of any name pass through (but for one
    named as the result, which is refused), and an empty table gives no rows."""
    path, pattern = path or ranks_path(), pattern or default_pattern()
    return _column(docs, text, ids, lambda: _codec(path, pattern).encode)


def decoded(rows: DataFrame, ids: str = "ids", path: str | None = None, pattern: str | None = None, data: str = "decoded") -> DataFrame:
    """All columns and decoded: the bytes of the ids. Null ids give no bytes; ids that the
    vocabulary doesn't have raise an error."""
    path, pattern = path or ranks_path(), pattern or default_pattern()
    return _column(rows, ids, data, lambda: _codec(path, pattern).decode)


def byte_bpe_digests(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """key, n_tokens, ids_sha256, decoded_sha256 of each row, whose ids are decoded again.

    Rows without a key and repeated rows count each."""
    rows = encoded(docs.select(F.col(key), F.col(text).cast("string").alias("_text")), "_text", path, pattern, "_ids").drop("_text")
    rows = decoded(rows, "_ids", path, pattern, "_bytes")
    return rows.select(f"`{key}`", F.expr("cast(octet_length(_ids) div 4 as long)").alias("n_tokens"), F.sha2("_ids", 256).alias("ids_sha256"), F.sha2("_bytes", 256).alias("decoded_sha256"))
