"""Token ids of whole texts with a public tokenizer file."""

from __future__ import annotations

import functools
import json
import os
import struct

import numpy as np

#: Neither letters, digits, white space nor apostrophes: they follow a word as one part of their own.
_MARKS = ".,;:!?*#%&$()[]{}<>/|+=_-"
#: Letters from here on are left to the tokenizer.
_BEYOND = "\u0250"
_PACK = [struct.Struct(f"<{n}I").pack for n in range(16)]


class _Loose(Exception):
    """A piece that white space ties to its neighbour."""


class Encoder:
    """Ids of a text, exactly those of ``Tokenizer.encode(text, add_special_tokens=False)``.

    A byte-level tokenizer of this kind never joins two words over a single space that has no white space beside it.
    So a text is cut there, and the ids of a piece are kept for the next time, in a memo of bounded size (about 80 MB), of which
    :meth:`forget` drops the older half at the end of a task. Other tokenizers, and texts with the string of an added token, are encoded whole.
    """

    def __init__(self, path: str, memo_entries: int = 250_000) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._model = self._tokenizer.model
        spec = json.loads(self._tokenizer.to_str())
        self._added = [t["content"] for t in spec.get("added_tokens", [])]
        pre = spec.get("pre_tokenizer") or {}
        self.byte_level = (
            not spec.get("normalizer") and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
        )
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in printable]
        of_byte = {b: chr(b) for b in printable} | {b: chr(256 + k) for k, b in enumerate(others)}
        self._space = of_byte[32]
        self._letters = {c: "".join(of_byte[b] for b in chr(c).encode()) for c in range(0x80, ord(_BEYOND))}
        self._marks: dict[str, bytes] = {}
        self._direct = self.byte_level
        self._memo = _Memo(self, memo_entries)
        self._line_feed = self._library("\n")
        self._direct = self.byte_level and len(self._line_feed) == 4 and self._piece("Ñandú,;") == self._library(" Ñandú,;")

    @property
    def id_bytes(self) -> int:
        """Bytes that hold any id of this vocabulary."""
        return 2 if self._tokenizer.get_vocab_size() <= 1 << 16 else 4

    @functools.cached_property
    def byte_lengths(self) -> np.ndarray:
        """Bytes of text behind each id; right for byte-level tokenizers."""
        lengths = np.zeros(max(self._tokenizer.get_vocab().values()) + 1, np.int64)
        for token, i in self._tokenizer.get_vocab().items():
            lengths[i] = len(token.encode()) if token in self._added else len(token)
        return lengths

    def library_spans(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids, and character spans as the tokenizer itself gives them."""
        found = self._tokenizer.encode(text, add_special_tokens=False)
        return np.array(found.ids, "<u4"), np.array(found.offsets, np.int64).reshape(-1, 2)

    def forget(self) -> None:
        """Give half of the memo's room back, so that a worker that waits for its next task holds less."""
        self._memo.forget()

    def ids(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned 32-bit integers; none for null or empty text."""
        if not text:
            return b""
        if not self.byte_level or any(t in text for t in self._added):
            return self._library(text)
        first, *rest = text.split(" ")
        memo = self._memo
        try:
            if rest and (not first or first[-1].isspace()):
                raise _Loose
            # the start of a text is a line's start without the line feed before it
            begun = memo["\n" + first][4:] if first else b""
            return begun + b"".join(map(memo.__getitem__, rest))
        except _Loose:
            return self._merged(text)

    def _merged(self, text: str) -> bytes:
        chunks: list[str] = []
        for k, piece in enumerate(text.split(" ")):
            tied = not piece or piece[0].isspace() or not chunks or chunks[-1][-1:].isspace() or not chunks[-1]
            if k and tied:
                chunks[-1] += " " + piece
            else:
                chunks.append(" " + piece if k else piece)
        return b"".join(self._memo[c[1:]] if c[:1] == " " and not (c[1:2].isspace() or c[-1:].isspace()) and len(c) > 1 else self._library(c) for c in chunks)

    def _library(self, text: str) -> bytes:
        return np.array(self._tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _piece(self, piece: str) -> bytes:
        """Ids of a space and ``piece``, or of a piece that begins with a line feed.

        A plain word, with or without marks behind it, needs no splitting, and a line feed between two characters that
        are no white space is a part of its own.
        """
        if "\n" in piece and self._direct and not any(not p or p[0].isspace() or p[-1].isspace() for p in piece.removeprefix("\n").split("\n")):
            first, *lines = piece.split("\n")
            if first or len(lines) > 1:
                return (self._memo[first] if first else b"") + b"".join([self._memo["\n" + line] for line in lines])
            word = lines[0].rstrip(_MARKS)
            if word.isalpha() and (word.isascii() or max(word) < _BEYOND):
                return self._line_feed + self._model_ids(word if word.isascii() else word.translate(self._letters)) + self._mark_ids(lines[0][len(word) :])
            return self._library(piece)
        word = piece.rstrip(_MARKS)
        if self._direct and word.isalpha() and (word.isascii() or max(word) < _BEYOND):
            if len(word) == len(piece):
                return self._model_ids(self._space + (word if word.isascii() else word.translate(self._letters)))
            return self._memo[word] + self._mark_ids(piece[len(word) :])
        if not piece or piece[0].isspace() or piece[-1].isspace():
            raise _Loose
        return self._library(" " + piece)

    def _mark_ids(self, marks: str) -> bytes:
        """Ids of marks behind a word; short ones are kept, of which there are not many."""
        if not marks:
            return b""
        ids = self._marks.get(marks)
        if ids is None:
            ids = self._model_ids(marks)
            if len(marks) <= 2:
                self._marks[marks] = ids
        return ids

    def _model_ids(self, letters: str) -> bytes:
        ids = [t.id for t in self._model.tokenize(letters)]
        return _PACK[len(ids)](*ids) if len(ids) < 16 else np.array(ids, "<u4").tobytes()


class _Memo(dict):
    """The pieces of two spans of at most ``entries`` pieces each; those still in use live on."""

    def __init__(self, encoder: Encoder, entries: int) -> None:
        self._encode, self._entries, self._older = encoder._piece, entries, {}

    def __missing__(self, piece: str) -> bytes:
        ids = self._older.get(piece)
        if ids is None:
            ids = self._encode(piece)
        if len(self) >= self._entries:
            self._older = dict(self)
            self.clear()
        self[piece] = ids
        return ids

    def forget(self) -> None:
        self._older = {}


@functools.lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    """One encoder per worker process and tokenizer file."""
    return Encoder(path)


def default_tokenizer() -> str:
    """The public byte-level vocabulary of the queries."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
