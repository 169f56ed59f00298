"""Ids from the tokenizers library, asked once per distinct piece of text and cached in the Python worker."""

from __future__ import annotations

import os
import re
from struct import pack

import numpy as np
import public_tokenizers
import regex

#: Cached entries per Python worker; beyond it the cache starts anew, so memory is bounded.
CACHE = 700_000


def _byte_characters() -> dict[int, str]:
    """The character that stands for each byte in a byte-level vocabulary: itself if visible, else one from 256 on."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(visible)]
    return {b: chr(b) for b in visible} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class TokenizerCache:
    """Encodes whole texts as ``Tokenizer.encode(text, add_special_tokens=False)`` does with the library's own settings.

    A text is cut only where the library's own splitting would cut it as well: before a space and around a line break
    with no other white space beside them, and before a full stop or comma that follows a letter or digit. Texts where
    that isn't sure or that hold an added token's content, and pieces with characters beyond Latin-1, go to the library
    undivided; other pieces go to its model.
    """

    def __init__(self, name: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(public_tokenizers.path(name))
        # All are matched in the text as given, before any normalisation.
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.keeps_white = not name.startswith("word_")
        pattern = public_tokenizers.PATTERN if self.keeps_white else r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+"
        self.split = regex.compile(pattern).findall
        self.white = re.compile(r"\s(?:[ \n]|(?<=\n)\s)").search
        self.stops = re.compile(r"[.,](?<![^\W_][.,])").search
        self.characters = _byte_characters()
        self.model = self.tokenizer.model
        self.known: dict[str, bytes] = {}

    def _library(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(x.ids, dtype="<u4").tobytes() for x in found]

    def _chunks(self, text: str) -> list[str] | None:
        if "\0" in text or any([a in text for a in self.added]) or self.keeps_white and self.white(text):
            return None
        if not self.stops(text):
            text = text.replace(".", "\0.").replace(",", "\0,")
        if self.keeps_white:
            return text.replace("\n", "\0\n\0").replace(" ", "\0 ").split("\0")
        return text.replace("\n", "\0").replace(" ", "\0").split("\0")

    def _piece(self, piece: str) -> bytes:
        """Ids of a piece that the library doesn't split."""
        found = self.model.tokenize(piece.encode().decode("latin-1").translate(self.characters))
        return pack(f"<{len(found)}I", *[t.id for t in found])

    def _chunk(self, chunk: str) -> bytes:
        if not chunk:
            return b""
        plain = chunk[1:] if chunk[0] == " " else chunk
        try:
            plain.encode("latin-1")
        except UnicodeEncodeError:
            return self._library([chunk])[0]
        if plain.isalpha():
            return self._piece(chunk if self.keeps_white else chunk.lower())
        if chunk != "\n" and not plain.isprintable():
            return self._library([chunk])[0]
        pieces = self.split(chunk if self.keeps_white else chunk.lower())
        return self._piece(pieces[0]) if len(pieces) == 1 else b"".join([self.known.get(p) or self._piece(p) for p in pieces])

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        known, out = self.known, []
        if len(known) > CACHE:
            known.clear()
        for text in texts:
            chunks = self._chunks(text)
            if chunks is None:
                out.extend(self._library([text]))
                continue
            try:
                out.append(b"".join(map(known.__getitem__, chunks)))
            except KeyError:
                for c in chunks:
                    if c not in known:
                        known[c] = self._chunk(c)
                out.append(b"".join(map(known.__getitem__, chunks)))
        return out


_caches: dict[str, TokenizerCache] = {}


def cached(name: str) -> TokenizerCache:
    if name not in _caches:
        _caches[name] = TokenizerCache(name)
    return _caches[name]
