"""Token ids of whole texts by a public tokenizer file, remembering the ids of pieces seen before."""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterable
from functools import lru_cache

import numpy as np
from tokenizers import Tokenizer

CACHE_LIMIT = 1_200_000  # pieces remembered per Python worker, about 200 bytes each
# Both supported tokenizers cut between a solid character and the single blank or line end that follows.
_PIECES = re.compile(r"[ \n]?[^ \n]+")
# Runs of white space, white space at an end and other white space or control characters can be part of one token:
# such a text is encoded whole.
_ODD = re.compile("[\x00-\x09\x0b-\x1f\x7f-\xa0\u1680\u180e\u2000-\u200f\u2028-\u202f\u205f-\u206f\u3000\ufeff]")
_MARKS, _LATIN_END = ".,;:!?", "\u0250"
# Below this end nothing combines and every character but U+0130 has one lower case, of the same kind: runs of letters there are tokens of
# their own, whatever stands next to them, once case and white space do not count.
_NOT_LATIN = re.compile(f"[\u0130{_LATIN_END}-\U0010ffff]")
_LETTERS = "".join(sorted({x for c in map(chr, range(0x250)) if c.isalpha() and c != "\u0130" for x in (c, c.lower())}))
_RUNS = re.compile(f"[{_LETTERS}]+|[^ \n{_LETTERS}][^ \n]*")
_TOGETHER = 256  # words given to the tokenizer in one text
_encoders: dict[str, "PieceEncoder"] = {}


@lru_cache(maxsize=4096)
def _stays_letter(c: str) -> bool:
    """Whether normalising and lower-casing leave letters only, so that a mark behind is a token of its own."""
    return unicodedata.normalize("NFC", c).lower().isalpha()


def _irregular(text: str) -> bool:
    return (text[:1] in (" ", "\n") or text[-1:] in (" ", "\n") or "  " in text or "\n\n" in text or " \n" in text
            or "\n " in text or _ODD.search(text) is not None) if text else True


class PieceEncoder:
    """``encode`` equals the tokenizer's ``encode(text, add_special_tokens=False)`` as little-endian unsigned 32-bit ids."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        # lower case and white space do not count: words alone have the same ids
        self.lowers = self._encode("Aé Á").tobytes() == self._encode("aé").tobytes() + self._encode("á").tobytes()
        # the same vocabulary and merges for words that need no normalising and no cutting
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        bytes_only = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
        lines = {"type": "Split", "pattern": {"String": "\n"}, "behavior": "Isolated", "invert": False}
        units = {"type": "Sequence", "pretokenizers": [lines, bytes_only]}
        self.plain = Tokenizer.from_str(json.dumps(spec | {"normalizer": None, "pre_tokenizer": units}))
        self.line_end, = self.plain.encode("\n", add_special_tokens=False).ids
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _encode(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4")

    def _parts(self, piece: str) -> tuple[str, str]:
        """The word without a closing mark and the mark, always separate tokens. Case and blanks go where they do not count."""
        piece = piece.lstrip(" \n") if self.lowers else piece
        word, mark = piece, ""
        if piece[-1] in _MARKS and piece[-2:-1].isalpha() and _stays_letter(piece[-2]):
            word, mark = piece[:-1], piece[-1]
        low = word.lower() if self.lowers and max(word) < _LATIN_END else word
        return (low if len(low) == len(word) else word), mark

    def _learn(self, pieces: list[str]) -> None:
        """Ids of new pieces; of each different word only once."""
        parts = [self._parts(p) for p in pieces]
        known = self.known
        self._encode_words(self._unseen({x for p in parts for x in p if x}))
        known[""] = b""
        known.update((piece, known[word] + known[mark]) for piece, (word, mark) in zip(pieces, parts, strict=True))

    def _unseen(self, pieces: set[str]) -> list[str]:
        """Pieces without ids yet; those remembered from before the last turn come back. A set is not taken apart by the keys of a
        dictionary: Python would walk through all of these."""
        known, older, new = self.known, self.older, []
        for p in pieces:
            if p not in known:
                if p in older:
                    known[p] = older[p]
                else:
                    new.append(p)
        return new

    def _encode_words(self, words: list[str]) -> None:
        """Words of Latin letters, with the blank before them where it counts, are one unit of the tokenizer; others go through all of it."""
        simple, other = [], []
        for w in words:
            letters = w if self.lowers else w.removeprefix(" ")
            plain = letters.isalpha() and max(w) < _LATIN_END and not (self.lowers and letters != letters.lower())
            (simple if plain else other).append(w)
        for at in range(0, len(simple), _TOGETHER):
            part = simple[at:at + _TOGETHER]
            ids = np.array(self.plain.encode_batch_fast(["\n".join(part)], add_special_tokens=False)[0].ids, dtype="<u4")
            ends, raw = np.flatnonzero(ids == self.line_end), ids.tobytes()  # no letter is part of that token
            starts = [0, *(4 * ends + 4).tolist()]
            self.known.update((w, raw[a:b]) for w, a, b in zip(part, starts, [*(4 * ends).tolist(), len(raw)], strict=True))
        found = self.tokenizer.encode_batch_fast(other, add_special_tokens=False)
        self.known.update((w, np.array(e.ids, dtype="<u4").tobytes()) for w, e in zip(other, found, strict=True))

    def encode(self, texts: Iterable[str | None]) -> list[bytes]:
        texts = [t or "" for t in texts]
        pieces, words, mixed = [], set(), set()
        for t in texts:
            if _irregular(t):
                own = None
            elif self.lowers and _NOT_LATIN.search(t) is None:
                words.update(own := _RUNS.findall(t.lower()))
            else:
                mixed.update(own := _PIECES.findall(t))
            pieces.append(own)
        if len(self.known) > CACHE_LIMIT // 2:
            self.known, self.older = {}, self.known
        self._encode_words(self._unseen(words))
        self._learn(self._unseen(mixed))
        known = self.known.__getitem__
        return [self._encode(t).tobytes() if p is None else b"".join(map(known, p)) for t, p in zip(texts, pieces, strict=True)]


def encoder(path: str) -> PieceEncoder:
    """One encoder per worker process and file."""
    if path not in _encoders:
        _encoders[path] = PieceEncoder(path)
    return _encoders[path]


def in_batches(texts: list[str | None], limit: int = 1 << 20) -> Iterable[list[str | None]]:
    """Stretches of about ``limit`` characters."""
    part, size = [], 0
    for text in texts:
        part.append(text)
        size += len(text or "")
        if size >= limit:
            yield part
            part, size = [], 0
    if part:
        yield part
