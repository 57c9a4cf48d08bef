"""Statistics of whole texts for the quality classifier, computed from the bytes of Arrow batches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from tiersift.llm.words import Words, mix, shingle_hashes, text_chunks

FEATURES = (
    "log_words", "log_bytes", "word_length", "upper", "symbols", "exclaims", "stops", "bars", "digits",
    "newlines", "high_bytes", "title_words", "upper_words", "short_words", "long_words", "distinct_words",
    "adjacent_repeats", "commonest_word", "repeated_words", "words_per_line", "repeated_lines", "words_per_stop",
)


def _flags(characters: str) -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    table[list(characters.encode())] = True
    return table


_UPPER = _flags("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_CLASSES = (_flags("#*$%&<>@^~=_"), _flags("!"), _flags(".,;:?"), _flags("|"), _flags("0123456789"), _flags("\n"))
_HIGH = np.arange(256) >= 0xC2


def _per_text(mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
    return (total[offsets[1:]] - total[offsets[:-1]]).astype(float)


def statistics(batch: pa.RecordBatch, text: str = "text") -> np.ndarray:
    """One row of ``FEATURES`` per text; empty and null texts give zeros."""
    parts = []
    for _, _, data, offsets in text_chunks(batch, text):
        words = Words(data, offsets)
        hashes = words.hashes()
        n_bytes, n_words = np.diff(offsets).astype(float), np.diff(words.bounds).astype(float)
        per_byte, per_word = np.maximum(n_bytes, 1), np.maximum(n_words, 1)
        # capitals of Latin-1 in UTF-8: 0xC3 before 0x80..0x9E
        upper = _UPPER[data]
        if len(data) > 1:
            upper[1:] |= (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E)
        counts = [_per_text(c[data], offsets) for c in _CLASSES]
        starts, ends, bounds = words.starts, words.ends, words.bounds
        size = ends - starts
        caps = np.concatenate([[0], np.cumsum(upper)])
        own_caps = caps[ends] - caps[starts]
        first = np.minimum(starts + 2, ends)
        title = (caps[first] > caps[starts]) & (own_caps == 1)
        shout = own_caps * 2 >= np.maximum(size, 2)
        distinct, repeats, commonest, repeated, lines, same_lines = (np.zeros(len(offsets) - 1) for _ in range(6))
        breaks = np.flatnonzero(data == 0x0A)
        line_of = np.searchsorted(breaks, starts)
        for i in range(len(offsets) - 1):
            low, high = bounds[i], bounds[i + 1]
            if low == high:
                continue
            own = hashes[low:high]
            turns = np.flatnonzero(np.diff(np.sort(own)))
            n = np.diff(np.concatenate([[-1], turns, [len(own) - 1]]))
            distinct[i], commonest[i] = len(n), n.max()
            repeats[i] = (own[1:] == own[:-1]).sum()
            runs = shingle_hashes(own, 5)
            ordered = np.sort(runs)
            twice = ordered[1:][ordered[1:] == ordered[:-1]]
            if len(twice):
                again = np.flatnonzero(np.isin(runs, twice))
                repeated[i] = np.minimum(np.diff(again, append=again[-1] + 5), 5).sum()
            cut = np.flatnonzero(np.diff(line_of[low:high], prepend=-1))
            whole = np.add.reduceat(mix(own), cut)
            lines[i], same_lines[i] = len(cut), len(cut) - len(np.unique(whole))
        per_line = np.maximum(lines, 1)
        parts.append(np.column_stack([
            np.log1p(n_words), np.log1p(n_bytes), _spans(size, bounds) / per_word, _per_text(upper, offsets) / per_byte,
            *[c / per_byte for c in counts], _per_text(_HIGH[data], offsets) / per_byte,
            _spans(title, bounds) / per_word, _spans(shout, bounds) / per_word, _spans(size <= 3, bounds) / per_word,
            _spans(size >= 14, bounds) / per_word, distinct / per_word, repeats / per_word, commonest / per_word,
            repeated / per_word, np.log1p(n_words / per_line), same_lines / per_line,
            np.log1p(n_words / np.maximum(counts[2], 1))]))
    return np.concatenate(parts) if parts else np.zeros((0, len(FEATURES)))


def _spans(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0.0], np.cumsum(values, dtype=float)])
    return total[bounds[1:]] - total[bounds[:-1]]
