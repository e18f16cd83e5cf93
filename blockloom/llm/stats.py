"""Statistics of whole texts, computed on the bytes of Arrow batches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import covered, split_words, window_hashes, window_starts, word_hashes

#: Characters that count as symbols.
SYMBOLS = "#*$%&|<>"
#: Words in a window for repeats within a text.
REPEAT_WORDS = 8

_BLANK, _UPPER, _LOWER, _DIGIT, _SYMBOL, _MARK, _REST = range(7)


def _classes() -> np.ndarray:
    kind = np.full(256, _REST, np.uint8)
    for chars, k in ((" \t\n\x0b\x0c\r", _BLANK), (map(chr, range(65, 91)), _UPPER), (map(chr, range(97, 123)), _LOWER), ("0123456789", _DIGIT), (SYMBOLS, _SYMBOL), (".,;:!?'\"()-", _MARK)):
        kind[[ord(c) for c in chars]] = k
    return kind


_KIND = _classes()
_SPACES = " \t\n\x0b\x0c\r"


def text_bytes(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts in a row, and the number of bytes of each."""
    text = pc.fill_null(text, "").cast(pa.large_string())
    offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
    data = text.buffers()[2]
    whole = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.empty(0, np.uint8)
    return whole, np.diff(offsets)


def _per_text(flags: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    ends = np.cumsum(sizes)
    return total[ends] - total[ends - sizes]


def duplicate_lines(text: str | None) -> tuple[int, int]:
    """Lines with a word, and those of them equal to an earlier line."""
    lines = [x for x in (text or "").split("\n") if x.strip(_SPACES)]
    return len(lines), len(lines) - len(set(lines))


def repeated_words(flat: pa.Array, counts: np.ndarray, k: int = REPEAT_WORDS) -> np.ndarray:
    """Of each text, the words in a window of ``k`` words that the text holds twice or more, the first included."""
    hashes = word_hashes(flat)
    starts = window_starts(counts, k)
    if not len(starts):
        return np.zeros(len(counts), np.int64)
    own = window_hashes(hashes, k)[starts]
    owner = np.repeat(np.arange(len(counts)), counts)
    # Windows of different texts are kept apart by the sort, not by the hash.
    texts = owner[starts]
    order = np.lexsort((own, texts))
    same = (own[order][1:] == own[order][:-1]) & (texts[order][1:] == texts[order][:-1])
    twice = np.concatenate([same, [False]]) | np.concatenate([[False], same])
    flags = covered(starts[order[twice]], k, len(hashes))
    return np.bincount(owner, weights=flags, minlength=len(counts)).astype(np.int64)


#: Columns of ``statistics``, all int64.
COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_bytes", "n_upper", "n_lower", "n_digits", "n_marks", "n_distinct_words", "longest_word")


def statistics(text: pa.Array) -> tuple[dict[str, np.ndarray], pa.Array, np.ndarray]:
    """COLUMNS of each text, with the words and their counts for further use."""
    flat, counts = split_words(text)
    data, sizes = text_bytes(text)
    kind = _KIND[data]
    lines = np.array([duplicate_lines(x) for x in text.to_pylist()], dtype=np.int64).reshape(-1, 2)
    chars = (data & 0xC0) != 0x80
    owner = np.repeat(np.arange(len(counts)), counts)
    codes = flat.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    pairs = np.unique(owner * (codes.max() + 1 if len(codes) else 1) + codes)
    distinct = np.bincount(pairs // (codes.max() + 1), minlength=len(counts)) if len(codes) else np.zeros(len(counts), np.int64)
    longest = np.zeros(len(counts), np.int64)
    np.maximum.at(longest, owner, np.asarray(pc.utf8_length(flat), dtype=np.int64))
    out = {
        "n_words": counts,
        "word_chars": _per_text(chars & (kind != _BLANK), sizes),
        "n_symbols": _per_text(kind == _SYMBOL, sizes),
        "n_dup_lines": lines[:, 1],
        "n_repeat_words": repeated_words(flat, counts),
        "n_lines": lines[:, 0],
        "n_bytes": sizes,
        "n_upper": _per_text(kind == _UPPER, sizes),
        "n_lower": _per_text(kind == _LOWER, sizes),
        "n_digits": _per_text(kind == _DIGIT, sizes),
        "n_marks": _per_text(kind == _MARK, sizes),
        "n_distinct_words": distinct.astype(np.int64),
        "longest_word": longest,
    }
    return out, flat, counts
