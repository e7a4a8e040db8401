"""Statistics of whole texts, a batch of documents at a time."""

from __future__ import annotations

import numpy as np

WINDOW = 5
#: Characters that count as symbols.
SYMBOLS = b"#*$%&|<>"

#: Columns of ``statistics``.
NAMES = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_chars", "n_lines", "n_upper", "n_lower", "n_digits",
    "n_punct", "n_distinct", "n_top_word", "n_capital_words", "n_end_marks", "n_repeat_pairs", "n_space", "n_long_words", "n_same_chars", "n_wide", "n_stop_lines", "n_same_next",
)

_KIND = np.zeros((6, 256), bool)
_KIND[0, list(SYMBOLS)] = True
_KIND[1, ord("A") : ord("Z") + 1] = True
_KIND[2, ord("a") : ord("z") + 1] = True
_KIND[3, ord("0") : ord("9") + 1] = True
_KIND[4, list(b"!\"'(),-./:;?@[]\\^_`{}~+=")] = True
_KIND[5, list(b" \t\n\r\x0b\x0c")] = True
_START = np.zeros(256, bool)
_START[[b for b in range(256) if b & 0xC0 != 0x80]] = True
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def repeated_windows(ids: np.ndarray, width: int = WINDOW) -> np.ndarray:
    """Which positions lie in a window of ``width`` ids that occurs twice or more, first occurrence included."""
    n, covered = len(ids) - width + 1, np.zeros(len(ids), bool)
    if n < 2:
        return covered
    wide = ids.astype(np.uint64)
    key = np.zeros(n, np.uint64)
    for i in range(width):
        key = (key ^ (wide[i : i + n] * _MIX[i])) * _MIX[(i + 1) % 5]
        key ^= key >> np.uint64(29)
    order = np.argsort(key, kind="stable")
    twin = key[order][1:] == key[order][:-1]
    if not twin.any():
        return covered
    a, b = order[1:][twin], order[:-1][twin]
    same = np.ones(len(a), bool)
    for i in range(width):
        same &= ids[a + i] == ids[b + i]
    if same.all():
        hit = np.union1d(a, b)
    else:  # two windows with one hash: compare the windows themselves
        _, at, count = np.unique(np.lib.stride_tricks.sliding_window_view(ids, width), axis=0, return_inverse=True, return_counts=True)
        hit = np.flatnonzero(count[at.ravel()] > 1)
    edge = np.zeros(len(ids) + 1, np.int64)
    np.add.at(edge, hit, 1)
    np.add.at(edge, hit + width, -1)
    return np.cumsum(edge[:-1]) > 0


def statistics(text: bytes) -> list[int]:
    """The counts in ``NAMES``: words are runs outside ASCII white space, characters are code points."""
    words = text.split()
    n = len(words)
    raw = np.frombuffer(text, np.uint8)
    per_byte = np.bincount(raw, minlength=256)
    kinds = [int(per_byte[k].sum()) for k in _KIND]
    chars = int(per_byte[_START].sum())
    lines = [x for x in text.split(b"\n") if x.strip(b" \t\r\x0b\x0c")]
    seen: dict[bytes, int] = {}
    get = seen.setdefault
    ids = np.fromiter((get(w, len(seen)) for w in words), np.int64, n)
    counts = np.bincount(ids) if n else np.zeros(1, np.int64)
    pairs = ids[:-1] * max(len(seen), 1) + ids[1:]
    lengths = np.fromiter(map(len, seen), np.int64, len(seen))
    first = np.fromiter((w[0] for w in seen), np.int64, len(seen))
    last = np.fromiter((w[-1] for w in seen), np.int64, len(seen))
    weigh = lambda mask: int(counts[: len(seen)][mask].sum()) if n else 0
    return [
        n, chars - kinds[5], kinds[0], len(lines) - len(set(lines)), int(repeated_windows(ids).sum()), chars, len(lines), kinds[1], kinds[2], kinds[3],
        kinds[4], len(seen), int(counts.max()), weigh((first >= 65) & (first <= 90)), weigh((last == 33) | (last == 63)), len(pairs) - len(np.unique(pairs)), kinds[5], weigh(lengths > 20), int((raw[1:] == raw[:-1]).sum()), int(per_byte[192:].sum()),
        sum(x.rstrip()[-1:] in (b".", b"!", b"?") for x in lines), int((ids[1:] == ids[:-1]).sum()),
    ]
