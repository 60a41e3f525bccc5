"""Counts over whole texts, for many texts at once."""

from __future__ import annotations

import numpy as np

from .common import run_hashes, shingles

SYMBOLS = b"#*$%&|<>"
SPACES = b" \t\n\x0b\x0c\r"
PUNCTUATION = b"!?.,;:"

NAMES = ("n_chars", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_digits", "n_punctuation", "n_bangs", "n_distinct", "n_same_next", "n_lines", "n_capital_words")


def _per_text(mask: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.zeros(len(mask) + 1, np.int64)
    np.cumsum(mask, out=total[1:])
    return np.diff(total[bounds])


def _table(chars: bytes) -> np.ndarray:
    t = np.zeros(256, bool)
    t[list(chars)] = True
    return t


_IS = {"n_symbols": _table(SYMBOLS), "n_upper": _table(bytes(range(65, 91))), "n_digits": _table(bytes(range(48, 58))), "n_punctuation": _table(PUNCTUATION), "n_bangs": _table(b"!"), "space": _table(SPACES), "lower": _table(bytes(range(97, 123)))}


def statistics(texts: list[str | None]) -> dict[str, np.ndarray]:
    """name -> int64 per text, for NAMES.  A null text is empty.  Words are runs of other characters than space and \\x09-\\x0D."""
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    bounds = np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
    data = np.frombuffer(b"".join(raw), np.uint8)
    out = {name: _per_text(_IS[name][data], bounds) for name in ("n_symbols", "n_upper", "n_digits", "n_punctuation", "n_bangs")}
    out["n_chars"] = _per_text((data & 0xC0) != 0x80, bounds)
    out["word_chars"] = out["n_chars"] - _per_text(_IS["space"][data], bounds)
    lines = [[x for x in r.split(b"\n") if x.strip()] for r in raw]
    out["n_lines"] = np.array([len(x) for x in lines], np.int64)
    out["n_dup_lines"] = np.array([len(x) - len(set(x)) for x in lines], np.int64)
    begin, end, h = run_hashes(np.frombuffer(b"\n".join(raw), np.uint8), ~_IS["space"])
    edges = np.concatenate([[0], np.cumsum([len(r) + 1 for r in raw])]).astype(np.int64)  # with the separators
    sizes = np.diff(np.searchsorted(begin, edges))
    out["n_words"] = sizes
    total = int(sizes.sum())
    doc = np.repeat(np.arange(len(raw)), sizes)
    begin, end = begin - doc, end - doc  # places in data, which has no separators
    upper, lower = (np.concatenate([[0], np.cumsum(_IS[k][data])]) for k in ("n_upper", "lower"))
    capital = (upper[end] > upper[begin]) & (lower[end] == lower[begin])
    out["n_capital_words"] = np.bincount(doc[capital], minlength=len(raw)).astype(np.int64)
    own = h ^ (doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    _, first = np.unique(own, return_index=True)
    out["n_distinct"] = np.bincount(doc[first], minlength=len(raw)).astype(np.int64) if total else np.zeros(len(raw), np.int64)
    same = np.zeros(total, bool)
    same[1:] = own[1:] == own[:-1]
    out["n_same_next"] = np.bincount(doc[same], minlength=len(raw)).astype(np.int64)
    repeat = np.zeros(total, bool)
    if total >= 3:
        windows = shingles(own, 3)
        inside = doc[2:] == doc[:-2]
        _, back, found = np.unique(windows, return_inverse=True, return_counts=True)
        again = (found[back] > 1) & inside  # a window's hash holds its text's number, so equal windows lie in one text
        for k in range(3):
            repeat[k : total - 2 + k] |= again
    out["n_repeat_words"] = np.bincount(doc[repeat], minlength=len(raw)).astype(np.int64)
    return out
