"""Whole texts to ids with the tokenizers library.

Both vocabularies supported here cut a text before a lone space or newline, so a text's ids are those of its
pieces in order.  A worker keeps the ids of the pieces it has met; a new piece is cut into pretokens and each
goes through the library's own BPE model.  Whatever is out of the ordinary (runs of white space, other white
space, the marker of an added token, letters beyond Latin-1, another kind of vocabulary) goes through the
library's encode() whole."""

from __future__ import annotations

import json
import os

import numpy as np
import regex

#: Pieces and pretokens together that a worker remembers unless told otherwise (some 65 MB), and the longest that it remembers; later
#: ones are encoded each time.
CACHE_PIECES, CACHE_LENGTH = 300_000, 48
#: Marks of which a single one behind a word is a pretoken of its own in both vocabularies.
_MARKS = frozenset(".,!?;:")

_PLAIN = regex.compile(r"[\x21-\x7e\xc0-\xd6\xd8-\xf6\xf8-\xff]*")
_BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_ENCODERS: dict = {}


def _byte_names() -> dict[int, str]:
    """The printable stand-in of each byte: itself where printable, else the next character from U+0100."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class _Odd(Exception):
    """The text has a piece whose ids may depend on its surroundings."""


class _Pieces(dict):
    """piece without its leading space -> ids as bytes.  A text's first piece has the key "\0" + piece."""

    def __init__(self, model, pattern: str, lower: bool, most: int):
        super().__init__()
        self.model, self.bpe, self.most = model, model.model, most
        self.cut = regex.compile(pattern).findall
        names = _byte_names()
        self.lower, self.names, self.parts = lower, names, {}
        self.bytes = [i.to_bytes(4, "little") for i in range(model.get_vocab_size())]
        self.line = b"" if lower else self.part("\n")
        self.marks = {m: self.part(m) for m in _MARKS}

    def __missing__(self, key: str) -> bytes:
        first = key[:1]
        body = key[1:] if first == "\0" or first == "\n" else key
        mark = body[-1:] if body[-1:] in _MARKS else ""
        stem = body[:-1] if mark else body
        if stem.isalpha() and (stem.isascii() or _PLAIN.fullmatch(stem)):
            return self.word(key, first, stem, mark)
        if not body and first != "\n":
            text = "" if key else " "
        else:
            text = body if first == "\0" else key if first == "\n" else " " + key
        if (body.isascii() and body.isprintable()) or _PLAIN.fullmatch(body):
            parts = self.cut(text.lower() if self.lower else text)
            ids = b"".join([self.remembered(p) for p in parts])
        elif any(c.isspace() or c < " " for c in text[1:]):
            raise _Odd
        else:
            ids = np.array(self.model.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        self.remember(self, key, ids)
        return ids

    def word(self, key: str, first: str, stem: str, mark: str) -> bytes:
        """A word, perhaps behind a line's end and before a mark.  Such a composite is remembered only if its word was known."""
        bare = first == "\0" or first == "\n"
        name = stem.lower() if self.lower else stem
        where = self if self.lower or not bare else self.parts
        ids, known = where.get(name), True
        if ids is None:
            ids, known = self.part(name if self.lower or bare else " " + name), False
            self.remember(where, name, ids)
        if first == "\n":
            ids = self.line + ids
        if mark:
            ids += self.marks[mark]
        if known:
            self.remember(self, key, ids)
        return ids

    def remember(self, where: dict, key: str, ids: bytes) -> None:
        if len(self) + len(self.parts) < self.most and len(key) <= CACHE_LENGTH:
            where[key] = ids

    def remembered(self, pretoken: str) -> bytes:
        """Ids of one of a piece's pretokens.  A word with its space is a piece by itself and kept as such."""
        word = pretoken if self.lower else pretoken[1:]
        where, key = (self, word) if word.isalpha() and (self.lower or pretoken[0] == " ") else (self.parts, pretoken)
        ids = where.get(key)
        if ids is None:
            ids = self.part(pretoken)
            self.remember(where, key, ids)
        return ids

    def part(self, pretoken: str) -> bytes:
        if pretoken.isascii():
            shown = pretoken.replace(" ", self.names[32]).replace("\n", self.names[10])
        else:
            shown = pretoken.encode().decode("latin-1").translate(self.names)
        return b"".join([self.bytes[t.id] for t in self.bpe.tokenize(shown)])


class Encoder:
    """encode(text) -> its ids as little-endian unsigned 32-bit integers; a null text is empty."""

    def __init__(self, path: str, most: int = CACHE_PIECES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre, norm = spec["pre_tokenizer"] or {}, spec["normalizer"] or {}
        self.known = None
        if pre.get("type") == "ByteLevel" and pre["use_regex"] and not pre["add_prefix_space"] and not norm:
            self.known = _Pieces(self.model, _BYTE_LEVEL, False, most)
        elif [p["type"] for p in pre.get("pretokenizers", [])] == ["Split", "ByteLevel"] and [n["type"] for n in norm.get("normalizers", [])] == ["NFC", "Replace", "Lowercase"]:
            split, level = pre["pretokenizers"]
            if split["behavior"] == "Removed" and split["invert"] and not level["use_regex"] and not level["add_prefix_space"]:
                self.known = _Pieces(self.model, split["pattern"]["Regex"], True, most)

    def whole(self, text: str) -> bytes:
        return np.array(self.model.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, text: str | None) -> bytes:
        t = text or ""
        if not t or self.known is None or t[0].isspace() or t[-1].isspace() or "<|" in t or "  " in t or " \n" in t or "\n " in t or "\n\n" in t or "\0" in t:
            return self.whole(t)
        pieces = t.replace("\n", " \n").split(" ")
        pieces[0] = "\0" + pieces[0]
        try:
            return b"".join(map(self.known.__getitem__, pieces))
        except _Odd:
            return self.whole(t)


def encoder(path: str, most: int = CACHE_PIECES) -> Encoder:
    """The worker's encoder for a vocabulary file; most: the pieces that it may remember."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path, most)
    found = _ENCODERS[path]
    if found.known is not None:
        found.known.most = most
    return found
