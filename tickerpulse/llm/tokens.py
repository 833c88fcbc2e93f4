"""Public tokenizers inside tasks: whole texts to ids, word by word with a bounded memo."""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Iterable, Iterator

import numpy as np

MEMO_WORDS = 800_000
GROUP_CHARS = 1 << 20
#: The last alternatives of the split pattern: letters, one digit, a run of anything else.
_TAIL = r"[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Printable ASCII without capitals, and small Latin-1 letters, which normalisation leaves alone.
_PLAIN = re.compile("[!-@\\[-~\xdf-\xf6\xf8-\xff]+")
#: Byte-level BPE shows each byte as a printable character: itself if printable, else the next free one from 256 up.
_SHOWN = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
_BYTES = {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in _SHOWN)}


class WordTokenizer:
    """Token ids of whole texts, equal to the tokenizer's own on each text.

    For a tokenizer that drops white space and never joins across it, a text's ids are those of its
    ASCII-white-space-separated words in order, so each different word is encoded once and kept in a
    memo of at most ``MEMO_WORDS`` words (older half dropped first). Lower-casing tokenizers get
    ASCII-lower-cased words, unless the text holds ``<|``, where special tokens could begin.
    """

    def __init__(self, path: str, lower: bool = True):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # one task, one core
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.lower = lower
        wide = self.tokenizer.get_vocab_size(with_added_tokens=True) > 1 << 16
        self.dtype = np.dtype("<u4" if wide else "<u2")
        self.memo: dict[bytes, bytes] = {}
        self.model = self.tokenizer.model
        self.short: dict[str, bytes] = {}
        self.code = "I" if wide else "H"
        self.split = self._plain_split() if lower else None

    def _plain_split(self) -> re.Pattern | None:
        """The pre-tokenizer's pattern over plain characters, if the tokenizer is of the known shape:
        NFC, white space, lower case, one split pattern, byte-level characters."""
        shape = json.loads(self.tokenizer.to_str())
        steps = [x["type"] for x in (shape["normalizer"] or {}).get("normalizers", [])]
        cuts = (shape["pre_tokenizer"] or {}).get("pretokenizers", [])
        if steps != ["NFC", "Replace", "Lowercase"] or [x["type"] for x in cuts] != ["Split", "ByteLevel"]:
            return None
        pattern = cuts[0]["pattern"].get("Regex", "")
        if not pattern.endswith(_TAIL) or cuts[1]["add_prefix_space"] or cuts[1]["use_regex"]:
            return None
        return re.compile(pattern.removesuffix(_TAIL) + "[a-z\xdf-\xf6\xf8-\xff]+|[0-9]|[^a-z0-9\xdf-\xf6\xf8-\xff]+")

    def _code(self, words: list[bytes]) -> list[bytes]:
        """Ids of words that the memo lacks. Plain words of a lower-casing byte-level tokenizer go
        to its model piece by piece, which is the same but spares the per-call set-up; others go whole."""
        out: list[bytes | None] = [None] * len(words)
        rest = []
        tokenize, short = self.model.tokenize, self.short
        for k, text in enumerate(b"\n".join(words).decode().split("\n")):
            if self.split and _PLAIN.fullmatch(text) and "<|" not in text:
                code = b""
                for piece in self.split.findall(text):
                    if (ids := short.get(piece)) is None:
                        shown = piece if piece.isascii() else piece.encode().decode("latin-1").translate(_BYTES)
                        ids = array(self.code, [t.id for t in tokenize(shown)]).tobytes()
                        if len(piece) <= 3:  # punctuation and the like, kept apart
                            short[piece] = ids
                    code += ids
                out[k] = code
            else:
                rest.append(k)
        if len(short) > MEMO_WORDS:
            short.clear()
        coded = self.tokenizer.encode_batch([words[k].decode() for k in rest], add_special_tokens=False)
        for k, c in zip(rest, coded):
            out[k] = np.array(c.ids, self.dtype).tobytes()
        return out

    def _group(self, texts: list[bytes]) -> list[bytes]:
        split = [t.split() for t in texts]
        words = set().union(*split)
        missing = list(words.difference(self.memo))
        look = self.memo
        if missing:
            new = dict(zip(missing, self._code(missing)))
            if len(self.memo) + len(new) > MEMO_WORDS:  # this group still sees every word
                look = self.memo | new
                self.memo = dict(list(self.memo.items())[len(self.memo) // 2:]) if len(new) < MEMO_WORDS // 2 else {}
            if len(self.memo) + len(new) <= MEMO_WORDS:
                self.memo.update(new)
        return [b"".join(map(look.__getitem__, own)) for own in split]

    def encode(self, texts: Iterable[str | None]) -> Iterator[bytes]:
        """Packed little-endian ids (``dtype``) of each text, in order."""
        group: list[bytes] = []
        size = 0
        for text in texts:
            raw = (text or "").encode()
            if self.lower and b"<|" not in raw:
                raw = raw.lower()
            group.append(raw)
            size += len(raw)
            if size >= GROUP_CHARS:
                yield from self._group(group)
                group, size = [], 0
        if group:
            yield from self._group(group)


_LOADED: dict[tuple[str, bool], WordTokenizer] = {}


def word_tokenizer(path: str, lower: bool = True) -> WordTokenizer:
    """The worker's tokenizer for ``path``, with its memo, kept between tasks."""
    if (path, lower) not in _LOADED:
        _LOADED[path, lower] = WordTokenizer(path, lower)
    return _LOADED[path, lower]
