"""Token ids of texts by a public tokenizer file, with words that were seen before looked up."""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Pieces whose ids are remembered, about 0.2 GB; a full cache is emptied.
CACHED = 1_000_000


def _byte_names() -> dict[int, str]:
    """The character that a byte-level model has for each byte: itself if printable, else one from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    other = (b for b in range(256) if b not in plain)
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(other)}


class WordTokenizer:
    """Ids as ``Tokenizer.from_file(path).encode(text, add_special_tokens=False)`` gives them, as little-endian uint32.

    The tokenizer normalizes (NFC, lower case), splits at white space and into runs of letters, single
    digits and runs of the rest, and gives each piece to its BPE model. Where every character is ASCII or
    a Latin-1 letter, NFC changes nothing and the pieces are cut here; other words go through the
    tokenizer's own normalizer and pre-tokenizer. The model sees a piece once.
    """

    PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z\u00df-\u00f6\u00f8-\u00ff]+|[0-9]|[^a-z0-9\u00df-\u00f6\u00f8-\u00ff]+")
    SIMPLE = re.compile(r"[\t\n\x0b\x0c\r -~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]*")
    SPECIAL = ("<|startoftext|>", "<|endoftext|>")
    #: Characters of text that are cut up at a time.
    AT_ONCE = 10_000_000

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.model, self.normalizer, self.pre = self.whole.model, self.whole.normalizer, self.whole.pre_tokenizer
        if hasattr(self.model, "_resize_cache"):
            self.model._resize_cache(0)  # ours holds more
        self.names = _byte_names()
        self.pieces: dict[str, bytes] = {}

    def _model(self, named: str) -> bytes:
        return array("I", [t.id for t in self.model.tokenize(named)]).tobytes()

    def _word(self, word: str) -> bytes:
        """The ids of a lower-case word of simple characters."""
        ids = self.pieces.get(word)
        if ids is None:
            pieces = self.PIECES.findall(word)
            if len(pieces) != 1:
                return b"".join(map(self._word, pieces))
            ids = self._model(word if word.isascii() else word.encode().decode("latin-1").translate(self.names))
            if len(word) <= 64:
                if len(self.pieces) >= CACHED:
                    self.pieces.clear()
                self.pieces[word] = ids
        return ids

    def _other(self, text: str) -> bytes:
        """The ids of a text that has other characters."""
        if any(x in text for x in self.SPECIAL):
            return array("I", self.whole.encode(text, add_special_tokens=False).ids).tobytes()
        simple, rest = self.SIMPLE.fullmatch, lambda w: self.pre.pre_tokenize_str(self.normalizer.normalize_str(w))
        return b"".join(
            b"".join(map(self._word, w.lower().split())) if simple(w) else b"".join(self._model(p) for p, _ in rest(w))
            for w in self.SPACE.split(text)
        )

    SPACE = re.compile("[\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")

    def _simple(self, texts: list[str]) -> list[bytes]:
        """Of each text, with words cut and numbered by Arrow and each word of the batch looked up once."""
        lists = pc.ascii_split_whitespace(pc.utf8_lower(pa.array(texts, pa.large_string())))
        numbered = lists.values.dictionary_encode()
        ids = [self._word(w) for w in numbered.dictionary.to_pylist()]
        table = np.frombuffer(b"".join(ids), "<u4")
        sizes = np.fromiter(map(len, ids), np.int32, len(ids)) // 4
        word = numbered.indices.to_numpy()
        n, first = sizes[word], (np.cumsum(sizes, dtype=np.int32) - sizes)[word]
        ends = np.concatenate([np.zeros(1, np.int32), np.cumsum(n, dtype=np.int32)])
        flat = np.repeat(first - ends[:-1], n)
        flat += np.arange(ends[-1], dtype=np.int32)
        flat = table[flat]
        bounds = ends[lists.offsets.to_numpy()]
        return [flat[i:j].tobytes() for i, j in zip(bounds[:-1], bounds[1:], strict=True)]

    def __call__(self, texts: list[str | None]) -> Iterator[bytes]:
        at = 0
        while at < len(texts):
            until, n = at, 0
            while until < len(texts) and n < self.AT_ONCE:
                n += len(texts[until] or "")
                until += 1
            batch = [t or "" for t in texts[at:until]]
            is_simple = [bool(self.SIMPLE.fullmatch(t)) and not ("<|" in t and any(x in t for x in self.SPECIAL)) for t in batch]
            simple = self._simple([t if s else "" for t, s in zip(batch, is_simple, strict=True)])
            for t, s, ids in zip(batch, is_simple, simple, strict=True):
                yield ids if s else self._other(t)
            at = until


_LOADED: dict[str, WordTokenizer] = {}


def tokenizer(path: str) -> WordTokenizer:
    """One tokenizer for each Python worker, kept between its tasks."""
    import sys

    # functions reach workers by value, so the cache hangs on a module that outlives the task
    kept = sys.modules["tokenizers"].__dict__.setdefault("_lumenlode", {}) if "tokenizers" in sys.modules else _LOADED
    if path not in kept:
        made = WordTokenizer(path)
        kept = sys.modules["tokenizers"].__dict__.setdefault("_lumenlode", {})
        kept[path] = made
    return kept[path]
