"""Token ids of whole texts by a ``tokenizers`` vocabulary whose pieces never cross white space."""

from __future__ import annotations

import os
from functools import lru_cache

import numpy as np

#: Entries a worker's cache may hold before it starts afresh; bounds memory only.
CACHE = 1_000_000


class WordIds(dict):
    """A white-space-free string -> its ids as little-endian unsigned 32-bit bytes, encoded on first use.

    The vocabulary's normaliser and splitter treat a text run by run, and no run crosses a
    space or line feed, so a text's ids are those of its space-separated strings in turn.
    Words of Latin-1 letters are encoded by the model alone, in lower case as the normaliser
    would leave them; words with a final full stop or comma are the word and the mark.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        plain = ["zebra", "queue", "inging", "straße", "éàçñøþ", "ªµº"]
        # Byte-level symbols: visible Latin-1 characters stand for their own byte, the others follow from 256 in order.
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
        rest = (b for b in range(256) if b not in shown)
        self.symbols = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}
        self.lower = all(self._model(w) == self._full(w) for w in plain) and self._model("zebra") == self._full("ZeBRA") and self._full("a.") == (
            self._full("a") + self._full(".")
        )

    def _model(self, s: str) -> bytes:
        spelt = s if s.isascii() else s.encode().decode("latin-1").translate(self.symbols)
        return b"".join([t.id.to_bytes(4, "little") for t in self.model.tokenize(spelt)])

    def _full(self, s: str) -> bytes:
        return np.array(self.tokenizer.encode(s, add_special_tokens=False).ids, "<u4").tobytes()

    def _plain(self, s: str) -> bool:
        """Latin-1 letters alone, which the model encodes as the whole tokenizer would."""
        return self.lower and s.isalpha() and (s.isascii() or max(s) < "\u0100")

    def __missing__(self, s: str) -> bytes:
        if not s:
            ids = b""
        elif self._plain(s):
            ids = self[low] if (low := s.lower()) != s else self._model(s)
        elif len(s) > 1 and s[-1] in ".," and self._plain(s[:-1]):
            ids = self[s[:-1]] + self[s[-1]]
        else:
            ids = self._full(s)
        self[s] = ids
        return ids

    def ids(self, text: str | None) -> bytes:
        if not text:
            return b""
        if len(self) > CACHE:
            self.clear()
        return b"".join(map(self.__getitem__, text.replace("\n", " ").split(" ")))


@lru_cache(maxsize=2)
def word_ids(path: str) -> WordIds:
    """One per worker process."""
    return WordIds(path)
