"""Token ids of whole texts by a tokenizer file of the ``tokenizers`` library.

The byte-level pre-tokenizer never lets a token reach from a visible character into the white
space after it, nor from a letter or digit into a punctuation mark, so a text is the concatenation
of units cut there, each with ids of its own. The first units met are kept with their ids; the
tokenizer sees the others. Tokenizers without that rule encode texts whole by ``by_unit=False``.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np

# The white space of Unicode, which is what the pre-tokenizer's \s means, and ASCII punctuation.
SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
MARKS = re.escape("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")
# A letter or digit always ends its token before a mark.
UNITS = re.compile(f"[{SPACE}]*+[^{SPACE}{MARKS}]++(?<=[A-Za-zÀ-ÖØ-öø-ÿ0-9])|[{SPACE}]*[^{SPACE}]+|[{SPACE}]+")
KEPT_UNITS = 600_000
LONG_UNIT = 40


class Encoder:
    """Ids of texts as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str, by_unit: bool = True, ordinary: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = ordinary  # then their strings in a text mean nothing
        self.by_unit, self.ordinary = by_unit, ordinary
        self.kept: dict[str, bytes] = {}

    def _fresh(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(x.ids, "<u4").tobytes() for x in found]

    def encode(self, texts: list[str | None]) -> Iterator[bytes]:
        """The ids of each text, null being empty."""
        for text in texts:
            if not text:
                yield b""
            elif not self.by_unit or "<|" in text and not self.ordinary:
                # special tokens are found in the whole text, white space within them too
                yield self._fresh([text])[0]
            else:
                yield self._by_unit(UNITS.findall(text))

    def _by_unit(self, units: list[str]) -> bytes:
        kept = self.kept
        ids = [kept.get(u) for u in units]
        if None in ids:
            new = list({u for u, i in zip(units, ids) if i is None})
            found = dict(zip(new, self._fresh(new)))
            if len(kept) < KEPT_UNITS:
                kept.update((u, i) for u, i in found.items() if len(u) <= LONG_UNIT)
            ids = [found[u] if i is None else i for u, i in zip(units, ids)]
        return b"".join(ids)


_ENCODERS: dict[tuple, Encoder] = {}


def encoder(path: str, by_unit: bool = True, ordinary: bool = False) -> Encoder:
    """The encoder of this Python worker."""
    key = (path, by_unit, ordinary)
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(*key)
    return _ENCODERS[key]
