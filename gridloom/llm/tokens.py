"""Token ids by a public tokenizer, through a bounded cache of white-space chunks.

The tokenizer drops white space, so a text's ids are those of its chunks in turn. Chunks are lower-cased (A to Z, as the tokenizer does it
itself) and punctuation (no apostrophe) between a letter and white space is cut off (the tokenizer cuts there too), so that more recur.
A chunk of lower-case Latin letters is one word, which goes to the tokenizer's byte-pair model at once; any other goes through all of it.
"""

from __future__ import annotations

import os
import re

import numpy as np

#: Chunks kept in a worker before the cache starts anew.
CACHE = 500_000
_CUT = re.compile(rb"(?<=[a-z])[!-&(-/:-@\[-`{-~]+(?=[ \n\t\r])")
#: Lower-case letters of Latin-1, all of them one precomposed character.
_LETTERS = re.compile("[a-z\xdf-\xf6\xf8-\xff]+")


def _visible() -> dict[int, str]:
    """Byte-level models write each byte as a visible character: itself if printable in Latin-1, else the next one from U+0100 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    other = [b for b in range(256) if b not in plain]
    return {b: chr(b) if b in plain else chr(256 + other.index(b)) for b in range(256)}


class _Ids(dict):
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer, self.visible = Tokenizer.from_file(path), _visible()
        self.model = self.tokenizer.model

    def __missing__(self, chunk: bytes) -> bytes:
        text = chunk.decode("utf-8", "replace")
        if _LETTERS.fullmatch(text):
            ids = [t.id for t in self.model.tokenize(chunk.decode("latin-1").translate(self.visible))]
        else:
            ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        self[chunk] = out = np.array(ids, "<u4").tobytes()
        return out


class Encoder:
    def __init__(self, path: str, cache: int = CACHE):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.ids, self.most = _Ids(path), cache

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit numbers."""
        get, out = self.ids.__getitem__, []
        for text in texts:
            if len(self.ids) > self.most:
                self.ids.clear()
            out.append(b"".join(map(get, _CUT.sub(rb" \g<0>", text if b"<|" in text else text.lower()).split())))
        return out
