"""Token ids of whole texts by a byte-level BPE vocabulary file.

The ids are those of the tokenizers library for that file, with no special tokens added; the string of a special
token inside a text has that token's id, as there.  Texts of characters below U+0250, whose letter and digit
classes all libraries agree on, and without such a string are encoded by tiktoken from the same vocabulary, several
times faster: in such a vocabulary a token's id is its rank among the merges.  All other texts go to tokenizers
itself.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np
import public_tokenizers
import tiktoken

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")      # tasks are parallel already

from tokenizers import Tokenizer  # noqa: E402

# The byte-level alphabet: printable bytes stand for themselves, the others, in order, for 256, 257, ...
_PRINTABLE = {*range(33, 127), *range(161, 173), *range(174, 256)}
_ALPHABET = {b: b for b in _PRINTABLE} | {b: 256 + n for n, b in enumerate(b for b in range(256) if b not in _PRINTABLE)}
_BYTES = {chr(c): b for b, c in _ALPHABET.items()}


class Encoder:
    """Encodes texts to little-endian unsigned 32-bit ids."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            held = json.load(f)
        special = {t["content"] for t in held["added_tokens"]}
        self.others = re.compile("|".join(["[^\x00-ɏ]", *map(re.escape, sorted(special))]))
        ranks = {bytes(_BYTES[c] for c in piece): i for piece, i in held["model"]["vocab"].items() if piece not in special}
        self.ranked = tiktoken.Encoding(os.path.basename(path), pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks,
                                        special_tokens={})

    def encode(self, texts: list[str]) -> list[bytes]:
        return [np.asarray(self.tokenizer.encode(t, add_special_tokens=False).ids if self.others.search(t)
                           else self.ranked.encode_ordinary(t), "<u4").tobytes() for t in texts]
