"""Sizes and offsets in tokens of a public byte-level BPE tokenizer.

The vocabulary file (ranks, one base64 token and its rank per line) is named by
path and read once per worker; it is not part of this package.
"""

from __future__ import annotations

import base64
import re
from functools import lru_cache

import numpy as np

VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
# The public pre-tokenization pattern that this family of vocabularies was made with.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: White space as the pattern above understands it.
_SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Letters of a text that go to the tokenizer together, and the run of blanks that goes past its pattern.  Neither
#: changes a token: texts are cut only where the pattern ends a token whatever follows.
PART, LONG_BLANK = 50_000, 10_000
_CUT = re.compile(f"[^{_SPACE}](?=[{_SPACE}])")


class Tokenizer:
    def __init__(self, path: str):
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.encoding = tiktoken.Encoding("tracefold", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.lengths = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, rank in ranks.items():
            self.lengths[rank] = len(token)

    def ids(self, text: str) -> list[int]:
        if len(text) <= min(PART, LONG_BLANK):
            return self.encoding.encode_ordinary(text)
        # the pattern keeps its place for each character of a run of blanks, so long runs are told apart here: a run is
        # one token of the pattern but for its last character where something follows
        out: list[int] = []
        at = 0
        for run in re.finditer(f"[{_SPACE}]{{{LONG_BLANK},}}", text):
            out += self._parts(text[at : run.start()])
            at = run.end() - (run.end() < len(text))
            out += self.encoding._encode_single_piece(text[run.start() : at].encode())
        return out + self._parts(text[at:])

    def _parts(self, text: str) -> list[int]:
        """Tokens of ``text``, cut where a blank follows what is none: a token of the pattern always ends there."""
        out: list[int] = []
        at = 0
        while len(text) - at > PART:
            cut = _CUT.search(text, at + PART - 1)
            if not cut:
                break
            out += self.encoding.encode_ordinary(text[at : cut.end()])
            at = cut.end()
        return out + self.encoding.encode_ordinary(text[at:])

    def count(self, text: str) -> int:
        return len(self.ids(text))

    def ends(self, text: str) -> np.ndarray:
        """Byte offset of each token's end."""
        return np.cumsum(self.lengths[self.ids(text)])


@lru_cache(4)
def load(path: str = VOCABULARY) -> Tokenizer:
    return Tokenizer(path)
