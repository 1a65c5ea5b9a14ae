"""A public byte-level BPE from its file of ranks, and where its pre-tokens are sure to part."""

from __future__ import annotations

import base64
import re
from functools import lru_cache

import regex
import tiktoken

#: The vocabulary file of ranks; the path must be readable on all executors.
BYTE_BPE_50K = "/opt/tokenizers/byte_bpe_50k.tiktoken"

# Fixed value: the published pre-token pattern of this vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_LONG_SPACE = re.compile(r"\s{2000}")
_WIDE = "一-龥ぁ-ゖァ-ヺ"
_WIDE_MARK = "、。，！？：；"
#: Positions at which a pre-token starts whatever stands further left or right: white space after a visible character
#: (no pre-token has a visible character before white space), and changes between wide letters and wide marks.
SURE = re.compile(rf"(?<=\S)(?=[ \n\t])|(?<=[{_WIDE}])(?=[{_WIDE_MARK}])|(?<=[{_WIDE_MARK}])(?=[{_WIDE}])")


@lru_cache(maxsize=4)
def load(path: str = BYTE_BPE_50K) -> tiktoken.Encoding:
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def encode(coder: tiktoken.Encoding, text: str) -> list[int]:
    """The ids of ``text`` without special tokens. Very long runs of white space go piece by piece, as the compiled
    pattern matcher has a bounded stack."""
    if not _LONG_SPACE.search(text):
        return coder.encode_ordinary(text)
    return [i for piece in regex.findall(PATTERN, text) for i in coder._encode_single_piece(piece)]
