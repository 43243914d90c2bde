"""Public byte-level BPE tokenizers from files; the folder is a parameter."""

from __future__ import annotations

import base64
from functools import lru_cache

TOKENIZER_DIR = "/opt/tokenizers"
#: Fixed value: the published splitting pattern of the byte-level BPE vocabularies.
SPLIT_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: White space as that pattern means it (Unicode White_Space), for Python's and Java's regular expressions.
WHITE = r"\t-\r \u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: The same pattern for Java, whose \s knows only ASCII.
JAVA_SPLIT_PATTERN = SPLIT_PATTERN.replace(r"[^\s", f"[^{WHITE}").replace(r"\s", f"[{WHITE}]").replace(r"\S", f"[^{WHITE}]")


@lru_cache(maxsize=4)
def ranks(name: str = "byte_bpe_50k", folder: str = TOKENIZER_DIR) -> dict[bytes, int]:
    with open(f"{folder}/{name}.tiktoken", "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


@lru_cache(maxsize=4)
def encoding(name: str = "byte_bpe_50k", folder: str = TOKENIZER_DIR):
    """The tokenizer, once per Python worker. Strings that look like special tokens are ordinary text."""
    import tiktoken

    return tiktoken.Encoding(name, pat_str=SPLIT_PATTERN, mergeable_ranks=ranks(name, folder), special_tokens={})
