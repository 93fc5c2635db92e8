"""Token counts by public tokenizers. Vocabulary files are named by a path parameter and never copied."""

from __future__ import annotations

import base64
import os
from collections.abc import Callable

#: Fixed split pattern of the byte-level BPE vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_loaded: dict[str, object] = {}


def vocabulary(name: str = "byte_bpe_50k.tiktoken") -> str:
    """Where a vocabulary file lies: in the folder TOKENIZER_DIR names, else /opt/tokenizers."""
    return os.path.join(os.environ.get("TOKENIZER_DIR", "/opt/tokenizers"), name)


def encoder(path: str) -> Callable[[str], list[int]]:
    """Text -> token ids without special tokens; ``path`` is a .tiktoken file. Loaded once in each worker."""
    if path not in _loaded:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        _loaded[path] = tiktoken.Encoding(os.path.basename(path), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _loaded[path].encode_ordinary


def token_lengths(path: str, text: str) -> list[int]:
    """Byte lengths of the tokens of a text, in order."""
    ids = encoder(path)(text)
    enc = _loaded[path]
    return [len(enc.decode_single_token_bytes(i)) for i in ids]


def count_tokens(path: str | None, text: str) -> int:
    """Tokens of a text; without a path a token is one byte of its UTF-8 form."""
    return len(text.encode("utf-8", "surrogatepass")) if path is None else len(encoder(path)(text))
