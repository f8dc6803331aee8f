"""Where the vocabulary files of the registered queries are."""

from __future__ import annotations

BYTE_PAIRS = "byte_bpe_50k.json"
WORD_PAIRS = "word_bpe_49k.json"


def vocabulary(name: str) -> str:
    """The path of a public vocabulary file; it is the same on every machine that has the package."""
    import public_tokenizers

    return public_tokenizers.path(name)
