"""Token ids by the vocabulary's library, each different word encoded once.

A column of texts is split at ASCII white space and its words are numbered, both by Arrow; the
library sees the different words only, and the ids of a text are put together by number.
"""

from __future__ import annotations

import os
from unicodedata import normalize

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# The library's own threads would compete with the tasks of an executor.
os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

# Bounds of a worker's memory; what does not fit is encoded again.
CACHED_WORDS = 400_000
CACHED_LENGTH = 64
# Marks that the vocabulary keeps apart from the letters before them.
_MARKS = (",", ".")


def _is_letters(word: str) -> bool:
    """Letters only, also as the library normalises them, whatever stands around them."""
    return word.isalpha() and (word.isascii() or ("Σ" not in word and normalize("NFC", word).lower().isalpha()))


class WordEncoder:
    """For byte-level vocabularies that drop white space, lower the case and never merge across words.

    A text's ids are those of its words between white space, one after the other. A word of
    letters only is one piece for the library's model, which is given its lower-cased bytes; a comma
    or full stop behind it has its own ids. All other words are encoded as texts.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model = self.tokenizer.model
        self.by_bytes = ByteLevel(add_prefix_space=False, use_regex=False)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.kind = np.dtype("<u2" if max(vocabulary.values()) < 1 << 16 else "<u4")
        self.known: dict[str, bytes] = {}
        self.marks = {mark: self._of_texts([mark])[0] for mark in _MARKS}

    def _of_texts(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, self.kind).tobytes() for e in found]

    def _of_letters(self, word: str) -> bytes:
        """The ids of a word of letters; short words stay known, in lower case."""
        word = word.lower() if word.isascii() else normalize("NFC", word).lower()
        ids = self.known.get(word)
        if ids is None:
            piece = word if word.isascii() else self.by_bytes.pre_tokenize_str(word)[0][0]
            ids = np.array([token.id for token in self.model.tokenize(piece)], self.kind).tobytes()
            self._keep(word, ids)
        return ids

    def _keep(self, word: str, ids: bytes) -> None:
        if len(word) <= CACHED_LENGTH:
            if len(self.known) >= CACHED_WORDS:
                self.known.clear()
            self.known[word] = ids

    def _of_words(self, words: list[str]) -> list[bytes]:
        """The ids of different words."""
        out: list[bytes] = []
        others: list[int] = []
        for number, word in enumerate(words):
            ids = self.known.get(word)
            if ids is None:
                if _is_letters(word):
                    ids = self._of_letters(word)
                elif word.endswith(_MARKS) and _is_letters(word[:-1]):
                    ids = self._of_letters(word[:-1]) + self.marks[word[-1]]
                else:
                    others.append(number)
                    ids = b""
            out.append(ids)
        for number, ids in zip(others, self._of_texts([words[i] for i in others]), strict=True):
            out[number] = ids
            self._keep(words[number], ids)
        return out

    def encode_column(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, and where each text's begin and the last one's end; null counts as empty."""
        split = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        numbered = split.flatten().dictionary_encode()
        ids = self._of_words(numbered.dictionary.to_pylist())
        flat = np.frombuffer(b"".join(ids), self.kind)
        sizes = np.array([len(i) for i in ids], np.int64) // self.kind.itemsize
        begins = np.cumsum(sizes) - sizes
        number = numbered.indices.to_numpy(zero_copy_only=False)
        size = sizes[number]
        upto = np.zeros(len(number) + 1, np.int64)
        np.cumsum(size, out=upto[1:])
        places = np.arange(upto[-1]) + np.repeat(begins[number] - upto[:-1], size)
        return flat[places], upto[np.asarray(split.offsets) - split.offsets[0].as_py()]

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian numbers of ``kind``."""
        ids, bounds = self.encode_column(pa.array(texts, pa.string()))
        return [ids[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
