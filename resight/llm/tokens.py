"""Token ids by public tokenizers, whose files lie where a parameter says."""

from __future__ import annotations

import json
import re

import numpy as np
import tiktoken
from tokenizers import Tokenizer

from resight.llm.common import remembered, trim

#: Words that a worker remembers in each of two generations, and the longest of them in bytes.
MOST_WORDS, LONGEST = 200_000, 64
#: Words of these signs are the same in any Unicode normal form, and each sign has one lower case of its own.
_PLAIN = re.compile("[!-~À-ÖØ-öø-ÿ]+")
#: How the word-level BPE cuts such a word, once it is in lower case.
_PIECES = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+")
#: Stands for the end of a piece; no byte of UTF-8.
_END = b"\xff"


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_signs() -> dict[str, int]:
    """Byte-level BPE's sign for each byte: printable ones for themselves, the others from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Pieces:
    """The vocabulary of a word-level BPE with word ends, in an engine that merges bytes of one piece.

    Byte and end merge first, then pairs in the order of the file. This gives the file's own segmentation as every
    token of its vocabulary is segmented as itself, which a test checks.
    """

    def __init__(self, model: dict):
        signs, suffix = _byte_signs(), model["end_of_word_suffix"]
        as_bytes = lambda t: bytes(signs[c] for c in t.removesuffix(suffix)) + _END * t.endswith(suffix)
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        tokens = [*signs, *(s + suffix for s in signs), *(a + b for a, b in merges)]
        ranks = {_END: 0} | {as_bytes(t): i + 1 for i, t in enumerate(tokens)}
        self.packed = [b""] + [np.array([model["vocab"][t]], "<u4").tobytes() for t in tokens]
        self.encode = tiktoken.Encoding("pieces", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})._encode_single_piece

    @classmethod
    def of(cls, made: dict) -> Pieces | None:
        """None if the tokenizer is of another kind."""
        kinds = [x["type"] for x in ((made.get("pre_tokenizer") or {}).get("pretokenizers") or [])]
        steps = [x["type"] for x in ((made.get("normalizer") or {}).get("normalizers") or [])]
        model = made["model"]
        if model["type"] != "BPE" or model.get("end_of_word_suffix") != "</w>" or kinds != ["Split", "ByteLevel"] or steps != ["NFC", "Replace", "Lowercase"]:
            return None
        return cls(model)

    def word(self, word: str) -> bytes:
        packed = self.packed
        return b"".join([packed[i] for piece in _PIECES.findall(word.lower()) for i in self.encode(piece.encode() + _END)])

    def letters(self, word: bytes) -> bytes:
        """A word of ASCII letters alone is one piece."""
        packed = self.packed
        return b"".join([packed[i] for i in self.encode(word.lower() + _END)])


class WordIds:
    """Ids of texts for tokenizers that split at white space before anything else.

    Words between ASCII white space are encoded once and remembered, unless they are long; when a generation is full,
    the one before it is forgotten, so memory is bounded and frequent words stay. As by the tokenizer itself, strings
    of its special tokens keep their ids wherever they stand in a text.
    """

    def __init__(self, path: str, most: int = MOST_WORDS):
        self.path, self.most, self.new, self.old = path, most, {}, {}
        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        self.pieces = Pieces.of(made)
        self.special = [x["content"] for x in made["added_tokens"]]
        del made
        trim()
        self.tokenizer: Tokenizer | None = None

    @classmethod
    def of(cls, path: str) -> WordIds:
        """One for each worker and path."""
        return remembered(f"ids {path}", lambda: cls(path))

    def slow(self, word: str) -> bytes:
        if self.tokenizer is None:  # made when first needed, as most workers never do
            self.tokenizer = Tokenizer.from_file(self.path)
        return np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, "<u4").tobytes()

    def word(self, word: bytes) -> bytes:
        ids = self.old.get(word)
        if ids is None:
            if self.pieces and word.isalpha():
                ids = self.pieces.letters(word)
            else:
                text = word.decode("utf-8", "replace")
                ids = self.pieces.word(text) if self.pieces and _PLAIN.fullmatch(text) and not any(x in text for x in self.special) else self.slow(text)
            if len(word) > LONGEST:
                return ids
        if len(self.new) >= self.most:
            self.old, self.new = self.new, {}
        self.new[word] = ids
        return ids

    def encode(self, text: bytes) -> bytes:
        """Ids as little-endian unsigned 32 bits, without special tokens."""
        get = self.new.get
        return b"".join([get(w) or self.word(w) for w in text.split()])
