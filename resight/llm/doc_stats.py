"""Statistics of a text for quality and toxicity models: one pass over its words."""

from __future__ import annotations

import math

import numpy as np

from resight.llm.quality_rules import SYMBOLS, repeated_words

NAMES = [
    "log_words", "word_length", "word_length_spread", "distinct", "top_word", "repeated", "dup_lines", "line_words",
    "upper", "digits", "symbols", "marks", "letters", "end_marks", "same_next", "capital_words",
]

#: Units of a usual share that are added to each text's, so that short texts are no outliers.
WEIGHT = 12.0


def _share(part: float, whole: float, usual: float = 0.0) -> float:
    """Arcsine root of a share, drawn to the usual one where there is little text."""
    return math.asin(math.sqrt(min(1.0, (part + WEIGHT * usual) / (whole + WEIGHT))))


def statistics(text: bytes) -> list[float]:
    """The values named in NAMES, transformed towards normal distributions; an empty text gives finite values too."""
    words = text.split()
    n = len(words)
    lengths = np.fromiter(map(len, words), np.float64, n) if n else np.zeros(0)
    counts: dict[bytes, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    lines = [x for x in text.split(b"\n") if x.strip()]
    bare = text.translate(None, b" \t\n\r\x0b\x0c")
    chars = len(bare)
    upper = len(bare) - len(bare.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    lower = len(bare) - len(bare.translate(None, b"abcdefghijklmnopqrstuvwxyz"))
    digits = len(bare) - len(bare.translate(None, b"0123456789"))
    symbols = len(bare) - len(bare.translate(None, SYMBOLS))
    marks = len(bare) - len(bare.translate(None, b"!?"))
    high = len(bare) - len(bare.translate(None, bytes(range(128, 256))))
    return [
        math.log1p(n),
        math.log((lengths.sum() + WEIGHT * 5) / (n + WEIGHT)),
        math.log1p(math.sqrt((np.square(lengths - 5).sum() + WEIGHT * 9) / (n + WEIGHT))),
        math.log((len(counts) + WEIGHT) / (n + WEIGHT)),
        _share(max(counts.values(), default=0), n, 0.05),
        _share(repeated_words(words), n),
        _share(len(lines) - len(set(lines)), len(lines)),
        math.log1p(n / max(1, len(lines))),
        _share(upper, upper + lower, 0.03),
        _share(digits, chars),
        _share(symbols, chars),
        _share(marks, chars),
        _share(upper + lower + high, chars, 0.95),
        _share(sum(w[-1:] in b".,;:" for w in words), n, 0.15),
        _share(sum(a == b for a, b in zip(words, words[1:], strict=False)), n),
        _share(sum(w[:1].isupper() for w in words), n, 0.1),
    ]
