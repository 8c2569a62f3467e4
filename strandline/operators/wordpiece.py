"""Text to word-piece ids, for encoders that are plugged into ``embed_distinct``."""

from __future__ import annotations

import unicodedata

# The blocks whose characters stand alone.
_IDEOGRAPHS = ((0x4E00, 0x9FFF), (0x3400, 0x4DBF), (0x20000, 0x2A6DF), (0x2A700, 0x2B73F), (0x2B740, 0x2B81F), (0x2B820, 0x2CEAF), (0xF900, 0xFAFF), (0x2F800, 0x2FA1F))


def _kind(c: str) -> str:
    """space, punctuation, ideograph, control or letter."""
    category, code = unicodedata.category(c), ord(c)
    if c in "\t\n\r" or category == "Zs":
        return "space"
    if category[0] == "C" or code == 0xFFFD:
        return "control"
    if 33 <= code <= 47 or 58 <= code <= 64 or 91 <= code <= 96 or 123 <= code <= 126 or category[0] == "P":
        return "punctuation"
    return "ideograph" if any(a <= code <= b for a, b in _IDEOGRAPHS) else "letter"


def basic_tokens(text: str) -> list[str]:
    """Lower-case words without accents; punctuation marks and ideographs stand alone."""
    out, word = [], []
    for c in unicodedata.normalize("NFD", "".join(" " if _kind(c) == "space" else c for c in text if _kind(c) != "control")).lower():
        if unicodedata.category(c) == "Mn":
            continue
        kind = _kind(c)
        if kind == "letter":
            word.append(c)
            continue
        if word:
            out.append("".join(word))
            word = []
        if kind in ("punctuation", "ideograph"):
            out.append(c)
    return out + (["".join(word)] if word else [])


def encode(text: str, vocabulary: dict[str, int], most: int = 256) -> list[int]:
    """[CLS], the longest pieces that fit from the left of each word, [SEP]; words of over 100 letters are unknown."""
    ids = []
    for word in basic_tokens(text):
        pieces, at = [], 0
        while at < len(word) <= 100:
            end = next((e for e in range(len(word), at, -1) if ("##" if at else "") + word[at:e] in vocabulary), None)
            if end is None:
                break
            pieces.append(vocabulary[("##" if at else "") + word[at:end]])
            at = end
        ids += pieces if at == len(word) else [vocabulary["[UNK]"]]
    return [vocabulary["[CLS]"], *ids[: most - 2], vocabulary["[SEP]"]]
