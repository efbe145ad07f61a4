"""Normalising and splitting text as the word-end BPE tokenizer file does, word by word.

Nearly all text is made of a small set of characters for which the tokenizer's normalisation (NFC, white space,
lower case) and its splitting pattern can be done by one pass of Python's `re`; everything else goes through the
tokenizer's own normalizer and pre-tokenizer, so both ways give the same words.
"""

from __future__ import annotations

import re
from functools import lru_cache

#: Characters of the fast way: white space, printable ASCII, the Latin-1 letters, common punctuation.
_ODD = re.compile("[^\\t\\n\\x0b\\x0c\\r -~¡«»¿À-ÖØ-öø-ÿ–—‘’“”…]")
_WORD = re.compile("'(?:s|t|re|ve|m|ll|d)|[a-zß-öø-ÿ]+|[0-9]|[^\\s0-9a-zß-öø-ÿ]+")


@lru_cache(maxsize=4)
def load_tokenizer(path: str):
    """The tokenizer of a file, without truncation and padding."""
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    return tok


def byte_alphabet() -> dict[int, str]:
    """Each byte's printable stand-in: printable Latin-1 bytes stand for themselves, the rest follow from U+0100."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Splitter:
    """Words of a text, as keys of a word cache; special tokens are words of their own."""

    def __init__(self, path: str):
        self.tok = load_tokenizer(path)
        self.specials = {t.content: i for i, t in self.tok.get_added_tokens_decoder().items()}
        self._special = re.compile("(" + "|".join(map(re.escape, sorted(self.specials, key=len, reverse=True))) + ")") if self.specials else None
        self._back = {c: b for b, c in byte_alphabet().items()}

    def chunks(self, text: str) -> list[str] | None:
        """The text in lower case cut at white space, which no token crosses; None if it needs the tokenizer's own rules."""
        if _ODD.search(text) or ("<|" in text and self._special and self._special.search(text)):
            return None
        return text.lower().split()

    def keys(self, text: str) -> list[str]:
        """Chunks, or else words: what words_of() takes."""
        found = self.chunks(text)
        return found if found is not None else self.slow(text)

    def words_of(self, key: str) -> list[str]:
        """The words of one key. A word with characters that aren't of the fast way is whole already."""
        return [key] if key in self.specials or _ODD.search(key) else _WORD.findall(key)

    def slow(self, text: str) -> list[str]:
        out: list[str] = []
        for part in self._special.split(text) if self._special else [text]:
            if part in self.specials:
                out.append(part)
            elif part:
                for piece, _ in self.tok.pre_tokenizer.pre_tokenize_str(self.tok.normalizer.normalize_str(part)):
                    out.append(bytes(self._back[c] for c in piece).decode("utf-8"))
        return out
