"""BPE encoding and decoding by a prefix-sharing trie (operator 3).

Distinct words go into a trie of byte symbols. A depth-first walk hands each node the last token of its prefix's
encoding; a word's encoding is then read back along those last tokens. What two words share at their start is
computed once. The last token of a prefix is the one vocabulary token ending there that forms a valid pair with the
last token of what precedes it: BPE encodings are exactly the token sequences of which all neighbouring pairs are
encodings themselves.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eigenforge.llm.words import no_gc
from eigenforge.llm.wordbpe import Splitter, byte_alphabet
from eigenforge.llm.frames import map_frames
from eigenforge.session import ship_package

#: Chunks and token pairs that a worker keeps at most. Workers live on after their tasks, and so does what they keep.
_CHUNK_LIMIT, _PAIR_LIMIT = 600_000, 1_000_000


class TrieBpe:
    """Words to token ids for a BPE file with an end-of-word suffix and byte symbols."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.vocab: dict[str, int] = model["vocab"]
        self.rank = {(a, b): i for i, (a, b) in enumerate(tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"])}
        self.names = {i: t for t, i in self.vocab.items()} | {t["id"]: t["content"] for t in spec.get("added_tokens", [])}
        self.specials = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.symbol = byte_alphabet()
        cut = len(self.suffix)
        #: Token text without the suffix, to the token inside a word and to the token at a word's end.
        self.inner = {t: t for t in self.vocab if not (cut and t.endswith(self.suffix))}
        self.final = {t[:-cut]: t for t in self.vocab if t.endswith(self.suffix)} if cut else self.inner
        self.longest = max(map(len, [*self.inner, *self.final]))
        self.pairs: dict[tuple[str, str], bool] = {}

    def _merge(self, symbols: list[str]) -> list[str]:
        """Plain BPE: apply the lowest-ranked merge, leftmost first, until none applies."""
        while len(symbols) > 1:
            best = min(range(len(symbols) - 1), key=lambda i: self.rank.get((symbols[i], symbols[i + 1]), 1 << 60))
            if (symbols[best], symbols[best + 1]) not in self.rank:
                break
            symbols[best : best + 2] = [symbols[best] + symbols[best + 1]]
        return symbols

    def valid_pair(self, a: str, b: str) -> bool:
        known = self.pairs.get((a, b))
        if known is None:
            if len(self.pairs) >= _PAIR_LIMIT:
                self.pairs.clear()
            end = b.endswith(self.suffix) if self.suffix else False
            plain = b[: -len(self.suffix)] if end else b
            symbols = [*a, *plain]
            if end:
                symbols[-1] += self.suffix
            known = self.pairs[(a, b)] = self._merge(symbols) == [a, b]
        return known

    def _last(self, path: str, lasts: list[str], table: dict[str, str]) -> str:
        n = len(path)
        for at in range(max(0, n - self.longest), n):
            token = table.get(path[at:])
            if token is not None and (at == 0 or self.valid_pair(lasts[at], token)):
                return token
        raise ValueError(f"no token ends at {path!r}")

    def encode_words(self, words: Iterable[str]) -> dict[str, list[int]]:
        """Encodings of distinct words: builds their trie and walks it once, depth first."""
        out: dict[str, list[int]] = {}
        root: dict = {}
        for word in words:
            if word in self.specials:
                out[word] = [self.specials[word]]
                continue
            node = root
            for byte in word.encode("utf-8"):
                node = node.setdefault(byte, {})
            node[-1] = word  # a word ends here
        # The walk keeps the path's symbols and, by prefix length, the last token of each prefix.
        lasts: list[str] = [""]
        stack: list[tuple[dict, str]] = [(root, "")]
        while stack:
            node, path = stack.pop()
            depth = len(path)
            del lasts[max(1, depth) :]
            if depth:
                word = node.get(-1)
                if word is not None:
                    token = self._last(path, lasts, self.final)
                    ids, at = [self.vocab[token]], depth - (len(token) - len(self.suffix))
                    while at > 0:
                        token = lasts[at]
                        ids.append(self.vocab[token])
                        at -= len(token)
                    out[word] = ids[::-1]
                if len(node) > (word is not None):
                    lasts.append(self._last(path, lasts, self.inner))
            stack.extend((child, path + self.symbol[byte]) for byte, child in node.items() if byte != -1)
        return out

    def decode(self, ids: Iterable[int]) -> str:
        """As a tokenizer without a decoder: the tokens' texts joined by one space."""
        return " ".join(map(self.names.__getitem__, ids))


class _Codec:
    """A worker's splitter, trie encoder and bounded cache: white-space chunk to its ids as 16-bit little-endian."""

    def __init__(self, path: str):
        self.split, self.bpe = Splitter(path), TrieBpe(path)
        self.type = np.dtype("<u2" if max(self.bpe.names) < 1 << 16 else "<u4")
        self.known: dict[str, bytes] = {}
        self.decimal = {i: str(i) for i in self.bpe.names}

    def learn(self, keys: set[str]) -> None:
        new = keys.difference(self.known)
        if len(self.known) + len(new) > _CHUNK_LIMIT:
            self.known = {w: self.known[w] for w in keys if w in self.known}
        with no_gc():
            parts = {key: self.split.words_of(key) for key in new}
            ids = self.bpe.encode_words(set().union(*parts.values()))
            for key, words in parts.items():
                self.known[key] = np.array([i for w in words for i in ids[w]], dtype=self.type).tobytes()

    def encode(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        """Ids of each text, in order. Texts go in groups of a bounded size, whose new words are learned first."""
        group: list[list[str]] = []
        held = 0
        for i, text in enumerate(texts):
            group.append(self.split.keys(text) if text else [])
            held += len(group[-1])
            if held >= 300_000 or i == len(texts) - 1:
                self.learn(set().union(*group))
                for keys in group:
                    yield np.frombuffer(b"".join(map(self.known.__getitem__, keys)), dtype=self.type)
                group, held = [], 0


@lru_cache(maxsize=2)
def _codec(path: str) -> _Codec:
    return _Codec(path)


def encode_digests(spark: SparkSession, docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document n_tokens, ids_sha256 (decimal ids joined by a space) and decoded_sha256.

    A null or empty text has no tokens. Repeated rows give a row each; a null id stays null; other columns are
    ignored, whatever their names. Memory is bounded by a batch and by the cache of words.
    """
    ship_package(spark)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codec = _codec(tokenizer)
        for pdf in batches:
            texts = pdf["text"].tolist()
            n, a, b = [], [], []
            for ids in map(np.ndarray.tolist, codec.encode(texts)):
                n.append(len(ids))
                a.append(hashlib.sha256(" ".join(map(codec.decimal.__getitem__, ids)).encode()).hexdigest())
                b.append(hashlib.sha256(codec.bpe.decode(ids).encode()).hexdigest())
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "n_tokens": n, "ids_sha256": a, "decoded_sha256": b})

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return map_frames(rows, run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode(spark: SparkSession, docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document its token ids: doc_id, ids array<int>. Rules for odd rows as in encode_digests."""
    ship_package(spark)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codec = _codec(tokenizer)
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "ids": [x.astype("int32") for x in codec.encode(pdf["text"].tolist())]})

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return map_frames(rows, run, "doc_id long, ids array<int>")


def decode(spark: SparkSession, encoded: DataFrame, tokenizer: str) -> DataFrame:
    """The inverse side: doc_id and text from ids; null ids decode to an empty text."""
    ship_package(spark)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = _codec(tokenizer).bpe
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "text": [bpe.decode(x) if x is not None else "" for x in pdf["ids"]]})

    return map_frames(encoded.select("doc_id", "ids"), run, "doc_id long, text string")
