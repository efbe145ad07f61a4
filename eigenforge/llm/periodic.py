"""Periodic runs of words (operator 11): stretches that repeat with a smallest period, found exactly.

For each power of two B, words are cut into blocks that begin at multiples of B. Blocks become keys of an Aho-Corasick
automaton over word numbers, which searches the words behind them; a block found again at a distance of B to 2B - 1 is a
seed for that distance as a period, and is extended word by word in both directions. A run of period q with four periods
or more holds a whole block of the B with B <= q < 2B and its copy q words on, so no run is missed.

Three things keep this near n log n whatever the text. A block goes into the automaton only if each of its words comes
again within 2B - 1 words, as all words of such a run do. Of a block's many copies at a place at most one is a seed: only
one block begins at the right distance. And within a run that is known already, multiples of its period are no seeds.
Keys are no longer than KEY words: for larger B, blocks begin at multiples of B and are searched by their first KEY words.
"""

from __future__ import annotations

import hashlib
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eigenforge.llm.frames import map_frames
from eigenforge.llm.words import no_gc

#: A run has this many words and this many periods at least.
MIN_WORDS, MIN_PERIODS = 6, 4
#: Words of a key at most, and of all keys of an automaton, about.
KEY, AUTOMATON = 256, 1 << 17
_FIRST_STEP = 32


def word_numbers(words: list[bytes]) -> np.ndarray:
    """Equal words get equal numbers from 0 on."""
    seen: dict[bytes, int] = {}
    put = seen.setdefault
    return np.fromiter((put(w, len(seen)) for w in words), dtype=np.int64, count=len(words))


def _next_distances(ids: np.ndarray) -> np.ndarray:
    """How far on each word comes again; the text's length if it doesn't."""
    n = len(ids)
    order = np.argsort(ids, kind="stable")
    out = np.full(n, n, dtype=np.int64)
    same = ids[order[1:]] == ids[order[:-1]]
    out[order[:-1][same]] = (order[1:] - order[:-1])[same]
    return out


def _reach(ids: np.ndarray, i: int, j: int, step: int) -> int:
    """Words from i and j (i < j) on, forwards or backwards (step 1 or -1), that are equal pair by pair."""
    n, total, width = len(ids), 0, _FIRST_STEP
    while True:
        room = n - j if step == 1 else i + 1
        take = min(width, room)
        if take <= 0:
            return total
        same = ids[i : i + take] == ids[j : j + take] if step == 1 else (ids[i - take + 1 : i + 1] == ids[j - take + 1 : j + 1])[::-1]
        if not same.all():
            return total + int(same.argmin())
        total, i, j, width = total + take, i + step * take, j + step * take, 2 * width


def _smallest(ids: np.ndarray, start: int, end: int, q: int) -> bool:
    """Whether no proper divisor of q is a period: with four periods or more, a smaller period must divide q."""
    rest, p = q, 2
    while rest > 1:
        if p * p > rest:
            p = rest
        if rest % p == 0:
            d = q // p
            if (ids[start : end - d] == ids[start + d : end]).all():
                return False
            while rest % p == 0:
                rest //= p
        p += 1
    return True


def _seeds(ids: np.ndarray, blocks: np.ndarray, size: int, length: int) -> Iterator[tuple[int, int]]:
    """(start of a block, distance) where a block's key is found again size to 2 * size - 1 words on, by place."""
    automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
    keys: dict[tuple, int] = {}
    key_of: dict[int, int] = {}
    for b in blocks.tolist():
        key = tuple(ids[b * size : b * size + length].tolist())
        if key not in keys:
            keys[key] = len(keys)
            automaton.add_word(key, keys[key])
        key_of[b] = keys[key]
    automaton.make_automaton()
    # neighbouring blocks are searched together: from a block's first to its last possible copy
    breaks = np.flatnonzero(np.diff(blocks) > 2) + 1
    for group in np.split(blocks, breaks):
        first = int(group[0] + 1) * size
        part = ids[first : int(group[-1] + 2) * size + length - 1]
        for last, key in automaton.iter(tuple(part.tolist())):
            at = first + last - length + 1
            b = at // size - 1
            if key_of.get(b) == key:
                yield b * size, at - b * size


def runs_of(ids: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run, by start, then period."""
    n = len(ids)
    if n < MIN_WORDS:
        return []
    again = _next_distances(ids)
    found: list[tuple[int, int, int]] = []
    size = 1
    while MIN_PERIODS * size <= n:
        n_blocks, length = n // size, min(size, KEY)
        far = again[: n_blocks * size].reshape(n_blocks, size).max(axis=1)
        blocks = np.flatnonzero(far < 2 * size)
        if len(blocks):
            # where a known run of a period that a key holds begins before a block, how far such runs reach
            known = sorted((s, s + m) for s, m, q in found if q <= length)
            starts = [s for s, _ in known]
            ends = np.maximum.accumulate([e for _, e in known]).tolist() if known else []
            if known:
                place = np.searchsorted(starts, blocks * size, side="right") - 1
                reach = np.where(place >= 0, np.array(ends)[np.maximum(place, 0)], 0)
                blocks = blocks[np.minimum((blocks + 3) * size, n) > reach]
            extents: dict[int, tuple[int, int]] = {}  # by period, the last stretch that was extended
            per = max(1, AUTOMATON // length)
            for k in range(0, len(blocks), per):
                for start, q in _seeds(ids, blocks[k : k + per], size, length):
                    if known:
                        i = bisect_right(starts, start) - 1
                        if i >= 0 and start + q + length <= ends[i]:
                            continue
                    lo, hi = extents.get(q, (0, 0))
                    if lo <= start and start + q + length <= hi:
                        continue
                    lo = start - _reach(ids, start - 1, start + q - 1, -1) if start else 0
                    hi = start + q + _reach(ids, start, start + q, 1)
                    extents[q] = (lo, hi)
                    if hi - lo >= max(MIN_WORDS, MIN_PERIODS * q) and _smallest(ids, lo, hi, q):
                        found.append((lo, hi - lo, q))
        size *= 2
    return sorted(set(found), key=lambda r: (r[0], r[2]))


def repeated_tail(words: list, doc_id: int) -> list:
    """The contract's change of a tenth of the texts: from a word on, the first p words of the rest repeat."""
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    period = words[a : a + p]
    return words[:a] + (period * ((n - a) // p + 1))[: n - a]


def collapsed(words: list, runs: list[tuple[int, int, int]]) -> list:
    """Words without those that a run holds after its first period."""
    if not runs:
        return words
    keep = np.ones(len(words), dtype=bool)
    for start, length, period in runs:
        keep[start + period : start + length] = False
    return [words[i] for i in np.flatnonzero(keep).tolist()]


def find_runs(words: list[bytes]) -> list[tuple[int, int, int]]:
    return runs_of(word_numbers(words))


def digests(docs: DataFrame) -> DataFrame:
    """For each row doc_id, n_runs, the longest run's start, length, period and exponent_milli, two digests, n_words, n_kept.

    A null or empty text has no words and no runs; a row without an id is not changed. Repeated rows are treated alike
    and all returned; an empty table gives no rows; other columns are not read. A very long text is one row, whose
    automatons hold AUTOMATON words of keys, or one key, at a time. No row is shuffled.
    """
    schema = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string, n_words long, n_kept long"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            with no_gc():
                for doc_id, text in zip(pdf["doc_id"].tolist(), pdf["text"].tolist()):
                    words = text.encode("utf-8", "surrogatepass").split() if isinstance(text, str) else []
                    known = not pd.isna(doc_id)
                    if known:
                        words = repeated_tail(words, int(doc_id))
                    runs = find_runs(words)
                    kept = collapsed(words, runs)
                    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else None
                    listed = "".join(f"{s},{m},{q}\n" for s, m, q in runs)
                    rows.append((
                        int(doc_id) if known else None, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None,
                        hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(b" ".join(kept)).hexdigest(), len(words), len(kept),
                    ))
            out = pd.DataFrame(rows, columns=["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256", "n_words", "n_kept"])
            whole = [c for c in out.columns if not c.endswith("sha256")]
            out[whole] = pd.DataFrame({c: pd.array([r[i] for r in rows], dtype="Int64") for i, c in enumerate(out.columns) if c in whole})
            yield out

    return map_frames(docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.col("text")), run, schema)
