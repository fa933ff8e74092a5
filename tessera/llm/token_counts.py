"""Token counts of a byte-level BPE by rank-synchronous merging of ragged numpy arrays.

The distinct pre-tokens of a batch lie end to end in one array of symbols.  In each round every
sequence finds the lowest-ranked pair it has, and all sequences merge all places of their pair at once.
When no pair has a rank, the symbols left are the tokens.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

from .common import STEP_BYTES

#: The pattern of byte-level BPE: contractions, letters, digits, other signs, white space.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
NONE = np.iinfo(np.int64).max
#: Counts of pre-tokens that a worker remembers; when full, it starts anew.  Longer ones aren't kept.
REMEMBERED, LONGEST = 200_000, 64
#: Symbols that one merging step holds, unless a single pre-token has more.
STEP_SYMBOLS = 1 << 20


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in the vocabulary file.

    Printable Latin-1 bytes stand for themselves, the others for the letters from U+0100 on.
    """
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class Merges:
    """Vocabulary and merge ranks of a tokenizer file of kind byte-level BPE."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        if spec["model"]["type"] != "BPE" or spec["pre_tokenizer"] is None or spec["pre_tokenizer"]["type"] != "ByteLevel" or spec["pre_tokenizer"]["add_prefix_space"] or spec["normalizer"]:
            raise ValueError("only a plain byte-level BPE is read")
        vocabulary = spec["model"]["vocab"]
        self.byte = np.array([vocabulary[c] for c in byte_letters()], np.int64)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        key = np.array([vocabulary[a] << 32 | vocabulary[b] for a, b in pairs], np.int64)
        made = np.array([vocabulary[a + b] for a, b in pairs], np.int64)
        order = np.argsort(key, kind="stable")
        self.key, self.rank, self.made = key[order], order, made
        special = sorted((t["content"] for t in spec["added_tokens"] if t["special"]), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        self.pattern = regex.compile(PATTERN)
        self.known: dict[str, int] = {}

    def ranks(self, symbols: np.ndarray, inside: np.ndarray) -> np.ndarray:
        """Rank of the pair that starts at each symbol; NONE without one."""
        out = np.full(len(symbols), NONE)
        at = np.flatnonzero(inside)
        key = symbols[at] << 32 | symbols[at + 1]
        i = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        hit = self.key[i] == key
        out[at[hit]] = self.rank[i[hit]]
        return out

    def count(self, pieces: list[str]) -> np.ndarray:
        """Number of tokens of each pre-token."""
        data = [p.encode("utf-8", "surrogatepass") for p in pieces]
        length = np.array([len(d) for d in data], np.int64)
        out, start = np.zeros(len(data), np.int64), 0
        while start < len(data):
            end = max(start + 1, int(np.searchsorted(np.cumsum(length[start:]), STEP_SYMBOLS, side="right")) + start)
            owner = np.repeat(np.arange(end - start), length[start:end])
            symbols = self.byte[np.frombuffer(b"".join(data[start:end]), np.uint8)]
            out[start:end] = np.bincount(self.merge(symbols, owner), minlength=end - start)
            start = end
        return out

    def merge(self, symbols: np.ndarray, owner: np.ndarray) -> np.ndarray:
        """Owners of the symbols that survive all merges; ``owner`` is sorted."""
        done = []
        while len(symbols):
            inside = np.zeros(len(symbols), bool)
            inside[:-1] = owner[1:] == owner[:-1]
            rank = self.ranks(symbols, inside)
            first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            lowest = np.minimum.reduceat(rank, first)
            size = np.diff(np.concatenate([first, [len(symbols)]]))
            live = np.repeat(lowest != NONE, size)
            if not live.all():  # finished sequences leave
                done.append(owner[~live])
                symbols, owner, rank, size = symbols[live], owner[live], rank[live], size[lowest != NONE]
                lowest = lowest[lowest != NONE]
                if not len(symbols):
                    break
            hit = rank == np.repeat(lowest, size)
            # In a run of overlapping places the first, third, fifth ... merge.
            index = np.arange(len(hit))
            begin = hit & ~np.concatenate([[False], hit[:-1]])
            hit &= (index - np.maximum.accumulate(np.where(begin, index, 0))) % 2 == 0
            symbols = np.where(hit, self.made[np.where(hit, rank, 0)], symbols)
            keep = ~np.concatenate([[False], hit[:-1]])
            symbols, owner = symbols[keep], owner[keep]
        return np.concatenate(done) if done else owner

    def pieces(self, text: str) -> Iterator[list[str] | int]:
        """Lists of pre-tokens of the text; for each special token the number 1."""
        parts = [(0, len(text), False)]
        if self.special and (marks := [m.span() for m in self.special.finditer(text)]):
            edges = [0, *(x for m in marks for x in m), len(text)]
            parts = [(a, b, bool(i % 2)) for i, (a, b) in enumerate(zip(edges, edges[1:], strict=False))]
        for a, b, special in parts:
            if special:
                yield 1
            elif b - a <= STEP_BYTES:
                yield self.pattern.findall(text[a:b] if (a, b) != (0, len(text)) else text)
            else:
                some = []
                for m in self.pattern.finditer(text[a:b]):
                    some.append(m[0])
                    if len(some) == STEP_SYMBOLS // 8:
                        yield some
                        some = []
                yield some

    def tokens(self, texts: list[str | None]) -> np.ndarray:
        """Number of tokens of each text, without begin or end tokens; null counts as empty."""
        out, held, size = np.zeros(len(texts), np.int64), [], 0
        for i, t in enumerate(texts):
            for some in self.pieces(t or ""):
                if isinstance(some, int):
                    out[i] += some
                else:
                    held.append((i, some))
                    size += len(some)
                if size > STEP_SYMBOLS // 4:
                    self._add(held, out)
                    held, size = [], 0
        self._add(held, out)
        return out

    def _add(self, held: list[tuple[int, list[str]]], out: np.ndarray) -> None:
        """Adds the tokens of the pre-tokens; new ones are counted all at once."""
        known = self.known
        new = list({p for _, some in held for p in some}.difference(known))
        counts = dict(zip(new, self.count(new).tolist(), strict=True))
        if len(known) + len(counts) > REMEMBERED:
            kept = {p: known[p] for _, some in held for p in some if p in known}
            known.clear()
            known.update(kept)
        long = {p: n for p, n in counts.items() if len(p) > LONGEST}
        known.update(counts)
        for i, some in held:
            out[i] += sum(map(known.__getitem__, some))
        for p in long:
            del known[p]


_loaded: dict[str, Merges] = {}


def token_count(text: Column, path: str) -> Column:
    """Tokens (long) of a string column under the byte-level BPE file at ``path``, which every worker can open.

    Null counts as empty, an empty text has none.  The strings of special tokens inside a text are one
    token each.  Texts are whole, however long; only distinct pre-tokens are held.
    """

    @F.pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        merges = _loaded.get(path) or _loaded.setdefault(path, Merges(path))
        for batch in batches:
            yield pd.Series(merges.tokens(list(batch)))

    return count(text.cast("string"))
