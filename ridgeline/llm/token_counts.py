"""Token counts by rank-synchronous merging of ragged arrays.

The distinct pretokens of a batch stand in one symbol array with the index of their sequence. Each
round looks up the rank of every adjacent pair, takes each sequence's lowest rank, merges all of
its occurrences (left to right, without overlap) in all sequences at once, and drops sequences in
which nothing can be merged. The symbols left are the tokens.
"""

from __future__ import annotations

import json
import unicodedata

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

from ridgeline.llm.bpe_codec import byte_symbols
from ridgeline.llm.pieces import Memo, chunks

#: The split of the word-end vocabulary (fixed value, from the tokenizer's definition).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_NONE = np.iinfo(np.int64).max


class TokenCounter:
    """Counts the tokens of a lower-casing BPE vocabulary with word ends, in the tokenizers library's JSON format."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        kinds = [x.get("type") for x in (spec.get("normalizer") or {}).get("normalizers", [])]
        cut = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        if kinds != ["NFC", "Replace", "Lowercase"] or (cut[0].get("pattern") or {}).get("Regex") != PATTERN or spec["model"].get("type") != "BPE":
            raise ValueError(f"{path} is not a lower-casing vocabulary with the split that is counted here")
        vocab, end = spec["model"]["vocab"], spec["model"]["end_of_word_suffix"] or ""
        self.width = max(vocab.values()) + 1
        symbols = byte_symbols()
        self.inner = np.array([vocab[s] for s in symbols], dtype=np.int64)
        self.last = np.array([vocab[s + end] for s in symbols], dtype=np.int64)
        keys, made = [], []
        for pair in spec["model"]["merges"]:
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            keys.append(vocab[a] * self.width + vocab[b])
            made.append(vocab[a[: len(a) - len(end)] + b if end and a.endswith(end) else a + b])
        keys = np.array(keys, dtype=np.int64)
        self.keys, at = np.unique(keys, return_index=True)
        self.ranks, self.made = at.astype(np.int64), np.array(made, dtype=np.int64)
        special = sorted((x["content"] for x in spec["added_tokens"]), key=len, reverse=True)
        self.special = set(special)
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, special)) + ")") if special else None
        self.pattern = regex.compile(PATTERN)
        self.memo = Memo(self._of_pieces)

    def merged_sizes(self, words: list[bytes]) -> np.ndarray:
        """How many tokens each pretoken, as bytes and none of them empty, ends in."""
        sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        out = sizes.copy()
        data = np.frombuffer(b"".join(words), dtype=np.uint8)
        symbols = self.inner[data]
        ends = np.cumsum(sizes)
        symbols[ends - 1] = self.last[data[ends - 1]]
        of = np.repeat(np.arange(len(words)), sizes)
        while len(symbols) > 1:
            keys = symbols[:-1] * self.width + symbols[1:]
            at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
            ranks = np.where((self.keys[at] == keys) & (of[:-1] == of[1:]), self.ranks[at], _NONE)
            starts = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
            lowest = np.minimum.reduceat(np.r_[ranks, _NONE], starts)
            lens = np.diff(np.r_[starts, len(of)])
            hit = np.r_[ranks, _NONE] == np.repeat(lowest, lens)
            hit &= np.repeat(lowest != _NONE, lens)
            run = np.flatnonzero(hit)  # in a run of overlapping hits every other one counts
            if not len(run):
                break
            fresh = np.r_[True, np.diff(run) > 1]
            first = run[np.maximum.accumulate(np.where(fresh, np.arange(len(run)), 0))]
            run = run[(run - first) % 2 == 0]
            symbols[run] = self.made[ranks[run]]
            keep = np.ones(len(symbols), dtype=bool)
            keep[run + 1] = False
            np.subtract.at(out, of[run], 1)
            keep &= np.repeat(lowest != _NONE, lens)
            symbols, of = symbols[keep], of[keep]
        return out

    def _normal(self, text: str) -> str:
        text = unicodedata.normalize("NFC", text)
        return "".join(map(str.lower, text)) if "Σ" in text else text.lower()

    def _of_pieces(self, new: list[str]) -> list[int]:
        found, of, base = [], [], np.zeros(len(new), dtype=np.int64)
        for i, piece in enumerate(new):
            for part in self.split_special.split(piece) if self.split_special and "<" in piece else (piece,):
                if part in self.special:
                    base[i] += 1
                else:
                    words = self.pattern.findall(self._normal(part))
                    found += words
                    of += [i] * len(words)
        if found:
            distinct = list(set(found))
            sizes = dict(zip(distinct, self.merged_sizes([w.encode() for w in distinct]).tolist(), strict=True))
            np.add.at(base, np.array(of), np.fromiter(map(sizes.__getitem__, found), dtype=np.int64, count=len(found)))
        return base.tolist()

    def count_batch(self, texts: list[str]) -> list[int]:
        cut = [x.replace("\n", " ").split(" ") for x in texts]
        counts = self.memo(cut)
        return [sum(map(counts.__getitem__, c)) for c in cut]


_counters: dict[str, TokenCounter] = {}


def counter(path: str) -> TokenCounter:
    if path not in _counters:
        _counters[path] = TokenCounter(path)
    return _counters[path]


def count_column(text: Column, path: str) -> Column:
    """The number of tokens of each text; 0 for null."""

    @F.pandas_udf("long")
    def counts(batches: pd.Series) -> pd.Series:
        own = counter(path)
        return pd.Series([n for c in chunks(batches.fillna("").tolist()) for n in own.count_batch(c)], dtype="int64")

    return counts(text)
