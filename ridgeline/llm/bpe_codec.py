"""BPE encoding and decoding of byte-level vocabularies.

Each pretoken is a doubly linked list of symbols with a priority queue of the ranks of the pairs
that stand side by side. The lowest rank, leftmost first, is merged; queue entries whose symbols
have changed since they were pushed are stale and skipped. Decoding concatenates the vocabulary's
byte strings.

Several workers share an executor's memory, so what one holds is bounded: a long text is gone through
in sections, and the ids of recent pieces are kept in two generations of KEPT entries, and at most
those of a section more, each.
"""

from __future__ import annotations

import codecs
import heapq
import json
from collections.abc import Iterable, Iterator
from hashlib import sha256
from itertools import chain

import pandas as pd
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

from ridgeline.llm.pieces import check_byte_level, chunks, pieces, sections

#: The split of byte-level vocabularies (fixed value, from the tokenizer's definition).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Pieces and words whose ids one generation keeps, and the longest that it does.
KEPT, LONGEST = 150_000, 64
#: Characters of texts that are encoded at once.
SECTION = 250_000


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself where it is one, else the next free one from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    out, free = [], 256
    for b in range(256):
        out.append(chr(b if b in plain else free))
        free += b not in plain
    return out


class BpeCodec:
    """A byte-level BPE vocabulary in the tokenizers library's JSON format."""

    def __init__(self, path: str):
        check_byte_level(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        added = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.special = added
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.merges.setdefault((vocab[a], vocab[b]), (rank, vocab[a + b]))
        symbols = byte_symbols()
        self.first = [vocab[s] for s in symbols]
        byte_of = {s: i for i, s in enumerate(symbols)}
        self.strings: dict[int, bytes] = {}
        for token, i in (vocab | added).items():
            known = all(c in byte_of for c in token)
            self.strings[i] = bytes(byte_of[c] for c in token) if known else token.encode()
        self.decimal = {i: str(i) for i in self.strings}
        self.pattern = regex.compile(PATTERN)
        self.young: dict[str, tuple[int, ...]] = {}
        self.old: dict[str, tuple[int, ...]] = {}

    def merge(self, data: bytes) -> list[int]:
        """The ids of one pretoken."""
        ids: list[int | None] = [self.first[b] for b in data]
        n = len(ids)
        if n < 2:
            return ids
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        merges, queue = self.merges, []
        for i in range(n - 1):
            if m := merges.get((ids[i], ids[i + 1])):
                queue.append((m[0], i, m[1], ids[i], ids[i + 1]))
        heapq.heapify(queue)
        while queue:
            _, i, made, left, right = heapq.heappop(queue)
            j = after[i]
            if ids[i] != left or j < 0 or ids[j] != right:
                continue  # stale
            ids[i], ids[j] = made, None
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
                if m := merges.get((made, ids[k])):
                    heapq.heappush(queue, (m[0], i, m[1], made, ids[k]))
            if (h := before[i]) >= 0 and (m := merges.get((ids[h], made))):
                heapq.heappush(queue, (m[0], h, m[1], ids[h], made))
        return [x for x in ids if x is not None]

    def _of_piece(self, piece: str) -> tuple[int, ...]:
        ids: list[int] = []
        for part in self.split_special.split(piece) if self.split_special and "<" in piece else (piece,):
            if part in self.special:
                ids.append(self.special[part])
                continue
            for word in self.pattern.findall(part):
                if (known := self.young.get(word)) is None:
                    if (known := self.old.get(word)) is None:
                        known = tuple(self.merge(word.encode()))
                    if len(word) <= LONGEST:
                        self.young[word] = known
                ids += known
        return tuple(ids)

    def encode_batch(self, texts: list[str]) -> list[list[int]]:
        cut = [pieces(x) for x in texts]
        new = set().union(*cut).difference(self.young)
        for piece in new:
            if (ids := self.old.get(piece)) is None:
                ids = self._of_piece(piece)
            self.young[piece] = ids
        out = [list(chain.from_iterable(map(self.young.__getitem__, c))) for c in cut]
        for piece in new:
            if len(piece) > LONGEST:
                del self.young[piece]
        if len(self.young) >= KEPT:
            self.young, self.old = {}, self.young
        return out

    def parts(self, texts: list[str]) -> Iterator[Iterable[list[int]]]:
        """Of each text its ids, a section at a time if it is long; each text's are to be read before the next one's."""
        for some in chunks(texts, SECTION):
            if len(some) > 1:
                yield from ([ids] for ids in self.encode_batch(some))
            else:
                yield (self.encode_batch([x])[0] for x in sections(some[0], SECTION))

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(next(self.parts([text]))))

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.strings.__getitem__, ids)).decode("utf-8", "replace")

    def digests(self, parts: Iterable[list[int]]) -> tuple[int, str, str]:
        """The number of a text's ids, the sha256 of the decimal ids joined by commas, and that of the decoded text."""
        n, of_ids, of_text, decoder = 0, sha256(), sha256(), codecs.getincrementaldecoder("utf-8")("replace")
        for ids in parts:
            of_ids.update(("," * (n > 0 and len(ids) > 0) + ",".join(map(self.decimal.__getitem__, ids))).encode())
            of_text.update(decoder.decode(b"".join(map(self.strings.__getitem__, ids))).encode())
            n += len(ids)
        of_text.update(decoder.decode(b"", True).encode())
        return n, of_ids.hexdigest(), of_text.hexdigest()


_codecs: dict[str, BpeCodec] = {}


def codec(path: str) -> BpeCodec:
    """One codec for each vocabulary and worker."""
    if path not in _codecs:
        _codecs[path] = BpeCodec(path)
    return _codecs[path]


def encode_column(text: Column, path: str) -> Column:
    """The ids of each text; of a null text an empty array."""

    @F.pandas_udf("array<int>")
    def ids(batches: pd.Series) -> pd.Series:
        own = codec(path)
        return pd.Series([list(chain.from_iterable(x)) for x in own.parts(batches.fillna("").tolist())])

    return ids(text)


def decode_column(ids: Column, path: str) -> Column:
    """The text of each array of ids; null for null."""

    @F.pandas_udf("string")
    def text(batches: pd.Series) -> pd.Series:
        own = codec(path)
        return pd.Series([None if x is None else own.decode(list(x)) for x in batches], dtype=object)

    return text(ids)


def round_trip_column(text: Column, path: str) -> Column:
    """struct(n_tokens, ids_sha256, decoded_sha256) of each text, null as the empty text.

    The digests are of the decimal ids joined by commas, and of the UTF-8 of the text decoded from
    the ids. The ids themselves do not leave the worker.
    """

    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def digests(batches: pd.Series) -> pd.DataFrame:
        own = codec(path)
        rows = [own.digests(x) for x in own.parts(batches.fillna("").tolist())]
        return pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    return digests(text)
