"""SimHash near-duplicates by Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into three segments of 22, 21 and 21 bits, each a word of the binary
Golay code [23, 12, 7] once padded with zeros. Decoding a word to all codewords within distance 4
gives one index or six, and two words at distance 2 or less always share one. Of at most four
differing bits, the two least-hit segments have at most two, so either

* one segment is equal and another has at most two: the key (equal segment, index of the other); or
* all three have one or two: the key (index of the first, index of the second).

That is about 60 keys for a fingerprint, and no linked pair without a common one. Only distinct
fingerprints are keyed. Within a bucket, small groups compare all their fingerprints and larger ones
grow a spanning forest, so edges stay in proportion to the bucket's rows. The rows of a bucket above
`largest` are never held together: its fingerprints instead name all words within two bits, and two
that are linked name a common one; no word has more than 2081 such fingerprints.

Wide fingerprints, for candidates that are compared as sets afterwards, have 128 bits and so six Golay
words. A key is an index of each of two words, so sets share one if two of the six words are alike.
Those of a similarity of 0.8 nearly always do, but no number of bits bounds that similarity: who needs
every pair looks for the rest in another way.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ridgeline.llm.common import materialize, text_batches
from ridgeline.llm.components import components

WORDS = 4
SEED = 42
MAX_BITS = 4
#: Bits of 128 in which wide fingerprints of candidates may differ; sets of a Jaccard similarity of 0.8 differ in about 19.
WIDE_BITS = 30
#: The Golay code's generator polynomial (fixed value).
GENERATOR = 0xC75
#: (lowest bit, bits) of the segments.
SEGMENTS = ((0, 22), (22, 21), (43, 21))


def fingerprint(text: str, words: int = WORDS) -> int:
    """SimHash of the word shingles, repeats included; zero without words."""
    own = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z only, and ASCII white space
    if not own:
        return 0
    if len(own) < words:
        own, words = [b" ".join(own)], 1
    line = memoryview(b" ".join(own))
    ends = np.cumsum(np.fromiter(map(len, own), dtype=np.int64, count=len(own)) + 1)
    starts = np.r_[0, ends[:-1]][: len(own) - words + 1].tolist()
    ends = (ends[words - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    return majority(np.array([digest(line[a:b], SEED) for a, b in zip(starts, ends, strict=True)], dtype="<u8"))


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half the hashes."""
    counts = np.zeros(64, dtype=np.int64)
    for i in range(0, len(hashes), 4096):
        part = np.unpackbits(hashes[i : i + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += part.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def wide_print(hashes: np.ndarray) -> tuple[int, int]:
    """A SimHash of 128 bits as two of 64: of the hashes, and of the hashes mixed once more (SplitMix64's finish)."""
    x = hashes + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return majority(hashes), majority((x ^ (x >> np.uint64(31))).astype("<u8"))


def fingerprint_column(text: Column, words: int = WORDS) -> Column:
    """The fingerprint as a long with the same bits; a null text is empty."""

    @F.pandas_udf("long")
    def prints(batches: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(x, words) for x in batches.fillna("")], dtype=np.uint64).view(np.int64))

    return prints(text)


def _parity(data: np.ndarray) -> np.ndarray:
    word = data.astype(np.int64) << 11
    for bit in range(22, 10, -1):
        word = np.where(word >> bit & 1, word ^ (GENERATOR << (bit - 11)), word)
    return word


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Parities of the 4096 data words; for each syndrome, up to six error patterns of weight 4 or less and their number."""
    parity = _parity(np.arange(4096))
    patterns, sizes = np.zeros((2048, 6), dtype=np.int64), np.zeros(2048, dtype=np.int64)
    for weight in range(5):
        for bits in combinations(range(23), weight):
            e = sum(1 << b for b in bits)
            s = int(parity[e >> 11]) ^ (e & 0x7FF)
            patterns[s, sizes[s]] = e
            sizes[s] += 1
    return parity, patterns, sizes


_PARITY, _PATTERNS, _SIZES = _tables()


def golay_indices(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Six index columns for 23-bit words, and how many of each row count."""
    syndrome = _PARITY[words >> 11] ^ (words & 0x7FF)
    return (words[:, None] ^ _PATTERNS[syndrome]) >> 11, _SIZES[syndrome]


def keys_of(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(key, fingerprint) rows of distinct fingerprints."""
    prints = prints.view(np.uint64) if prints.dtype != np.uint64 else prints
    parts = [((prints >> np.uint64(at)) & np.uint64((1 << n) - 1)).astype(np.int64) for at, n in SEGMENTS]
    found = [golay_indices(p) for p in parts]
    keys, owners = [], []

    def put(key: np.ndarray, ok: np.ndarray) -> None:
        keys.append(key[ok])
        owners.append(prints[ok])

    for combo, (i, j) in enumerate((i, j) for i in range(3) for j in range(3) if i != j):
        index, n = found[j]
        for c in range(6):
            put((combo << 40) | (parts[i] << 12) | index[:, c], n > c)
    (a, n), (b, m) = found[0], found[1]
    for c in range(6):
        for d in range(6):
            put((6 << 40) | (a[:, c] << 12) | b[:, d], (n > c) & (m > d))
    return np.concatenate(keys), np.concatenate(owners)


def _forest(prints: np.ndarray) -> Iterator[tuple[int, int]]:
    """Edges of a spanning forest of the graph that links fingerprints at most four bits apart."""
    left = prints
    while len(left):
        seed, left = left[0], left[1:]
        queue = [seed]
        while queue and len(left):
            own = queue.pop()
            near = np.bitwise_count(left ^ own) <= MAX_BITS
            for x in left[near]:
                yield int(own), int(x)
                queue.append(x)
            left = left[~near]


def bucket_edges(keys: np.ndarray, prints: np.ndarray, small: int = 48) -> tuple[np.ndarray, np.ndarray]:
    """Edges within the buckets of rows that are sorted by key."""
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    sizes = np.diff(np.r_[starts, len(keys)])
    rows = np.repeat(sizes, sizes)
    ok = (rows > 1) & (rows <= small)
    k, p = keys[ok], prints[ok]
    a, b = [], []
    for step in range(1, small):
        if len(k) <= step:
            break
        same = k[step:] == k[:-step]
        if not same.any():
            break
        hit = same & (np.bitwise_count(p[step:] ^ p[:-step]) <= MAX_BITS)
        a.append(p[:-step][hit])
        b.append(p[step:][hit])
    for i in np.flatnonzero(sizes > small):
        grown = list(_forest(prints[starts[i] : starts[i] + sizes[i]]))
        if grown:
            pair = np.array(grown, dtype=np.uint64)
            a.append(pair[:, 0])
            b.append(pair[:, 1])
    if not a:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.uint64)
    return np.concatenate(a), np.concatenate(b)


def _edge_batch(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    a, b = a.view(np.int64), b.view(np.int64)
    pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0) if len(a) else np.zeros((0, 2), dtype=np.int64)
    return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])


def links(prints: DataFrame, largest: int = 20_000) -> DataFrame:
    """Edges (a, b), a < b, over distinct fingerprints prints(fp) that connect all that are linked.

    Rows with a = b mark fingerprints of buckets above largest, which spheres() links.
    """

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(0).to_numpy(zero_copy_only=False)
            for i in range(0, len(own), 5000):
                k, p = keys_of(own[i : i + 5000])
                yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(p.view(np.int64))], names=["key", "fp"])

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, prints = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
        over = None  # the key of a bucket that is too large to hold
        for batch in batches:
            keys = np.r_[keys, batch.column(0).to_numpy(zero_copy_only=False)]
            prints = np.r_[prints, batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)]
            if over is not None or len(keys) > largest:
                if over is not None and keys[0] == over:
                    n = int(np.searchsorted(keys, over, side="right"))
                    yield _marks(prints[:n])
                    keys, prints = keys[n:], prints[n:]
                    if not len(keys):
                        continue
                over = None
                cut = int(np.searchsorted(keys, keys[-1]))  # the last bucket may go on
                if cut:
                    yield from done(keys[:cut], prints[:cut])
                    keys, prints = keys[cut:], prints[cut:]
                if len(keys) > largest:
                    over = keys[0]
                    yield _marks(prints)
                    keys, prints = keys[:0], prints[:0]
        if len(keys):
            if over is not None and keys[0] == over:
                n = int(np.searchsorted(keys, over, side="right"))
                yield _marks(prints[:n])
                keys, prints = keys[n:], prints[n:]
            if len(keys):
                yield from done(keys, prints)

    def _marks(own: np.ndarray) -> pa.RecordBatch:
        ids = pa.array(own.view(np.int64))
        return pa.RecordBatch.from_arrays([ids, ids], names=["a", "b"])

    def done(keys: np.ndarray, prints: np.ndarray) -> Iterator[pa.RecordBatch]:
        starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        sizes = np.diff(np.r_[starts, len(keys)])
        big = np.repeat(sizes > largest, sizes)
        if big.any():
            yield _marks(prints[big])
            keys, prints = keys[~big], prints[~big]
        if len(keys):
            yield _edge_batch(*bucket_edges(keys, prints))

    keyed = prints.select("fp").mapInArrow(expand, "key long, fp long")
    return keyed.repartition("key").sortWithinPartitions("key", "fp").mapInArrow(within, "a long, b long").distinct()


def wide_keys(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(key, row) of wide fingerprints, an array of two columns: an index of each of two of the six words, 420 keys or so a row."""
    words = [((p >> np.uint64(at)) & np.uint64((1 << n) - 1)).astype(np.int64) for p in prints.T for at, n in SEGMENTS]
    found = [golay_indices(w) for w in words]
    rows = np.arange(len(prints))
    keys, owners = [], []
    for i, j in combinations(range(len(words)), 2):
        (a, n), (b, m) = found[i], found[j]
        for c in range(6):
            for d in range(6):
                ok = (n > c) & (m > d)
                keys.append(((i << 27) | (a[:, c] << 15) | (j << 12) | b[:, d])[ok])
                owners.append(rows[ok])
    return np.concatenate(keys), np.concatenate(owners)


def wide_edges(keys: np.ndarray, ids: np.ndarray, prints: np.ndarray, small: int = 48) -> tuple[np.ndarray, np.ndarray]:
    """Edges (a, b), a < b, of ids that connect those of a key that are at most WIDE_BITS bits apart; rows are sorted by key."""
    prints = prints.view(np.uint64)  # of a negative number the bits of its absolute value would be counted
    bits = lambda x, y: np.bitwise_count(x ^ y).sum(axis=-1, dtype=np.int64)
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    sizes = np.diff(np.r_[starts, len(keys)])
    rows = np.repeat(sizes, sizes)
    ok = (rows > 1) & (rows <= small)
    k, own, p = keys[ok], ids[ok], prints[ok]
    out = [np.zeros((0, 2), dtype=np.int64)]
    for step in range(1, min(small, len(k))):
        same = np.flatnonzero(k[step:] == k[:-step])
        if not len(same):
            break
        hit = same[bits(p[same], p[same + step]) <= WIDE_BITS]
        out.append(np.stack([own[hit], own[hit + step]], axis=1))
    for i in np.flatnonzero(sizes > small):
        left = np.arange(starts[i], starts[i] + sizes[i])
        while len(left):
            queue, left = [left[0]], left[1:]
            while queue and len(left):
                at = queue.pop()
                near = bits(prints[left], prints[at]) <= WIDE_BITS
                out.append(np.stack([np.full(near.sum(), ids[at]), ids[left[near]]], axis=1))
                queue += left[near].tolist()
                left = left[~near]
    pairs = np.unique(np.sort(np.concatenate(out), axis=1), axis=0)
    return pairs[:, 0], pairs[:, 1]


class Spanning:
    """Of edges as they come, those that connect what was apart. Nodes above most are forgotten, which lets more edges through and loses none."""

    def __init__(self, most: int = 200_000):
        self.most, self.up = most, {}

    def _root(self, x: int) -> int:
        up = self.up
        top = x
        while (over := up.setdefault(top, top)) != top:
            top = over
        while up[x] != top:
            up[x], x = top, up[x]
        return top

    def new(self, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        if len(self.up) > self.most:
            self.up = {}
        out = []
        for x, y in zip(a.tolist(), b.tolist(), strict=True):
            i, j = self._root(x), self._root(y)
            if i != j:
                self.up[max(i, j)] = min(i, j)
                out.append((x, y))
        pairs = np.array(out, dtype=np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])


def candidates(prints: DataFrame, largest: int = 20_000) -> DataFrame:
    """Edges (a, b), a < b, over prints(set, print, again), that connect sets whose wide fingerprints share a key and differ in WIDE_BITS bits or fewer.

    The sets of a key that has more than largest are all joined to its least one, so no task holds them.
    """

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)], axis=1)
            for i in range(0, len(own), 1000):
                part = own[i : i + 1000]
                keys, rows = wide_keys(part[:, 1:].view(np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(keys), *(pa.array(x) for x in part[rows].T)], names=["key", "set", "print", "again"])

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((0, 4), dtype=np.int64)
        edges = Spanning().new  # a set has hundreds of keys: a task tells once what they connect
        hub = None  # (key, set) of a key that has too many to hold
        for batch in batches:
            held = np.concatenate([held, np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(4)], axis=1)])
            if hub is not None:
                n = int(np.searchsorted(held[:, 0], hub[0], side="right"))
                yield edges(np.full(n, hub[1]), held[:n, 1])
                held = held[n:]
                if not len(held):
                    continue
                hub = None
            if not len(held):
                continue
            cut = int(np.searchsorted(held[:, 0], held[-1, 0]))  # the last key may go on
            if cut:
                yield edges(*wide_edges(held[:cut, 0], held[:cut, 1], held[:cut, 2:]))
                held = held[cut:]
            if len(held) > largest:
                hub = (held[0, 0], held[0, 1])
                yield edges(np.full(len(held) - 1, hub[1]), held[1:, 1])
                held = held[:0]
        if len(held):
            yield edges(*wide_edges(held[:, 0], held[:, 1], held[:, 2:]))

    keyed = prints.select("set", "print", "again").mapInArrow(expand, "key long, set long, print long, again long")
    # dealt by the first word and its index, so that a set's keys meet in 30 tasks at most and each tells once what they connect
    return keyed.repartition(F.shiftright("key", 15)).sortWithinPartitions("key", "set").mapInArrow(within, "a long, b long").distinct()


def spheres(prints: DataFrame) -> DataFrame:
    """Edges (a, b) that connect all of prints(fp) that are at most four bits apart, through the words within two bits of both."""
    masks = [0, *(1 << i for i in range(64)), *((1 << i) | (1 << j) for i, j in combinations(range(64), 2))]
    flips = np.array(masks, dtype=np.uint64)

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for x in own:
                yield pa.RecordBatch.from_arrays([pa.array((flips ^ x).view(np.int64)), pa.array(np.full(len(flips), x).view(np.int64))], names=["word", "fp"])

    named = prints.select("fp").mapInArrow(expand, "word long, fp long")
    least = F.min("fp").over(W.partitionBy("word"))
    return named.select("fp", least.alias("a")).where("a < fp").select("a", F.col("fp").alias("b")).distinct()


def _classified(docs: DataFrame, words: int, largest: int) -> DataFrame:
    """(doc_id, hash, fp, root, component_id): root names the component by one of its fingerprints."""
    text_batches(docs.sparkSession)
    text = F.coalesce("text", F.lit(""))
    prints = materialize(docs.select(F.col("doc_id").alias("doc_id"), F.xxhash64(text).alias("hash"), fingerprint_column(F.col("text"), words).alias("fp")), "prints")
    classes = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "classes")
    edges = materialize(links(classes, largest), "links")
    dense = edges.where("a = b").select(F.col("a").alias("fp")).distinct()
    plain = edges.where("a < b")
    if dense.limit(1).count():
        plain = plain.union(spheres(dense))
    found = components(plain)
    of = classes.join(found.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("component", "fp").alias("root"))
    of = materialize(of, "roots")
    least = of.groupBy("root").agg(F.min("first").alias("component_id"))
    return prints.join(of.join(least, "root").select("fp", "root", "component_id"), "fp").select("doc_id", "hash", "fp", "root", "component_id")


def near_duplicates(docs: DataFrame, words: int = WORDS, largest: int = 20_000) -> DataFrame:
    """(doc_id, fp, component_id) of each row of docs(doc_id, text).

    component_id is the smallest doc_id reachable over links of at most four bits. Null and empty
    texts have fingerprint zero and are linked like any other; equal rows get equal results; a null
    doc_id is the smallest of none but nulls; other columns are ignored; an empty table gives no rows.
    """
    return _classified(docs, words, largest).select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, words: int = WORDS, largest: int = 20_000) -> DataFrame:
    """One row of docs of each component, all columns: that of the smallest doc_id, then the smallest text hash."""
    found = _classified(docs, words, largest)
    first = found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "hash")).alias("first"))
    keepers = first.select(F.col("first.doc_id").alias("__id"), F.col("first.hash").alias("__hash"))
    own = docs.withColumn("__own", F.xxhash64(F.coalesce("text", F.lit(""))))
    kept = own.join(keepers, own["doc_id"].eqNullSafe(keepers["__id"]) & (own["__own"] == keepers["__hash"]), "left_semi")
    return kept.dropDuplicates(["doc_id", "__own"]).select(*docs.columns)


def hex_column(fp: str) -> Column:
    return F.lower(F.lpad(F.hex(F.col(fp)), 16, "0"))
