"""Near-duplicates by SimHash and Golay-code fuzzy hashing, compared as sets of word shingles; no pair is left to chance.

Two texts are linked if their sets of five-word shingles have a Jaccard similarity of 0.8 or more: five
times the overlap is at least four times the union.

* A set of n shingles that is linked to another shares all but n // 5 of its shingles. Those that hold
  more that no other set has are put aside, first by a fixed third of all hashes, so that what is
  exchanged for all texts is a third of their shingles.
* The sets that are left get wide fingerprints, whose Golay indices name the candidates
  (golay_simhash.candidates). The sets of a connected component of candidates go to one task, which
  compares them as sets and grows a spanning forest. That links nearly all that there is to link.
* Fingerprints bound no similarity, so the pairs that they left apart are looked for exactly: each set
  names its n // 5 + 1 rarest shingles, and linked sets name a common one (prefix filtering). Only the
  sets that name one in common with a set of another forest are compared, and only with such sets.

A component of more than BLOCK shingles is dealt into blocks by the hash of the set, and each pair of
blocks is a task. Every link lies within some pair, and the forests of the pairs together connect what
the links do, so this is exact as well; each set is sent once for each other block of its component.

Shingles are 64-bit hashes, and a set is known by the hash of its sorted shingles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridgeline.llm import golay_simhash
from ridgeline.llm.common import drop_table, materialize, text_batches
from ridgeline.llm.components import components

WORDS = 5
SEED = 42
#: Hashes below this one, a third of all, are looked at first.
FIRST = (1 << 64) // 3
#: Shingles of about one block of a component; a task holds two blocks, or one larger set.
BLOCK = 500_000
#: Rows of (doc_id, hash) that may be broadcast; more are joined by exchange.
BROADCAST_ROWS = 500_000


def shingles(text: bytes | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of the word shingles; a text of fewer words is one shingle."""
    own = (text or b"").lower().split()  # bytes: A-Z only, and ASCII white space
    if len(own) < words:
        own, words = [b" ".join(own)], 1
    line = memoryview(b" ".join(own))
    ends = np.cumsum(np.fromiter(map(len, own), dtype=np.int64, count=len(own)) + 1)
    starts = np.r_[0, ends[:-1]][: len(own) - words + 1].tolist()
    ends = (ends[words - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(line[a:b], SEED) for a, b in zip(starts, ends, strict=True)], dtype="<u8"))


def _lists(parts: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, parts)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(parts).view(np.int64) if parts else np.zeros(0, dtype=np.int64)))


def _sets(texts: DataFrame, words: int, first: int | None) -> DataFrame:
    """(doc_id, hash, set, n, shingles) of texts(doc_id, hash, text): shingles only below first, if given, else with the wide fingerprint (print, again)."""
    kind = texts.schema["doc_id"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [shingles(x, words) for x in batch.column(2).to_pylist()]
            names = np.array([xxhash.xxh64_intdigest(x.tobytes(), SEED) for x in own], dtype=np.uint64).view(np.int64)
            parts = own if first is None else [x[: np.searchsorted(x, np.uint64(first))] for x in own]
            columns = {"doc_id": batch.column(0), "hash": batch.column(1), "set": pa.array(names), "n": pa.array(list(map(len, own)), pa.int64()), "shingles": _lists(parts)}
            if first is None:
                prints = np.array([golay_simhash.wide_print(x) for x in own], dtype=np.uint64).view(np.int64).reshape(-1, 2)
                columns |= {"print": pa.array(prints[:, 0]), "again": pa.array(prints[:, 1])}
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    more = ", print long, again long" if first is None else ""
    return texts.select("doc_id", "hash", F.col("text").cast("binary").alias("text")).mapInArrow(cut, f"doc_id {kind}, hash long, set long, n long, shingles array<long>{more}")


def forest(names: np.ndarray, roots: np.ndarray, tokens: np.ndarray, sizes: np.ndarray) -> list[tuple[int, int]]:
    """Edges that, with what connects sets of equal roots already, span the graph that links sets of a similarity of 0.8 or more.

    tokens has the sets one after the other.
    """
    codes = np.unique(tokens, return_inverse=True)[1].astype(np.int32)
    starts = np.r_[0, np.cumsum(sizes)[:-1]]
    held = np.zeros(int(codes.max()) + 1, dtype=bool)
    out, left = [], np.arange(len(names))
    flat, at = codes, starts  # of those that are left
    while len(left):
        queue, left = [left[0]], left[1:]
        flat, at = flat[sizes[queue[0]] :], at[1:] - sizes[queue[0]]
        while queue and len(left):
            own = queue.pop()
            mine = codes[starts[own] : starts[own] + sizes[own]]
            held[mine] = True
            both = np.add.reduceat(held[flat], at, dtype=np.int64)
            held[mine] = False
            near = 5 * both >= 4 * (sizes[left] + sizes[own] - both)
            known = roots[left] == roots[own]
            out += [(int(names[own]), int(names[x])) for x in left[near & ~known]]
            near |= known
            if near.any():
                queue += left[near].tolist()
                flat, left = flat[np.repeat(~near, sizes[left])], left[~near]
                at = np.r_[0, np.cumsum(sizes[left])[:-1]].astype(np.int64)
    return out


def _within(grouped: DataFrame) -> DataFrame:
    """Edges (a, b) of the linked sets of different roots of grouped(component, set, root, shingles)."""

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        now = None

        def done() -> Iterator[pa.RecordBatch]:
            names, roots, tokens, sizes = (np.concatenate(x) for x in zip(*held, strict=True))
            found = np.array(forest(names, roots, tokens, sizes), dtype=np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(found.min(axis=1)), pa.array(found.max(axis=1))], names=["a", "b"])

        for batch in batches:
            keys, names, roots = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            lists = batch.column(3)
            ends = lists.offsets.to_numpy()
            tokens = lists.values.to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
            for i, j in zip(cuts[:-1], cuts[1:], strict=True):
                if i == j:
                    continue
                if held and keys[i] != now:
                    yield from done()
                    held = []
                now = keys[i]
                held.append((names[i:j].copy(), roots[i:j].copy(), tokens[ends[i] : ends[j]].copy(), np.diff(ends[i : j + 1]).astype(np.int64)))
        if held:
            yield from done()

    return grouped.select("component", "set", "root", "shingles").repartition("component").sortWithinPartitions("component", "set").mapInArrow(link, "a long, b long")


def _dealt(sets: DataFrame, near: DataFrame, block: int) -> DataFrame:
    """(component, set, root, shingles) of near(set, root, component), with a component of more than block shingles split into one for each pair of its blocks.

    The splits are found on rows without shingles, so shingles are exchanged by set and by task only.
    """
    narrow = near.join(sets.select("set", "n"), "set")
    wide = narrow.groupBy("component").agg(F.sum("n").alias("__n")).where(F.col("__n") > block)
    blocks = wide.select("component", F.ceil(F.col("__n") / block).cast("int").alias("__blocks"))
    own = F.pmod(F.xxhash64("set"), "__blocks").cast("int")
    others = F.filter(F.sequence(F.lit(0), F.col("__blocks") - 1), lambda i: i != own)
    others = F.transform(others, lambda i: F.xxhash64("component", F.least(own, i), F.greatest(own, i)))
    keys = F.when(F.col("__blocks").isNull(), F.array("component")).otherwise(others)
    tasks = narrow.join(blocks, "component", "left").select("set", "root", keys.alias("__tasks"))
    return sets.join(tasks, "set").select(F.explode("__tasks").alias("component"), "set", "root", "shingles")


def print_links(sets: DataFrame, block: int = BLOCK) -> DataFrame:
    """Edges (a, b) over sets(set, n, print, again, shingles) that connect the linked sets whose fingerprints make them candidates."""
    edges = materialize(golay_simhash.candidates(sets), "candidates")
    near = components(edges).select(F.col("node").alias("set"), F.col("node").alias("root"), "component")
    drop_table(edges)
    return _within(_dealt(sets, near, block))


def rest_links(sets: DataFrame, roots: DataFrame, block: int = BLOCK) -> DataFrame:
    """Edges (a, b) over sets(set, n, shingles) that connect, with what connects sets of one root of roots(set, root), all that are linked.

    Sets that roots doesn't have are their own.
    """
    each = sets.select("set", "n", F.explode("shingles").alias("shingle"))
    often = each.groupBy("shingle").agg(F.count("*").alias("times")).where("times > 1")
    shared = each.join(often, "shingle").groupBy("set").agg(F.first("n").alias("n"), F.sort_array(F.collect_list(F.struct("times", "shingle"))).alias("shared"))
    # the rarest are those that no other set has, then these
    take = F.expr("cast(n div 5 + 1 - (n - size(shared)) as int)")
    named = shared.where(take > 0).select("set", F.explode(F.slice("shared", F.lit(1), take)).alias("s")).select("set", "s.shingle")
    named = materialize(named.join(roots, "set", "left").select("set", F.coalesce("root", "set").alias("root"), "shingle"), "named")
    # every set is joined to the least one of each shingle that sets of several roots name: minima combine before the exchange, and a hot shingle's rows can be split
    least = named.groupBy("shingle").agg(F.min("set").alias("a"), F.min("root").alias("__least"), F.max("root").alias("__most")).where("__least < __most").select("shingle", "a")
    edges = materialize(named.join(least, "shingle").where("a < set").select("a", F.col("set").alias("b")).distinct(), "shares")
    drop_table(named)
    near = components(edges).withColumnRenamed("node", "set").join(roots, "set", "left")
    drop_table(edges)
    return _within(_dealt(sets, near.select("set", F.coalesce("root", "set").alias("root"), "component"), block))


def links(sets: DataFrame, block: int = BLOCK) -> DataFrame:
    """Edges (a, b) over sets(set, n, print, again, shingles) that connect all that are linked, as a table. Edges of a split component may repeat."""
    found = materialize(print_links(sets, block), "found")
    roots = components(found).select(F.col("node").alias("set"), F.col("component").alias("root"))
    out = materialize(found.union(rest_links(sets, roots, block)), "links")
    for done in (found, roots):
        drop_table(done)
    return out


def _small(rows: DataFrame) -> DataFrame:
    """rows of two longs, broadcast where a count shows that they are few, so that no text is exchanged for them."""
    return F.broadcast(rows) if rows.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else rows


def keep_one(docs: DataFrame, words: int = WORDS, block: int = BLOCK) -> DataFrame:
    """One row of docs(doc_id, text, ...) of each component of linked texts, all columns: that of the smallest doc_id, then the smallest text hash.

    Null and empty texts are equal; a null doc_id counts as the largest. Texts of any length are read whole, equal rows
    are one, an empty table gives none, and columns named as those of the steps in between (__own, hash, n) stay.
    """
    text_batches(docs.sparkSession)
    own = F.xxhash64(F.coalesce("text", F.lit("")))
    texts = docs.select("doc_id", own.alias("hash"), "text")
    rows = materialize(_sets(texts, words, FIRST), "sets")
    names = materialize(rows.groupBy("doc_id", "hash").agg(F.first("set").alias("set"), F.first("n").alias("n"), F.count("*").alias("rows")), "names")
    sets = materialize(names.groupBy("set").agg(F.first("n").alias("n"), F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "hash")).alias("first")), "classes")
    alone = rows.select("set", F.explode("shingles").alias("shingle")).groupBy("shingle").agg(F.min("set").alias("set"), F.max("set").alias("__other")).where("set = __other").groupBy("set").agg(F.count("*").alias("alone"))
    some = sets.join(alone, "set", "left").where(F.coalesce("alone", F.lit(0)) <= F.expr("n div 5"))
    some = materialize(some.select(F.col("first.doc_id").alias("__id"), F.col("first.hash").alias("__hash")), "some")
    drop_table(rows)
    again = texts.join(_small(some), F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("hash") == F.col("__hash")), "left_semi")
    whole = materialize(_sets(again, words, None).dropDuplicates(["set"]).drop("doc_id", "hash"), "whole")
    edges = links(whole, block)
    drop_table(whole)
    found = components(edges).withColumnRenamed("node", "set")
    drop_table(edges)
    rooted = materialize(sets.join(found, "set", "left").select("set", F.coalesce("component", "set").alias("root"), "first"), "rooted")
    keepers = rooted.groupBy("root").agg(F.min("first").alias("keeper"))
    judged = names.join(rooted.select("set", "root"), "set").join(keepers, "root")
    gone = judged.where(~(F.col("doc_id").eqNullSafe(F.col("keeper.doc_id")) & (F.col("hash") == F.col("keeper.hash"))))
    gone = materialize(gone.select(F.col("doc_id").alias("__id"), F.col("hash").alias("__hash")), "gone")
    kept = docs.withColumn("__own", own).join(_small(gone), F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__own") == F.col("__hash")), "left_anti")
    # whole rows are exchanged once more only if there are rows equal in doc_id and text
    if names.where("rows > 1").limit(1).count():
        kept = kept.dropDuplicates(["doc_id", "__own"])
    for done in (names, sets, some, rooted):
        drop_table(done)
    return kept.select(*docs.columns)
