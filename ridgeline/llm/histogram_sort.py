"""Sharding by histogram sort: shards of near equal bytes, in the order of a key, with one exchange.

The key is the hash of the text, then the hash of the doc_id, then that of the row's place in a
written table, so equal texts stand together and any group of rows can be divided. For each splitter
the bytes below candidate boundaries are counted exactly, with a map-side sum per histogram cell:
first over the top bits of the whole key space, then over the next bits of only the cells that hold an
unsettled splitter. A splitter settles when a boundary's exact bytes are within the tolerance of its
target, or when one row is left around it. At most CELLS counts reach the driver in a round.

A shard has one splitter at its start and, if there are more tasks than shards, others inside it. The
splitters decide where a row goes in the one exchange: each row finds its range through a table with
a row for each of the 4096 values of its key's top bits, and the range is the task that gets it.
"""

from __future__ import annotations

from bisect import bisect_left

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridgeline.llm.common import materialize

KEYS = ("key1", "key2", "key3")
CELLS = 1 << 16  # counts in one round
TOP = 12  # bits of a row's first key that name its place in the table of ranges
RANGES = 4_096  # tasks at most, and so boundaries in that table
_LOW, _HIGH = -(1 << 63), 1 << 63

Boundary = tuple[int, int, int]


def splitters(rows: DataFrame, parts: int, tolerance: float, per: int = 1) -> list[Boundary]:
    """Ascending boundaries: part i starts at boundary i - 1. rows has (key1, key2, key3, size).

    Every per-th boundary is within the tolerance, a share of per parts' bytes, of its target; those
    between may be ten times as far off.
    """
    total = rows.agg(F.sum("size")).first()[0] or 0
    if not total:
        return [(_HIGH, _LOW, _LOW)] * (parts - 1)
    targets = [total * i // parts for i in range(1, parts)]
    near = [tolerance * total * per / parts * (1 if i % per == 0 else 10) for i in range(1, parts)]
    found: list[Boundary | None] = [None] * len(targets)
    # of each splitter: the first keys, which are settled, the cell of the next key and its bits, and the bytes before it
    state: list[tuple[tuple[int, ...], int | None, int, int]] = [((), None, 0, 0)] * len(targets)
    while any(x is None for x in found):
        open_cells = {s[:3] for s, x in zip(state, found, strict=True) if x is None}
        step = max(1, min(10, (CELLS // len(open_cells)).bit_length() - 1))
        counts: dict = {}
        for level, bits in sorted({(len(c[0]), c[2]) for c in open_cells}):  # the cells of one depth are counted together
            counts |= _count(rows, level, bits, step, {c for c in open_cells if (len(c[0]), c[2]) == (level, bits)})
        for i, target in enumerate(targets):
            if found[i] is not None:
                continue
            settled, cell, bits, below = state[i]
            for at, weight, low, high in counts[settled, cell, bits]:
                if below + weight >= target:
                    break
                below += weight
            gaps = (target - below, below + weight - target)
            if min(gaps) <= near[i] or (low == high and len(settled) == len(KEYS) - 1):
                found[i] = tuple([*settled, low if gaps[0] <= gaps[1] else high + 1, _LOW, _LOW][: len(KEYS)])
            elif low == high:
                state[i] = ((*settled, low), None, 0, below)
            else:
                state[i] = (settled, at, min(64, bits + step), below)
    return sorted(found)


def _count(rows: DataFrame, level: int, bits: int, step: int, cells: set) -> dict:
    """The histograms of open cells of one depth, in one job: (cell, bytes, least key, greatest key), ascending."""
    key, deeper = KEYS[level], min(64, bits + step)
    for i in range(level):
        rows = rows.where(F.col(KEYS[i]).isin(sorted({c[0][i] for c in cells})))
    if bits:
        rows = rows.where(F.shiftright(key, 64 - bits).isin(sorted({c[1] for c in cells})))
    cell = F.shiftright(key, 64 - deeper) if deeper < 64 else F.col(key)
    found = rows.groupBy(*KEYS[:level], cell.alias("cell")).agg(F.sum("size").alias("w"), F.min(key).alias("low"), F.max(key).alias("high")).collect()
    out: dict = {c: [] for c in cells}
    for r in sorted(found, key=lambda r: r["cell"]):
        own = (tuple(r[k] for k in KEYS[:level]), r["cell"] >> (deeper - bits) if bits else None, bits)
        if own in out:
            out[own].append((r["cell"], r["w"], r["low"], r["high"]))
    return out


def with_range(rows: DataFrame, boundaries: list[Boundary], name: str) -> DataFrame:
    """rows with how many boundaries are at or below their keys, through a table of 2**TOP rows that is broadcast."""
    shift = 64 - TOP
    table = []
    for cell in range(-(1 << (TOP - 1)), 1 << (TOP - 1)):
        a, b = bisect_left(boundaries, (cell << shift, _LOW, _LOW)), bisect_left(boundaries, ((cell + 1) << shift, _LOW, _LOW))
        inner = [tuple(min(x, _HIGH - 1) for x in t) + (any(x >= _HIGH for x in t),) for t in boundaries[a:b]]
        table.append((cell, a, inner))
    kind = "array<struct<key1:long,key2:long,key3:long,after:boolean>>"
    cells = rows.sparkSession.createDataFrame(table, f"__cell long, __base int, __inner {kind}")
    own = F.struct(*KEYS)
    # a boundary after the greatest key of its kind is above the keys that equal it
    below = F.filter("__inner", lambda b: (F.struct(b["key1"], b["key2"], b["key3"]) < own) | (~b["after"] & (F.struct(b["key1"], b["key2"], b["key3"]) == own)))
    joined = rows.withColumn("__cell", F.shiftright("key1", shift)).join(F.broadcast(cells), "__cell")
    return joined.withColumn(name, F.col("__base") + F.size(below)).drop("__cell", "__base", "__inner")


def shard_by_bytes(docs: DataFrame, shards: int = 16, tolerance: float = 0.001, carry: list[str] | None = None, tasks: int | None = None) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot, *carry) of every row of docs(doc_id, text).

    size is the text's UTF-8 bytes plus 1 (null: no bytes, the checksum of nothing). Shards differ
    from equal bytes by no more than the tolerance at each end, or the row at the boundary, whatever
    rows are equal: repeated rows and null doc_ids are rows like others. Slots count each shard's rows
    from 0 in key order. Rows are exchanged once, to as many tasks as spark.sql.shuffle.partitions has,
    or tasks if given, rounded up to a multiple of the shards; carry names columns to take along,
    whatever their names; an empty table gives no rows.
    """
    spark = docs.sparkSession
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(
        F.col("doc_id").alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("key1"),
        F.xxhash64("doc_id", F.lit("order")).alias("key2"),
        F.xxhash64(F.monotonically_increasing_id()).alias("key3"),  # it is written, and so stays what it is
        *[F.col(c).alias(f"__c{i}") for i, c in enumerate(carry or [])],
    )
    rows = materialize(rows, "keys")
    per = max(1, min(RANGES, tasks or int(spark.conf.get("spark.sql.shuffle.partitions"))) // shards)
    parts = shards * per
    placed = with_range(rows, splitters(rows.select(*KEYS, "size"), parts, tolerance, per), "__range")
    sent = placed.repartitionById(parts, "__range").sortWithinPartitions("__range", *KEYS)
    sent = materialize(sent.withColumn("__at", F.monotonically_increasing_id()), "placed")
    firsts = {r["__range"]: (r["at"], r["n"]) for r in sent.groupBy("__range").agg(F.min("__at").alias("at"), F.count("*").alias("n")).collect()}  # a row a task
    starts, before = [], 0
    for i in range(parts):
        before = before if i % per else 0
        at, n = firsts.get(i, (0, 0))
        starts.append((i, at - before))
        before += n
    offsets = spark.createDataFrame(starts, "__range int, __first long")
    out = sent.join(F.broadcast(offsets), "__range")
    slot = F.col("__at") - F.col("__first")
    return out.select("doc_id", "size", "text_crc32", F.floor(F.col("__range") / per).cast("int").alias("shard"), slot.alias("slot"), *[F.col(f"__c{i}").alias(c) for i, c in enumerate(carry or [])])
