"""Deletes repeated runs of lines, found with a suffix array over line ids.

Lines that hold a word become ids; every document is a sequence of them, and a suffix starts at
every line that occurs elsewhere and ends before the first that does not. The suffix array is built
by distributed prefix doubling: the rank of a suffix by its first 2k lines is the rank of the pair
(rank by k lines here, rank by k lines k lines further on). Ranks come from a range exchange of the
distinct pairs, counted before the exchange, so a line that opens a third of all suffixes is one row
there. Doubling ends when no two suffixes share so many lines.

The suffixes of one rank are an LCP interval: a stretch of the suffix array whose members share k
lines. Of the occurrences of an interval's run, the first in the order of (doc_id, text hash, line)
stays and the later ones go, if the run has at least two lines or is one long line: one with at least
49 blanks (U+0020), as a line of 50 words has that are set apart by single blanks. A maximal run of n lines is covered by the intervals of the power of two below n at each
of its lines, so the rounds' intervals delete exactly what all intervals do. The LCP array proper is
read off for neighbours in the suffix array by comparing ranks from the longest prefix down, and
tells the longest run that each document shares.

Only built-in functions are used. Positions are longs: the document's number and the line's, which
gets as many bits as the longest document needs; what doesn't fit 63 bits is an error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ridgeline.llm.common import dense_ids, drop_table, materialize, ordered_ids

#: Bits of a position that number the lines of a document, where nothing else is said.
LINE_BITS = 25
LONG_BLANKS = 49
_SPACE_CHARS = " \t\n\x0b\f\r"


def _has_word(line: Column) -> Column:
    return F.length(F.btrim(line, F.lit(_SPACE_CHARS))) > 0


def sequences(docs: DataFrame) -> DataFrame:
    """(doc, doc_id, hash, lines) of each distinct (doc_id, text): doc numbers them in order; lines are
    struct(h1, h2, at, long) of the lines with a word: a 128-bit id, the line's place and if it is long."""
    text = F.coalesce("text", F.lit(""))
    numbered = F.transform(
        F.split(text, "\n", -1),
        lambda x, i: F.struct(
            F.xxhash64(x).alias("h1"),
            F.xxhash64(F.lit("line"), x).alias("h2"),
            i.alias("at"),
            (F.length(x) - F.length(F.replace(x, F.lit(" "))) >= LONG_BLANKS).alias("long"),
            _has_word(x).alias("word"),
        ),
    )
    lines = docs.select(F.col("doc_id").alias("doc_id"), F.xxhash64(text).alias("hash"), F.filter(numbered, lambda s: s["word"]).alias("lines"))
    placed = lines.groupBy("doc_id", "hash").agg(F.first("lines").alias("lines"))
    return dense_ids(placed, ["doc_id", "hash"], "doc")


def doubling(lines: DataFrame, n_lines: int | None = None, bits: int = LINE_BITS) -> list[DataFrame]:
    """Tables (at, rank, whole, n, first), the i-th for prefixes of 2**i lines, of the suffixes that begin with a line that
    occurs elsewhere. lines has (at, h1, h2).

    rank orders the prefixes, one that ends early before its continuations; whole tells that it does not end early; n and
    first are the number and the first position of the suffixes of that rank.
    """
    names = lines.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min("at").alias("first")).where("n > 1")
    own = lines.select("at", "h1", "h2").join(ordered_ids(names, ["h1", "h2"], "rank"), ["h1", "h2"])
    levels = [materialize(own.select("at", "rank", F.lit(True).alias("whole"), "n", "first"), "level1", n_lines)]
    n = levels[0].count()
    k = 1
    while levels[-1].where("whole and n > 1").limit(1).count():
        ahead = W.partitionBy(F.shiftright("at", bits)).orderBy("at").rangeBetween(k, k)
        far = F.first(F.struct("rank", "whole")).over(ahead)
        pairs = levels[-1].select("at", "rank", far.alias("__far"), F.col("whole").alias("__near"))
        pairs = pairs.select("at", "rank", F.coalesce("__far.rank", F.lit(-1).cast("long")).alias("next"), (F.col("__near") & F.coalesce("__far.whole", F.lit(False))).alias("whole"))
        names = pairs.groupBy("rank", "next").agg(F.count("*").alias("n"), F.min("at").alias("first"))
        ranked = ordered_ids(names, ["rank", "next"], "longer")
        k *= 2
        levels.append(materialize(pairs.join(ranked, ["rank", "next"]).select("at", F.col("longer").alias("rank"), "whole", "n", "first"), f"level{k}", n))
    return levels


def longest_common_prefixes(levels: list[DataFrame]) -> DataFrame:
    """(at, lcp): the larger LCP of each suffix with its neighbours in the suffix array, which no other suffix exceeds."""
    ranks = levels[0].select("at", F.array(F.when(F.col("whole"), F.col("rank"))).alias("ranks"))
    for level in levels[1:-1]:
        ranks = ranks.join(level.where("whole and n > 1").select("at", "rank"), "at", "left").select("at", F.concat("ranks", F.array("rank")).alias("ranks"))
    n = levels[0].count()
    ranks = materialize(ranks, "ranks", n)
    order = materialize(dense_ids(levels[-1].select("at", "rank"), ["rank", "at"], "i", n), "suffixes", n)
    before = order.select((F.col("i") + 1).alias("i"), F.col("at").alias("b"))
    left = order.select("i", F.col("at").alias("a")).join(before, "i").select("a", "b", F.lit(0).cast("long").alias("lcp"))
    done = None
    for step in range(len(levels)):  # each step adds a smaller power of two
        here, there = ranks.select(F.col("at").alias("__a"), F.col("ranks").alias("__ra")), ranks.select(F.col("at").alias("__b"), F.col("ranks").alias("__rb"))
        both = left.withColumn("__a", F.col("a") + F.col("lcp")).withColumn("__b", F.col("b") + F.col("lcp")).join(here, "__a", "left").join(there, "__b", "left")
        same = F.coalesce(F.size(F.filter(F.zip_with("__ra", "__rb", lambda x, y: x == y), lambda z: F.coalesce(z, F.lit(False)))), F.lit(0))
        met = both.select("a", "b", "lcp", same.alias("same"))
        met = materialize(met.select("a", "b", (F.col("lcp") + F.when(F.col("same") > 0, F.pow(F.lit(2.0), F.col("same") - 1)).otherwise(0)).cast("long").alias("lcp"), "same"), f"lcp{step}", n)
        ended = met.where("same < 2").select("a", "b", "lcp")
        done = ended if done is None else done.union(ended)
        left = met.where("same >= 2").select("a", "b", "lcp")
        if not left.limit(1).count():
            break
    drop_table(ranks)
    drop_table(order)
    return done.select("lcp", F.explode(F.array("a", "b")).alias("at")).groupBy("at").agg(F.max("lcp").alias("lcp"))


def repeated_runs(docs: DataFrame) -> DataFrame:
    """(doc_id, hash, gone, longest): for each distinct (doc_id, text) with a line that occurs elsewhere, the
    places of the lines to delete (may be empty) and the length of its longest run that occurs elsewhere."""
    placed = sequences(docs)
    found = materialize(placed, "sequences")
    drop_table(placed)
    n_lines, longest, last = found.agg(F.sum(F.size("lines")), F.max(F.size("lines")), F.max("doc")).first()
    n_lines, bits = n_lines or 0, max(1, (longest or 0).bit_length())  # as many bits as the longest document needs
    if (last or 0) >> (63 - bits):
        raise ValueError(f"{last} documents of up to {longest} lines cannot be numbered in 63 bits")
    lines = found.select("doc", F.posexplode("lines").alias("__i", "__s")).select((F.shiftleft("doc", bits) + F.col("__i")).alias("at"), "__s.h1", "__s.h2", F.col("__s.at").alias("line"), "__s.long")
    lines = materialize(lines, "lines", n_lines)
    levels = doubling(lines, n_lines, bits)
    lcp = longest_common_prefixes(levels)
    later = F.col("at") != F.col("first")
    runs = lines.where("long").join(levels[0].where(later).select("at"), "at").select("at", F.lit(1).cast("long").alias("run"))
    for i, level in enumerate(levels[1:-1], 1):
        runs = runs.union(level.where(later & F.col("whole")).select("at", F.lit(1 << i).cast("long")))
    runs = runs.groupBy("at").agg(F.max("run").alias("run"))
    marked = lcp.join(lines.select("at", "line"), "at").join(runs, "at", "left")
    doc = F.shiftright("at", bits)
    so_far = W.partitionBy(doc).orderBy("at").rowsBetween(W.unboundedPreceding, 0)
    covered = marked.select(doc.alias("doc"), "line", "lcp", (F.max(F.col("at") + F.coalesce("run", F.lit(0))).over(so_far) > F.col("at")).alias("covered"))
    by_doc = covered.groupBy("doc").agg(F.collect_list(F.when(F.col("covered"), F.col("line"))).alias("gone"), F.max("lcp").alias("longest"))
    out = materialize(found.select("doc", "doc_id", "hash").join(by_doc, "doc").select("doc_id", "hash", "gone", "longest"), "runs")
    for used in (found, lines, lcp, *levels):
        drop_table(used)
    return out


def dedup_lines(docs: DataFrame) -> DataFrame:
    """docs with text without the lines of later copies, and n_lines, n_removed and longest_repeat.

    n_lines counts the lines that hold a word, n_removed those of them that go; lines without a word
    always stay. Rows equal in doc_id and text are one document and all get its result; of rows that
    share only the doc_id the one with the smaller text hash is earlier; null doc_ids are first. A
    null text has no lines and stays null. Other columns stay as they are, but for those three names,
    which are replaced. An empty table gives an empty one.
    """
    own = repeated_runs(docs.select("doc_id", "text")).select(F.col("doc_id").alias("__id"), F.col("hash").alias("__hash"), F.col("gone").alias("__gone"), F.col("longest").alias("__longest"))
    kept = [c for c in docs.columns if c not in ("n_lines", "n_removed", "longest_repeat")]
    base = docs.select(*kept).withColumn("__own", F.xxhash64(F.coalesce("text", F.lit(""))))
    both = base.join(own, base["doc_id"].eqNullSafe(own["__id"]) & (base["__own"] == own["__hash"]), "left")
    rest = F.transform(
        F.array(F.split("text", "\n", -1)),
        lambda ls: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(ls) - 1), F.col("__gone")), lambda i: F.get(ls, i)), "\n"),
    )
    cut = F.when(F.size("__gone") > 0, F.get(rest, F.lit(0))).otherwise(F.col("text"))
    words = F.coalesce(F.size(F.filter(F.split("text", "\n", -1), _has_word)), F.lit(0))
    words = F.when(F.col("text").isNull(), 0).otherwise(words)
    return both.select(
        *[cut.alias("text") if c == "text" else F.col(c) for c in kept],
        words.cast("long").alias("n_lines"),
        F.coalesce(F.size("__gone"), F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce("__longest", F.lit(0)).cast("long").alias("longest_repeat"),
    )
