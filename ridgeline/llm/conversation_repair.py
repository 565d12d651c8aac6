"""Conversation structure repair: the cheapest edits that make the roles of a conversation legal.

Legal are no rows, or an optional system row and then user and assistant in turn, ending with the assistant.
Edits go along the rows: Keep, Rerole (to user or assistant), Delete, and Insert of an empty row anywhere.

The choice is a shortest path in a DAG whose nodes are (row, state of the grammar). Minimum costs forward from
the start and backward from the end tell which arcs are tight, on some cheapest path; of these a traversal
follows all at once, as a set of states at a row, and takes the least letter that leaves the set at each step.
So the audit, the letters in order, is the least of all cheapest ones.

Rows are sorted by conversation and turn over all tasks. A conversation within a task is repaired there. One
that reaches a task's edge, or is long, is left as rows: each task's share of it, a fragment, gives the costs
between its states at both ends, 16 numbers; fragments are put together in order, and then each one is traversed
alone. So a conversation of any length is dealt over tasks. Only the digest of its repaired text is serial by
nature: it reads the rows of one conversation in order, and keeps none.

Fixed beyond the costs: rows of equal turn stand in order of the sha256 of their role and text; a role counts by
its first letter, s, u or a.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridgeline.llm.common import SPACE, drop_table, materialize, text_batches

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: States: nothing yet, after system, after user, after assistant. Letters of roles lead from one to the next.
STATES = 4
MOVES = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
ENDS = (0, 3)
NAMES = {1: "system", 2: "user", 3: "assistant"}
LETTERS = "sua"
FREE = [[MOVES[s, x] for x in "ua" if (s, x) in MOVES] for s in range(STATES)]  # where Rerole and Insert lead
_FAR = 1 << 60
#: A conversation of more rows or characters than these is left to fragments.
MOST_ROWS, MOST_CHARS = 10_000, 8_000_000
_LONG = (1 << 63) - 1

Costs = tuple[int, ...]


def _plain(costs: list[int]) -> tuple[Costs, int]:
    """Costs less their least, and that."""
    least = min(costs)
    return tuple(x - least if x < _FAR else _FAR for x in costs), least


def _closed(costs: list[int], back: bool) -> list[int]:
    """Costs with any number of inserts, after (forward) or before (backward) them."""
    for _ in range(STATES):
        for s in range(STATES):
            for t in FREE[s]:
                if back:
                    costs[s] = min(costs[s], costs[t] + INSERT)
                else:
                    costs[t] = min(costs[t], costs[s] + INSERT)
    return costs


@lru_cache(maxsize=None)
def _arcs(code: int) -> list[tuple[str, int, int, int]]:
    """(letter, from, to, cost) of the edits of a row. code: its role's place in LETTERS, or 3, times 3, plus 0, 1 (must go) or 2 (truncated)."""
    role, fault = divmod(code, 3)
    out = [("D", s, s, DELETE) for s in range(STATES)]
    more = TRUNCATED if fault == 2 else 0
    if fault != 1:
        out += [("K", s, MOVES[s, LETTERS[role]], KEEP + more) for s in range(STATES) if role < 3 and (s, LETTERS[role]) in MOVES]
        out += [("R", s, t, REROLE + more) for s in range(STATES) for t in FREE[s]]
    return out


START: Costs = (0, _FAR, _FAR, _FAR)
END: Costs = tuple(_closed([0 if s in ENDS else _FAR for s in range(STATES)], back=True))


@lru_cache(maxsize=1 << 16)
def _forward(costs: Costs, code: int) -> tuple[Costs, int]:
    """Costs at the place after a row, of those before it; less the least, and that."""
    before, after = _closed(list(costs), back=False), [_FAR] * STATES
    for _, s, t, c in _arcs(code):
        after[t] = min(after[t], before[s] + c)
    return _plain(after)


@lru_cache(maxsize=1 << 16)
def _backward(costs: Costs, code: int) -> tuple[Costs, int]:
    """Costs at the place before a row to the end, of those after it."""
    before = [_FAR] * STATES
    for _, s, t, c in _arcs(code):
        before[s] = min(before[s], costs[t] + c)
    return _plain(_closed(before, back=True))


def _bits(frontier: int) -> list[int]:
    return [s for s in range(STATES) if frontier >> s & 1]


@lru_cache(maxsize=1 << 16)
def _inserted(frontier: int, before: Costs, after: Costs) -> int:
    """The states that tight inserts lead to at a place with these costs from the start (inserts included) and to the end."""
    before = _closed(list(before), back=False)
    least = min(x + y for x, y in zip(before, after, strict=True))
    return sum(1 << t for t in {t for s in _bits(frontier) for t in FREE[s] if before[s] + INSERT + after[t] == least})


@lru_cache(maxsize=1 << 16)
def _step(frontier: int, before: Costs, here: Costs, after: Costs, code: int) -> tuple[str, tuple[int, ...], int]:
    """(letters, states after each, frontier) of the least letters up to and with the edit of one row."""
    letters, seen = "", []
    closed = _closed(list(before), back=False)
    arcs = _arcs(code)
    least = min(closed[s] + c + after[t] for _, s, t, c in arcs)
    while True:
        out: dict[str, int] = {}
        for letter, s, t, c in arcs:
            if frontier >> s & 1 and closed[s] + c + after[t] == least:
                out[letter] = out.get(letter, 0) | 1 << t
        if more := _inserted(frontier, before, here):
            out["I"] = more
        letter = min(out)
        frontier = out[letter]
        letters += letter
        seen.append(_bits(frontier)[0])
        if letter != "I":
            return letters, tuple(seen), frontier


def traverse(codes: list[int], entry: Costs = START, end: Costs = END, frontier: int = 1, last: bool = True) -> tuple[list[tuple[str, tuple[int, ...]]], int]:
    """The edits of a fragment's rows, as letters and the states after each, and the frontier behind it.

    entry and end are the least costs from the start to the fragment and from there to the end. The last fragment
    has one more element, the inserts behind all rows.
    """
    fronts, backs = [entry], [end]
    for code in codes:
        fronts.append(_forward(fronts[-1], code)[0])
    for code in reversed(codes):
        backs.append(_backward(backs[-1], code)[0])
    backs.reverse()
    out = []
    for i, code in enumerate(codes):
        letters, seen, frontier = _step(frontier, fronts[i], backs[i], backs[i + 1], code)
        out.append((letters, seen))
    if last:
        letters, seen = "", []
        while not any(s in ENDS for s in _bits(frontier)):
            frontier = _inserted(frontier, fronts[-1], end)
            letters += "I"
            seen.append(_bits(frontier)[0])
        out.append((letters, tuple(seen)))
    return out, frontier


def passed(codes: list[int], entry: list[int]) -> list[int]:
    """Least costs behind a fragment's rows, of those before it."""
    if min(entry) >= _FAR:
        return entry
    costs, total = _plain(entry)
    for code in codes:
        costs, more = _forward(costs, code)
        total += more
    return [min(x + total, _FAR) for x in costs]


def _pieces(letters: str, seen: tuple[int, ...], role: str, text: str) -> list[str]:
    out = []
    for letter, state in zip(letters, seen, strict=True):
        if letter == "I":
            out.append(f"{NAMES[state]}:")
        elif letter != "D":
            out.append(f"{role if letter == 'K' else NAMES[state]}:{text}")
    return out


def _illegal(initials: list[int]) -> int:
    return sum((a, b) not in ((0, 1), (1, 2), (2, 1)) for a, b in zip(initials[:-1], initials[1:], strict=True))


def _gaps(turns: list[int | None]) -> int:
    own = {t for t in turns if t is not None}
    return min(max(own) - min(own) + 1 - len(own), _LONG) if own else 0


def repaired(rows: list[dict]) -> dict:
    """What there is to say of a whole conversation: its rows in order, dropped ones included."""
    rows = [r for r in rows if not r["dropped"]]
    if not rows:
        return {"gaps": 0, "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "cost": 0, "audit": "", "repaired_sha256": sha256(b"").hexdigest()}
    seen, faults, codes = set(), [0, 0, 0], []
    for r in rows:
        fault = 1 if r["is_blank"] else 2 if r["key"] in seen else 3 if r["is_cut"] else 0
        seen.add(r["key"])
        if fault:
            faults[fault - 1] += 1
        codes.append(r["initial"] * 3 + (1 if fault in (1, 2) else 2 if fault else 0))
    edits, _ = traverse(codes)
    cost = passed(codes, list(START))
    cost = min(a + b for a, b in zip(cost, END, strict=True))
    pieces = [p for r, (letters, states) in zip([*rows, {"role": "", "text": ""}], edits, strict=True) for p in _pieces(letters, states, r["role"], r["text"])]
    return {
        "gaps": _gaps([r["turn"] for r in rows]), "blank": faults[0], "duplicate": faults[1], "truncated": faults[2], "illegal": _illegal([r["initial"] for r in rows]), "cost": cost,
        "audit": "".join(x for x, _ in edits), "repaired_sha256": sha256("\n".join(pieces).encode("utf-8", "surrogatepass")).hexdigest(),
    }


RESULT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
_ROW = ("conv_id", "turn", "role", "text", "key", "initial", "is_blank", "is_cut", "dropped")


def _whole_ones(most_rows: int, most_chars: int):
    """The batch function over sorted rows: results of the conversations within a task; rows of the others, numbered."""
    results = [x.split()[0] for x in RESULT.split(", ")]

    def sorted_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []  # of the conversation that is read
        state = {"n": 0, "chars": 0, "now": None, "loose": True}  # loose: its rows are passed on
        schema = None

        def table(rows: list[dict]) -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist(rows, schema=schema)

        for batch in batches:
            if not batch.num_rows:
                continue
            if schema is None:
                part = batch.column("part")[0].as_py()
                schema = pa.schema([*batch.schema, pa.field("idx", pa.int64()), *[pa.field(x, pa.string() if x in ("audit", "repaired_sha256") else pa.int64()) for x in results], pa.field("done", pa.bool_())])
                state["now"] = ("", batch.column("conv_id")[0].as_py())
            out = []
            for r in batch.to_pylist():
                name = ("", r["conv_id"])
                if name != state["now"]:
                    if held:
                        out.append({"conv_id": held[0]["conv_id"], "part": part, "done": True} | repaired(held))
                        held = []
                    state |= {"now": name, "chars": 0, "loose": False}
                r |= {"idx": state["n"], "done": False}
                state["n"] += 1
                state["chars"] += len(r["text"])
                if not state["loose"] and (len(held) >= most_rows or state["chars"] > most_chars):
                    out += held
                    held, state["loose"] = [], True
                (out if state["loose"] else held).append(r)
            yield table(out)
        if held:
            yield table(held)

    return sorted_out


def damaged(rows: DataFrame) -> DataFrame:
    """conversations(conv_id, turn, role, text) after the damage that the query is defined over; rows it drops stay, marked, without text.

    By crc32 of conv_id:turn modulo 20, nulls being one space: 0 drops a row, 1 empties its text, 2 removes the ends of its
    sentences, 3 repeats it, 4 makes it the user's.
    """
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    d = F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn"))) % 20
    text = F.when(d.isin(0, 1), F.lit("")).when(d == 2, F.regexp_replace(blank("text"), "[.!?]", "")).otherwise(blank("text"))
    role = F.when(d == 4, F.lit("user")).otherwise(blank("role"))
    copies = F.explode(F.when(d == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select("conv_id", F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), (d == 0).alias("dropped"), copies.alias("copy")).drop("copy")


def _judged(rows: DataFrame) -> DataFrame:
    first = F.substr("role", F.lit(1), F.lit(1))
    initial = F.when(first == "s", 0).when(first == "u", 1).when(first == "a", 2).otherwise(3)
    space = SPACE[:-1]
    blank = ~F.rlike("text", F.lit(f"[^{space[1:]}"))
    cut = ~F.rlike("text", F.lit(rf"[.!?]{space}*\z"))
    key = F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256))
    return rows.select("conv_id", "turn", "role", "text", key.alias("key"), initial.cast("int").alias("initial"), blank.alias("is_blank"), cut.alias("is_cut"), "dropped")


def _fragments(codes: DataFrame) -> DataFrame:
    """(own, part, costs, first, last, illegal) of each fragment of codes(own, part, idx, code): costs[4 * s + t] leads from s to t."""

    def measure(group: pa.Table) -> pa.Table:
        group = group.sort_by("idx")
        own = group.column("code").to_pylist()
        costs = [x for s in range(STATES) for x in passed(own, [0 if t == s else _FAR for t in range(STATES)])]
        initials = [c // 3 for c in own]
        return pa.table({"own": group.column("own")[:1], "part": group.column("part")[:1], "costs": pa.array([costs], pa.list_(pa.int64())), "first": pa.array([initials[0]], pa.int32()), "last": pa.array([initials[-1]], pa.int32()), "illegal": pa.array([_illegal(initials)], pa.int64())})

    return codes.groupBy("own", "part").applyInArrow(measure, "own string, part int, costs array<long>, first int, last int, illegal long")


def _frontiers(codes: DataFrame) -> DataFrame:
    """(own, part, ways) of codes with entry and end costs: the frontier behind a fragment for each one before it, by its bits less 1."""

    def lead(group: pa.Table) -> pa.Table:
        group = group.sort_by("idx")
        own, entry, end = group.column("code").to_pylist(), tuple(group.column("entry")[0].as_py()), tuple(group.column("end")[0].as_py())
        live = sum(1 << s for s in range(STATES) if entry[s] < _FAR)
        ways = []
        for frontier in range(1, 1 << STATES):
            try:
                ways.append(traverse(own, entry, end, frontier & live, last=False)[1])
            except ValueError:  # no tight arc leaves these states, so they are never entered
                ways.append(0)
        return pa.table({"own": group.column("own")[:1], "part": group.column("part")[:1], "ways": pa.array([ways], pa.list_(pa.int32()))})

    return codes.groupBy("own", "part").applyInArrow(lead, "own string, part int, ways array<int>")


def _edits(rows: DataFrame) -> DataFrame:
    """(own, part, idx, letters, piece): what becomes of each row, inserts before it included; a fragment's letters stand in its first row."""

    def edit(group: pa.Table) -> pa.Table:
        group = group.sort_by("idx")
        own = group.column("code").to_pylist()
        entry, end, frontier, last = (group.column(x)[0].as_py() for x in ("entry", "end", "frontier", "final"))
        edits, _ = traverse(own, tuple(entry), tuple(end), frontier, last)
        pieces = []
        for i, (role, text) in enumerate(zip(group.column("role").to_pylist(), group.column("text").to_pylist(), strict=True)):
            own_pieces = _pieces(*edits[i], role, text)
            if last and i == len(own) - 1:
                own_pieces += _pieces(*edits[-1], "", "")
            pieces.append("\n".join(own_pieces) if own_pieces else None)
        letters = ["".join(x for x, _ in edits), *[None] * (len(own) - 1)]
        return pa.table({"own": group.column("own"), "part": group.column("part"), "idx": group.column("idx"), "letters": pa.array(letters, pa.string()), "piece": pa.array(pieces, pa.string())})

    return rows.groupBy("own", "part").applyInArrow(edit, "own string, part int, idx long, letters string, piece string")


def _digests(pieces: DataFrame) -> DataFrame:
    """(own, repaired_sha256) of the pieces of each conversation, newline-joined. Rows of a conversation are read in order, none is kept."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, begun = None, None, False

        def said() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"own": [now], "repaired_sha256": [state.hexdigest()]})

        for batch in batches:
            for own, piece in zip(batch.column("own").to_pylist(), batch.column("piece").to_pylist(), strict=True):
                if own != now:
                    if state:
                        yield said()
                    now, state, begun = own, sha256(), False
                if piece is not None:
                    state.update((b"\n" if begun else b"") + piece.encode("utf-8", "surrogatepass"))
                    begun = True
        if state:
            yield said()

    return pieces.select("own", "part", "idx", "piece").repartition("own").sortWithinPartitions("own", "part", "idx").mapInArrow(digest, "own string, repaired_sha256 string")


_SPANS = "own string, part int, entry array<long>, end array<long>, cost long, illegal long, final boolean"


def _composed(fragments: DataFrame) -> DataFrame:
    """(own, part, entry, end, cost, illegal, final) of _fragments(): each conversation's ones are put together in order. It has no more than there are tasks."""

    def compose(group: pa.Table) -> pa.Table:
        own = group.sort_by("part").to_pylist()
        entries, ends = [list(START)], [list(END)]
        for r in own:
            before = _closed(list(entries[-1]), back=False)
            entries.append([min(min(before[s] + r["costs"][4 * s + t] for s in range(STATES)), _FAR) for t in range(STATES)])
        for r in reversed(own):
            ends.append(_closed([min(min(ends[-1][t] + r["costs"][4 * s + t] for t in range(STATES)), _FAR) for s in range(STATES)], back=True))
        ends.reverse()
        cost = min(a + b for a, b in zip(entries[-1], END, strict=True))
        illegal = sum(r["illegal"] for r in own) + sum(_illegal([a["last"], b["first"]]) for a, b in zip(own[:-1], own[1:], strict=True))
        n = len(own)
        plain = lambda x: pa.array([list(_plain(c)[0]) for c in x], pa.list_(pa.int64()))
        return pa.table({
            "own": pa.array([r["own"] for r in own], pa.string()), "part": pa.array([r["part"] for r in own], pa.int32()), "entry": plain(entries[:n]), "end": plain(ends[1:]),
            "cost": pa.array([cost] * n, pa.int64()), "illegal": pa.array([illegal] * n, pa.int64()), "final": pa.array([i == n - 1 for i in range(n)]),
        })

    return fragments.groupBy("own").applyInArrow(compose, _SPANS)


def _entered(spans: DataFrame) -> DataFrame:
    """spans(own, part, ..., ways) with the frontier before each fragment, from the conversation's first on."""

    def follow(group: pa.Table) -> pa.Table:
        group, frontier, fronts = group.sort_by("part"), 1, []
        for ways in group.column("ways").to_pylist():
            fronts.append(frontier)
            frontier = ways[frontier - 1]
        return group.select(["own", "part", "entry", "end", "final"]).append_column("frontier", pa.array(fronts, pa.int32()))

    return spans.groupBy("own").applyInArrow(follow, "own string, part int, entry array<long>, end array<long>, final boolean, frontier int")


def _pieced(loose: DataFrame) -> DataFrame:
    """The results of the conversations of loose rows, by fragments."""
    rows = loose.withColumn("own", F.coalesce(F.col("conv_id").cast("string"), F.lit("")))
    alive = rows.where("not dropped")
    again = alive.where("not is_blank").groupBy("own", "key").agg(F.min(F.struct("part", "idx")).alias("once"), F.count("*").alias("n")).where("n > 1").drop("n")
    told = alive.join(again, ["own", "key"], "left")
    blank = F.col("is_blank")
    duplicate = ~blank & F.coalesce(F.struct("part", "idx") > F.col("once"), F.lit(False))
    truncated = F.col("is_cut") & ~blank & ~duplicate
    code = F.col("initial") * 3 + F.when(blank | duplicate, 1).when(truncated, 2).otherwise(0)
    told = told.select("own", "part", "idx", "turn", "role", "text", blank.alias("blank"), duplicate.alias("duplicate"), truncated.alias("truncated"), code.cast("int").alias("code"))
    told = materialize(told, "told")
    codes = told.select("own", "part", "idx", "code")
    spans = materialize(_composed(_fragments(codes)), "spans")
    ends = spans.select("own", "part", "entry", "end")
    fronts = materialize(_entered(spans.join(_frontiers(codes.join(ends, ["own", "part"])), ["own", "part"])), "fronts")
    edits = materialize(_edits(told.select("own", "part", "idx", "code", "role", "text").join(fronts, ["own", "part"])), "edits")
    audits = edits.where("letters is not null").groupBy("own").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "letters"))), lambda x: x["letters"]), "").alias("audit"))
    wide = lambda c: c.cast("decimal(38,0)")
    gaps = wide(F.max("turn")) - wide(F.min("turn")) + 1 - F.count_distinct("turn")
    gaps = F.when(gaps > _LONG, _LONG).otherwise(gaps.cast("long"))
    counts = told.groupBy("own").agg(F.coalesce(gaps, F.lit(0)).alias("gaps"), *[F.count_if(x).alias(x) for x in ("blank", "duplicate", "truncated")])
    costs = spans.select("own", "illegal", "cost").distinct()
    empty = sha256(b"").hexdigest()
    out = rows.groupBy("own").agg(F.first("conv_id").alias("conv_id"))
    for more in (counts, costs, audits, _digests(edits)):
        out = out.join(more, "own", "left")
    numbers = [F.coalesce(x, F.lit(0)).cast("long").alias(x) for x in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    out = out.select("conv_id", *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(empty)).alias("repaired_sha256"))
    out = materialize(out, "pieced")
    for done in (told, spans, fronts, edits):
        drop_table(done)
    return out


def repair(rows: DataFrame, most_rows: int = MOST_ROWS, most_chars: int = MOST_CHARS) -> DataFrame:
    """One row for each conversation of damaged rows(conv_id, turn, role, text, dropped): its faults, the cheapest edits and what they give.

    gaps are the turns missing between the least and the greatest. A row's first fault counts: blank, duplicate (role
    and text seen earlier), truncated (no end of a sentence). illegal counts neighbours whose roles don't follow each
    other. Null conv_ids are one conversation, null turns come first and count for no gap; role and text must not be
    null. A conversation of dropped rows only has zeros, an empty audit and the digest of an empty text; an empty table
    gives no rows. Texts and conversations of any length are read whole. Other columns are ignored.
    """
    spark = rows.sparkSession
    text_batches(spark)
    kind = rows.schema["conv_id"].dataType.simpleString()
    placed = _judged(rows).withColumn("salt", F.monotonically_increasing_id()).repartitionByRange("conv_id", "turn", "key", "salt")
    placed = placed.sortWithinPartitions("conv_id", "turn", "key").withColumn("part", F.spark_partition_id()).select(*_ROW, "part")
    schema = f"conv_id {kind}, turn long, role string, text string, key binary, initial int, is_blank boolean, is_cut boolean, dropped boolean, part int, idx long"
    found = materialize(placed.mapInArrow(_whole_ones(most_rows, most_chars), f"{schema}, {RESULT}, done boolean"), "conversations")
    whole = found.where("done").select("conv_id", *[x.split()[0] for x in RESULT.split(", ")])
    return whole.unionByName(_pieced(found.where("not done").select(*_ROW, "part", "idx")))
