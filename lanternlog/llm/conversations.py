"""Conversation structure repair: the cheapest edits that make a conversation's roles ``(s?(ua)+)?``, in linear space.

Reading roles from left to right leaves one of four states: nothing yet, after the system turn, after a user's, after an
assistant's. A row, or many rows together, is a 4 x 4 table of least costs from state to state (``Step``). Hirschberg's
method finds the edits without a table of all rows: forward costs from the left and backward costs from the right meet
in the middle, the best state to cross there is chosen, and both halves are solved alike.

Ties go to the edits whose initials are least as a text. Edits up to a row and its own last edit are never a prefix of
others up to the same row, so the order of the four states' least edits (their ranks) can be carried along with costs,
and the state of least cost, then least rank, is where the least edits cross.

1. Rows are sorted by range of (conversation, turn), so a long conversation is on many tasks. Each task cuts what it has
   into chunks of ``chunk_rows`` rows and sums them up as a Step and a few counts.
2. Conversations in several chunks: steps are merged by groups of chunks, then by conversation; the states to cross are
   found from the top down, first between groups, then between their chunks. Only steps take part, no texts.
3. Each chunk is solved between its two states. What a conversation in several chunks ends in is put together in order
   by one pass that holds a chunk at a time: its digest, SHA-256 of the whole text, can't be made in parts.

Defined cases: a null role or text is one space, so the text is blank; a role that begins with no letter of s, u, a can't
be kept; null turns come first; rows of one turn are in the order of role, the text's first 64 characters and its hash;
repeated rows are duplicates; an empty table gives an empty result; very long texts are cut into chunks of their own;
columns besides conv_id, turn, role and text are not read, whatever their names.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256
from math import inf

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage, shared_dir, ship_package, table

SPACE = " \t\n\v\f\r"
START, SYSTEM, USER, ASSISTANT = range(4)
STATES = range(4)
AFTER_INSERT = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
ROLES = {USER: "user", ASSISTANT: "assistant"}
INSERT, REROLE, DELETE, CUT = 2, 2, 3, 1
#: Inserts that may come before a row: (state, how many). More would come back to a state at a cost.
CHAINS = {START: [(START, 0), (USER, 1), (ASSISTANT, 2)], SYSTEM: [(SYSTEM, 0), (USER, 1), (ASSISTANT, 2)], USER: [(USER, 0), (ASSISTANT, 1)], ASSISTANT: [(ASSISTANT, 0), (USER, 1)]}
#: Inserts that a conversation needs after its last row.
ENDING = {START: 0, SYSTEM: 2, USER: 1, ASSISTANT: 0}
CHUNK_ROWS, CHUNK_BYTES, GROUP_BITS = 4096, 8_000_000, 24

#: A Step: for each state before, for each state after: (least cost, rank of its edits among those of the state before).
Step = tuple[tuple[tuple[float, int], ...], ...]
IDENTITY: Step = tuple(tuple((0 if a == b else inf, b) for b in STATES) for a in STATES)


def kept_state(state: int, initial: str) -> int | None:
    """The state after a kept row whose role has this initial; None where it may not stand."""
    if initial == "s":
        return SYSTEM if state == START else None
    if initial == "u":
        return USER if state != USER else None
    return ASSISTANT if initial == "a" and state == USER else None


@lru_cache(64)
def row_edits(initial: str, fault: str) -> dict[tuple[int, int], tuple[int, str]]:
    """(state before, state after) to the cheapest edits of one row and inserts before it: cost and initials."""
    out: dict[tuple[int, int], tuple[int, str]] = {}
    for before in STATES:
        for state, inserts in CHAINS[before]:
            options = [(state, DELETE, "D")]
            if fault not in ("blank", "duplicate"):
                extra = CUT if fault == "truncated" else 0
                options.append((AFTER_INSERT[state], REROLE + extra, "R"))
                if (kept := kept_state(state, initial)) is not None:
                    options.append((kept, extra, "K"))
            for after, cost, letter in options:
                found = (INSERT * inserts + cost, "I" * inserts + letter)
                out[before, after] = min(out.get((before, after), (inf, "")), found)
    return out


def ranked(best: list[tuple]) -> list[int]:
    order = sorted(STATES, key=lambda s: best[s])
    return [order.index(s) for s in STATES]


@lru_cache(64)
def row_step(initial: str, fault: str) -> Step:
    edits = row_edits(initial, fault)
    out = []
    for a in STATES:
        found = [edits.get((a, b), (inf, "")) for b in STATES]
        out.append(tuple(zip([c for c, _ in found], ranked([w for _, w in found]), strict=True)))
    return tuple(out)


def entering(state: int) -> tuple[tuple[float, int], ...]:
    return tuple((0 if s == state else inf, s) for s in STATES)


@lru_cache(1 << 14)
def forward(costs: tuple[tuple[float, int], ...], step: Step) -> tuple[tuple[tuple[float, int], ...], float]:
    """Costs and ranks of the states after a step, less the least cost, which comes with them."""
    best = [min((costs[a][0] + step[a][b][0], costs[a][1], step[a][b][1]) for a in STATES) for b in STATES]
    least, ranks = min(x[0] for x in best), ranked([x[1:] for x in best])
    return tuple((best[b][0] - least, ranks[b]) for b in STATES), least


@lru_cache(1 << 14)
def backward(step: Step, costs: tuple[float, ...]) -> tuple[float, ...]:
    """Costs from the states before a step to the end, up to a constant."""
    found = [min(step[a][b][0] + costs[b] for b in STATES) for a in STATES]
    least = min(found)
    return tuple(x - least for x in found)


def through(steps: list[Step]) -> Step:
    """Many steps as one."""
    out = []
    for a in STATES:
        costs, total = entering(a), 0
        for s in steps:
            costs, least = forward(costs, s)
            total += least
        out.append(tuple((c + total, r) for c, r in costs))
    return tuple(out)


def crossings(steps: list[Step], entry: int, leave: int) -> list[int]:
    """The state after each step of the least cheapest edits from one state to another: the middle, then both halves."""
    out = [leave] * len(steps)
    waiting = [(0, len(steps), entry, leave)]
    while waiting:
        lo, hi, first, last = waiting.pop()
        if hi - lo < 2:
            continue
        middle = (lo + hi) // 2
        left = entering(first)
        for k in range(lo, middle):
            left, _ = forward(left, steps[k])
        right = tuple(0 if s == last else inf for s in STATES)
        for k in range(hi - 1, middle - 1, -1):
            right = backward(steps[k], right)
        out[middle - 1] = min((left[s][0] + right[s], left[s][1], s) for s in STATES)[2]
        waiting += [(lo, middle, first, out[middle - 1]), (middle, hi, out[middle - 1], last)]
    return out


def last_state(step: Step) -> tuple[int, int]:
    """Where a whole conversation best ends before its last inserts, and what it costs with them."""
    cost, _, state = min((step[START][s][0] + INSERT * ENDING[s], step[START][s][1], s) for s in STATES)
    return state, int(cost)


# --- what a chunk, or several, add up to ---------------------------------------------------------------------------

COUNTS = ["n", "blank", "duplicate", "truncated", "illegal", "turns"]
SUMMARY = ", ".join(f"{c} long" for c in COUNTS) + ", first string, last string, low long, high long, step array<double>"
NAMES = [*COUNTS, "first", "last", "low", "high", "step"]
KINDS = [*[pa.int64()] * len(COUNTS), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.list_(pa.float64())]


def flat(step: Step) -> list[float]:
    return [float(x) for row in step for pair in row for x in pair]


def unflat(values: list[float]) -> Step:
    pairs = [(c, int(r)) for c, r in zip(values[::2], values[1::2], strict=True)]
    return tuple(tuple(pairs[4 * a : 4 * a + 4]) for a in STATES)


def legal(before: str, after: str) -> bool:
    return before + after in ("su", "ua", "au")


def summary_of(rows: list[tuple[int | None, str, str]]) -> dict:
    """Counts and Step of rows (turn, initial, fault), in order."""
    turns = [t for t, *_ in rows if t is not None]
    initials = [i for _, i, _ in rows]
    faults = [f for *_, f in rows]
    return {
        "n": len(rows), **{f: faults.count(f) for f in ("blank", "duplicate", "truncated")}, "illegal": sum(not legal(a, b) for a, b in zip(initials, initials[1:], strict=False)), "turns": len(set(turns)),
        "first": initials[0] if rows else None, "last": initials[-1] if rows else None, "low": min(turns, default=None), "high": max(turns, default=None), "step": flat(through([row_step(i, f) for _, i, f in rows])),
    }


def merged(parts: list[dict]) -> dict:
    """Summaries of neighbours, in order, as one."""
    parts = [p for p in parts if p["n"]]
    if not parts:
        return summary_of([])
    out = {c: sum(p[c] for p in parts) for c in COUNTS}
    timed = [p for p in parts if p["turns"]]
    for a, b in zip(parts, parts[1:], strict=False):
        out["illegal"] += not legal(a["last"], b["first"])
    out["turns"] -= sum(a["high"] == b["low"] for a, b in zip(timed, timed[1:], strict=False))
    ends = {"first": parts[0]["first"], "last": parts[-1]["last"], "low": timed[0]["low"] if timed else None, "high": timed[-1]["high"] if timed else None}
    return out | ends | {"step": flat(through([unflat(p["step"]) for p in parts]))}


REPORT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long"


def report_of(s: dict) -> dict:
    return {"gaps": s["high"] - s["low"] + 1 - s["turns"] if s["turns"] else 0, **{c: s[c] for c in ("blank", "duplicate", "truncated", "illegal")}, "cost": last_state(unflat(s["step"]))[1]}


def as_table(rows: list[dict], schema: str) -> pa.Table:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_(), "array<double>": pa.list_(pa.float64()), "array<string>": pa.list_(pa.string()), "binary": pa.binary()}
    fields = [x.split() for x in schema.split(", ")]
    return pa.table([pa.array([r[n] for r in rows], kinds[k]) for n, k in fields], [n for n, _ in fields])


# --- the passes ----------------------------------------------------------------------------------------------------

CHUNKS = f"key string, at long, {SUMMARY}, roles array<string>, faults array<string>, texts array<string>"


def chunk_maker(chunk_rows: int, chunk_bytes: int):
    """Sorted rows (key, row, turn, role, text, is_repeat, is_dropped) to chunks of one conversation each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size, begun, out, out_size = 0, None, [], 0

        def close() -> dict:
            rows = [(turn, role[:1], fault) for turn, role, _, fault in held]
            return {"key": begun[0], "at": begun[1], **summary_of(rows), "roles": [h[1] for h in held], "texts": [h[2] for h in held], "faults": [h[3] for h in held]}

        for batch in batches:
            for key, row, turn, role, text, is_repeat, is_dropped in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if begun is not None and (key != begun[0] or row // chunk_rows != begun[1] // chunk_rows or size > chunk_bytes):
                    out.append(close())
                    out_size += size
                    held, size, begun = [], 0, None
                if begun is None:
                    begun = (key, row)
                if not is_dropped:
                    bare = text.rstrip(SPACE)
                    fault = "blank" if not bare else "duplicate" if is_repeat else "" if bare[-1] in ".!?" else "truncated"
                    held.append((turn, role, text, fault))
                    size += len(text)
                if out_size > chunk_bytes or len(out) >= 2000:
                    yield from as_table(out, CHUNKS).to_batches()
                    out, out_size = [], 0
        if begun is not None:
            out.append(close())
        if out:
            yield from as_table(out, CHUNKS).to_batches()

    return run


def merge_group(group: pa.Table) -> pa.Table:
    """The summaries of a group of one conversation's chunks as one."""
    rows = group.sort_by("at").to_pylist()
    return as_table([{"key": rows[0]["key"], "part": rows[0]["part"], **merged(rows)}], PARTS)


PARTS = f"key string, part long, {SUMMARY}"
CROSSED = f"key string, part long, entry int, leave int, {REPORT}"


def cross_parts(group: pa.Table) -> pa.Table:
    """A conversation's groups of chunks with the states that its edits enter and leave them in, and its report."""
    rows = group.sort_by("part").to_pylist()
    steps = [unflat(r["step"]) for r in rows]
    whole = merged(rows)
    states = crossings(steps, START, last_state(unflat(whole["step"]))[0])
    return as_table([{"key": r["key"], "part": r["part"], "entry": a, "leave": b, **report_of(whole)} for r, a, b in zip(rows, [START, *states], states, strict=False)], CROSSED)


STATED = f"key string, at long, entry int, leave int, is_last boolean, {REPORT}"


def cross_chunks(group: pa.Table, known: pa.Table) -> pa.Table:
    """The chunks of a group with the states that the edits enter and leave them in."""
    rows, top = group.sort_by("at").to_pylist(), known.to_pylist()[0]
    states = crossings([unflat(r["step"]) for r in rows], top["entry"], top["leave"])
    report = {k: top[k] for k in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")}
    return as_table([{"key": r["key"], "at": r["at"], "entry": a, "leave": b, "is_last": r["is_last"], **report} for r, a, b in zip(rows, [top["entry"], *states], states, strict=False)], STATED)


def edited(roles: list[str], faults: list[str], texts: list[str], entry: int, leave: int, is_last: bool) -> tuple[str, list[tuple[str, str, str]]]:
    """A chunk's edits and what they leave: (edit, role, text) of each message."""
    initials = [r[:1] for r in roles]
    states = crossings([row_step(i, f) for i, f in zip(initials, faults, strict=True)], entry, leave)
    audit, left, state = [], [], entry
    for k, after in enumerate(states):
        letters = row_edits(initials[k], faults[k])[state, after][1]
        audit.append(letters)
        for letter in letters:
            if letter == "I":
                state = AFTER_INSERT[state]
                left.append(("I", ROLES[state], ""))
            elif letter == "R":
                left.append(("R", ROLES[AFTER_INSERT[state]], texts[k]))
            elif letter == "K":
                left.append(("K", roles[k], texts[k]))
        state = after
    for _ in range(ENDING[state] if is_last else 0):
        state = AFTER_INSERT[state]
        audit.append("I")
        left.append(("I", ROLES[state], ""))
    return "".join(audit), left


SOLVED = f"key string, at long, is_whole boolean, {REPORT}, audit string, repaired string"
SOLVE = ["key", "at", "n", "step", *[c for c in NAMES if c not in ("n", "step")], "roles", "faults", "texts", "entry", "leave", "is_last", "p_gaps", "p_blank", "p_duplicate", "p_truncated", "p_illegal", "p_cost"]


def solved_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, bool, dict, str, list]]:
    """Each chunk with whether it is its conversation's only one, the report, edits and messages."""
    for batch in batches:
        for row in batch.to_pylist():
            is_whole = row["entry"] is None
            if is_whole:
                entry, leave, is_last, report = START, last_state(unflat(row["step"]))[0], True, report_of(row)
            else:
                entry, leave, is_last, report = row["entry"], row["leave"], row["is_last"], {k[2:]: v for k, v in row.items() if k.startswith("p_")}
            yield row, is_whole, report, *edited(row["roles"], row["faults"], row["texts"], entry, leave, is_last)


def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each chunk: of whole conversations the digest, of others the repaired text."""
    out, size = [], 0
    for row, is_whole, report, audit, left in solved_chunks(batches):
        text = "\n".join(f"{role}:{text}" for _, role, text in left)
        if is_whole:
            text = sha256(text.encode()).hexdigest()
        elif not left:
            text = None  # nothing, which is not an empty line
        out.append({"key": row["key"], "at": row["at"], "is_whole": is_whole, **report, "audit": audit, "repaired": text})
        size += len(text or "")
        if size > CHUNK_BYTES or len(out) >= 5000:
            yield from as_table(out, SOLVED).to_batches()
            out, size = [], 0
    if out:
        yield from as_table(out, SOLVED).to_batches()


DIGESTS = f"key string, {REPORT}, audit string, repaired_sha256 string"


def put_together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks in order to conversations: audits joined, texts hashed one after another."""
    begun, digest, audits, is_first = None, None, [], True

    def close() -> pa.RecordBatch:
        one = begun | {"audit": "".join(audits), "repaired_sha256": digest.hexdigest()}
        return as_table([one], DIGESTS).to_batches()[0]

    for batch in batches:
        for row in batch.to_pylist():
            if begun is None or row["key"] != begun["key"]:
                if begun is not None:
                    yield close()
                begun, digest, audits, is_first = row, sha256(), [], True
            audits.append(row["audit"])
            if row["repaired"] is not None:
                digest.update((b"" if is_first else b"\n") + row["repaired"].encode())
                is_first = False
    if begun is not None:
        yield close()


MESSAGES = "key string, at long, pos long, edit string, role string, text string"


def messages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for row, _, _, _, left in solved_chunks(batches):
        if left:
            yield from as_table([{"key": row["key"], "at": row["at"], "pos": k, "edit": e, "role": r, "text": t} for k, (e, r, t) in enumerate(left)], MESSAGES).to_batches()


class Repair:
    """Cheapest repairs of all conversations of (conv_id, turn, role, text, and is_dropped of rows that only name theirs)."""

    def __init__(self, rows: DataFrame, *, chunk_rows: int = CHUNK_ROWS, chunk_bytes: int = CHUNK_BYTES, group_bits: int = GROUP_BITS):
        spark = rows.sparkSession
        ship_package(spark)
        self.id_type = rows.schema["conv_id"].dataType
        gone = F.col("is_dropped") if "is_dropped" in rows.columns else F.lit(False)
        blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
        own = rows.select(
            F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("")).alias("key"), F.col("turn").cast("long").alias("turn"), blank("role").alias("role"), blank("text").alias("text"), gone.alias("is_dropped"), F.monotonically_increasing_id().alias("uid")
        )
        own = cut_lineage(own.withColumns({"h1": F.xxhash64("role", "text"), "h2": F.xxhash64(F.lit("second"), "text", "role")}))
        same = ["key", "h1", "h2"]
        first = own.filter("NOT is_dropped").groupBy(*same).agg(F.min(F.struct("turn", "uid")).alias("first"), F.count("*").alias("n")).filter("n > 1")
        marked = own.join(first.select(*same, F.col("first.uid").alias("first_uid")), same, "left")
        marked = marked.withColumn("is_repeat", F.coalesce(F.col("uid") != F.col("first_uid"), F.lit(False))).withColumn("head", F.substring("text", 1, 64))
        order = ["key", "turn", "role", "head", "h1", "h2", "uid"]
        ordered = marked.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("row", F.monotonically_increasing_id())
        folder = f"{shared_dir(spark)}/conversations-{uuid.uuid4().hex}"
        ordered.select("key", "row", "turn", "role", "text", "is_repeat", "is_dropped").mapInArrow(chunk_maker(chunk_rows, chunk_bytes), CHUNKS).write.parquet(f"{folder}/chunks")
        chunks = spark.read.schema(CHUNKS).parquet(f"{folder}/chunks")
        several = chunks.groupBy("key").agg(F.count("*").alias("n_chunks"), F.max("at").alias("last_at")).filter("n_chunks > 1")
        slim = chunks.select("key", "at", *NAMES).join(several, "key").select("*", F.shiftright("at", group_bits).alias("part"), (F.col("at") == F.col("last_at")).alias("is_last"))
        parts = slim.select("key", "at", "part", *NAMES).groupBy("key", "part").applyInArrow(merge_group, PARTS)
        crossed = parts.groupBy("key").applyInArrow(cross_parts, CROSSED)
        states = slim.select("key", "at", "part", "is_last", "step").groupBy("key", "part").cogroup(crossed.groupBy("key", "part")).applyInArrow(cross_chunks, STATED)
        self.states = cut_lineage(states)
        named = self.states.select("key", "at", "entry", "leave", "is_last", *(F.col(x.split()[0]).alias(f"p_{x.split()[0]}") for x in REPORT.split(", ")))
        self.chunks = chunks.join(named, ["key", "at"], "left").select(SOLVE)

    def _named(self, df: DataFrame) -> DataFrame:
        """conv_id in front, instead of the key that is never null."""
        own = F.when(F.col("key") != "", F.substring(F.col("key"), 2, 2**31 - 1)).cast(self.id_type)
        return df.select(own.alias("conv_id"), *(c for c in df.columns if c not in ("key", "at")))

    def report(self) -> DataFrame:
        """A row for each conversation: gaps, faults, illegal neighbours, cost, the edits' initials and the repaired text's digest."""
        solved = self.chunks.mapInArrow(solve, SOLVED)
        # the two kinds are cut out of one written table, so that no chunk is solved twice
        solved = cut_lineage(solved)
        columns = [x.split()[0] for x in DIGESTS.split(", ")]
        whole = solved.filter("is_whole").withColumnRenamed("repaired", "repaired_sha256").select(columns)
        pieces = solved.filter("NOT is_whole").drop("is_whole").repartition("key").sortWithinPartitions("key", "at")
        return self._named(whole.unionByName(pieces.mapInArrow(put_together, DIGESTS)))

    def messages(self) -> DataFrame:
        """The repaired conversations: conv_id, place (a number that only orders), edit, role and text of each message."""
        rows = self.chunks.mapInArrow(messages, MESSAGES).withColumn("place", F.struct("at", "pos"))
        return self._named(rows.select("key", "place", "edit", "role", "text"))


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows with one of five faults by the checksum of conversation and turn, or none; dropped ones stay as names."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    code = (F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn")).cast("binary")) % 20).cast("int")
    rows = conversations.select("conv_id", "turn", said("role").alias("role"), said("text").alias("text"), code.alias("code"))
    text = F.when(F.col("code") == 1, "").when(F.col("code") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.explode(F.when(F.col("code") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select("conv_id", "turn", F.when(F.col("code") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), (F.col("code") == 0).alias("is_dropped"), copies.alias("copy")).drop("copy")


def op13_conversation_repair(spark, sf_dir):
    return Repair(damaged(table(spark, sf_dir, "conversations"))).report()


def oracle() -> str:
    """The contract in SQL: from each conversation's last row to its first, the best edits from each of the four states."""
    from .merkle import crc32_sql

    said = lambda c: f"coalesce(CAST({c} AS VARCHAR), ' ')"
    space = " || ".join(f"chr({ord(c)})" for c in SPACE)
    inserted = lambda state, k: [state := AFTER_INSERT[state] for _ in range(k)]
    listed = lambda states, row: "CAST([" + ", ".join([*(f"'{ROLES[s]}:'" for s in states), *row]) + "] AS VARCHAR[])"

    def ending(state: int) -> str:
        k = ENDING[state]
        return f"{{'c': CAST({INSERT * k} AS BIGINT), 'a': '{'I' * k}', 't': {listed(inserted(state, k), [])}}} AS s{state}"

    def best(before: int) -> str:
        options = []
        for state, k in CHAINS[before]:
            added = inserted(before, k)
            edge = lambda letter, cost, row, after: f"{{'c': CAST({INSERT * k} + {cost} + s{after}.c AS BIGINT), 'a': '{'I' * k}{letter}' || s{after}.a, 't': list_concat({listed(added, row)}, s{after}.t)}}"  # noqa: B023, E731
            options.append(edge("D", DELETE, [], state))
            after = AFTER_INSERT[state]
            options.append(f"CASE WHEN f IN (0, 3) THEN {edge('R', f'{REROLE} + f // 3', [f"'{ROLES[after]}:' || text"], after)} END")
            for initial in "sua":
                if (kept := kept_state(state, initial)) is not None:
                    options.append(f"CASE WHEN f IN (0, 3) AND left(role, 1) = '{initial}' THEN {edge('K', 'f // 3', ["role || ':' || text"], kept)} END")
        return f"list_min([{', '.join(options)}]) AS s{before}"

    return f"""WITH RECURSIVE raw AS (SELECT conv_id, turn, {said("role")} AS role, {said("text")} AS text, {crc32_sql(f"({said('conv_id')} || ':' || {said('turn')})")} % 20 AS code FROM conversations),
d AS (SELECT conv_id, turn, CASE WHEN code = 4 THEN 'user' ELSE role END AS role, CASE code WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text FROM raw, range(2) c(copy) WHERE code <> 0 AND (copy = 0 OR code = 3)),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i, rtrim(text, {space}) AS bare FROM d),
r AS (SELECT *, CASE WHEN bare = '' THEN 1 WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 2 WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS f, left(lag(role) OVER (PARTITION BY conv_id ORDER BY i), 1) || left(role, 1) AS pair FROM o),
n AS (SELECT conv_id, count(*) AS n, count(*) FILTER (WHERE f = 1) AS blank, count(*) FILTER (WHERE f = 2) AS duplicate, count(*) FILTER (WHERE f = 3) AS truncated, count(*) FILTER (WHERE pair NOT IN ('su', 'ua', 'au')) AS illegal, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps FROM r GROUP BY 1),
dp AS (SELECT conv_id, n + 1 AS i, {", ".join(map(ending, STATES))} FROM n UNION ALL SELECT conv_id, i, {", ".join(map(best, STATES))} FROM (SELECT dp.conv_id, r.i, s0, s1, s2, s3, role, text, f FROM dp JOIN r ON r.conv_id IS NOT DISTINCT FROM dp.conv_id AND r.i = dp.i - 1)),
done AS (SELECT n.*, s0 AS s FROM dp JOIN n ON n.conv_id IS NOT DISTINCT FROM dp.conv_id WHERE i = 1)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(s.c, 0) AS cost, coalesce(s.a, '') AS audit, sha256(coalesce(array_to_string(s.t, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN done ON done.conv_id IS NOT DISTINCT FROM c.conv_id"""


ORACLE = oracle()
