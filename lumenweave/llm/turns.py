"""Operator 13: repair of a conversation's structure by cheapest edits.

The rows of a conversation, in order of turn, become a sequence of role initials ``(s?(ua)+)?``.
A row is kept (cost 0), given the role user or assistant (3) or deleted (4, a must for blank and
repeated rows); empty user or assistant rows are inserted anywhere (3); a truncated row that stays
costs 3 more. Four states tell what may come next: nothing yet, after system, after user, after
assistant. Conversations of like length form a tensor with time as its first axis: ``backward``
takes all of them one turn back at a time and stores their state costs, ``trace`` walks all of
them forward, taking the edit with the ASCII-least initial among those that stay cheapest.

Conversations of up to ``LONG`` rows are solved within one task each. Longer ones are dealt by
ranges of turns and cut into chunks: a chunk's costs from each state to each state are a 4 x 4
table, tables combine in (min, +), which gives the costs at all chunk ends, and then each chunk
is traced from each state; who follows whom is settled from the chunks' four end states. So no
task holds a long conversation's rows. Only its hash and its audit, which are one value each,
pass through one task, chunk by chunk.

Cases: a null role or text counts as one space; null turns come first; rows of one turn follow role,
then text; a null conv_id is a conversation of its own; repeated rows are duplicates; roles are told by
their first character, and roles that begin otherwise are never kept; very long texts and conversations
pass whole; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenweave.llm.common import read, shuffle_partitions, small, stow

LONG = 1 << 12
CHUNK = 1 << 10
#: Rows and bytes after which a worker solves what it has.
BLOCK_ROWS, BLOCK_BYTES = 1 << 15, 16 << 20
SPACE = " \t\n\x0b\f\r"
KEEP, REROLE, DELETE, INSERT = b"KRDI"
ROLES = {2: "user", 3: "assistant"}
#: States: 0 nothing yet, 1 after system, 2 after user, 3 after assistant; and where a user or assistant row leads from each.
_TO = np.array([2, 2, 3, 2])
_FAR = np.int32(1 << 28)
#: Initials s, u, a as the states they lead to; 0 is any other.
_INITIALS = {"s": 1, "u": 2, "a": 3}
_LEGAL = np.zeros((4, 4), bool)
_LEGAL[[1, 2, 3], [2, 3, 2]] = True
#: Costs behind the last row: only the states 0 and 3 may end.
END = np.array([0, 6, 3, 0], np.int32)


def _inserted(costs: np.ndarray) -> np.ndarray:
    """Costs (.., 4) once rows may be inserted in front."""
    u, a = np.minimum(costs[..., 2], costs[..., 3] + 3), np.minimum(costs[..., 3], costs[..., 2] + 3)
    return np.stack([np.minimum(costs[..., 0], u + 3), np.minimum(costs[..., 1], u + 3), u, a], axis=-1)


def backward(initial: np.ndarray, gone: np.ndarray, cut: np.ndarray, sizes: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Costs to the end from each (time, conversation, .., state). Arrays are (time, conversation); ``end``: (conversation, .., 4)."""
    length, many = initial.shape
    out = np.empty((length + 1, *end.shape), np.int32)
    out[length] = end
    wide = (slice(None),) + (None,) * (end.ndim - 2)
    for t in range(length - 1, -1, -1):
        after = out[t + 1]
        extra = (3 * cut[t]).astype(np.int32)[(*wide, None)]
        moved = after[..., _TO] + extra
        first = initial[t][(*wide, None)]
        stay = np.where(first == _TO, moved, _FAR)
        stay[..., 0] = np.minimum(stay[..., 0], np.where(first[..., 0] == 1, after[..., 1] + extra[..., 0], _FAR))
        best = np.minimum(after + 4, np.where(gone[t][(*wide, None)], _FAR, np.minimum(stay, moved + 3)))
        out[t] = np.where((t < sizes)[(*wide, None)], np.minimum(_inserted(best), _FAR), out[t + 1])
    return out


def trace(costs: np.ndarray, initial: np.ndarray, gone: np.ndarray, cut: np.ndarray, sizes: np.ndarray, state: np.ndarray, last: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    """The edits of each conversation from its ``state``, and the state behind them. Where not ``last``, none follow the last row."""
    many = np.arange(len(sizes))
    at, state = np.zeros(len(sizes), np.int64), state.copy()
    initial, gone, cut = (np.concatenate([x, np.zeros((1, x.shape[1]), x.dtype)]) for x in (initial, gone, cut))
    steps = []
    while True:
        inside = at < sizes
        here = costs[at, many, state]
        live = inside | (last & (here > 0))
        if not live.any():
            break
        after = costs[np.minimum(at + 1, len(costs) - 1), many]
        to = _TO[state]
        delete = inside & (after[many, state] + 4 == here)
        insert = ~delete & (costs[at, many, to] + 3 == here)
        first, extra, stays = initial[at, many], 3 * cut[at, many], inside & ~gone[at, many]
        system = (first == 1) & (state == 0)
        target = np.where(system, 1, to)
        keep = ~delete & ~insert & stays & (system | (first == to)) & (after[many, target] + extra == here)
        rerole = ~(delete | insert | keep)
        edit = np.select([~live, delete, insert, keep], [0, DELETE, INSERT, KEEP], REROLE).astype(np.uint8)
        steps.append(edit)
        state = np.where(~live | delete, state, np.where(keep, target, to))
        at += live & (delete | keep | rerole)
    edits = np.array(steps, np.uint8).reshape(-1, len(sizes)).T
    return [row[row > 0].tobytes() for row in edits], state


def repaired(edits: bytes, state: int, roles: list[str], texts: list[str]) -> list[tuple[str, str, str]]:
    """Edit, role and text of the repaired rows, from the state in front of the first."""
    out, row = [], 0
    for edit in edits:
        if edit == DELETE:
            row += 1
            continue
        to = int(_TO[state])
        if edit == INSERT:
            out.append(("I", ROLES[to], ""))
            state = to
            continue
        if edit == REROLE:
            out.append(("R", ROLES[to], texts[row]))
        else:
            out.append(("K", roles[row], texts[row]))
            to = _INITIALS[roles[row][:1]]
        state, row = to, row + 1
    return out


def _text(rows: list[tuple[str, str, str]]) -> str:
    return "\n".join(f"{role}:{text}" for _, role, text in rows)


def _groups(table: pa.Table, keys: list[str]) -> np.ndarray:
    """First rows of the runs of equal keys."""
    new = np.ones(table.num_rows, bool)
    if table.num_rows:
        new[1:] = False
        for k in keys:
            codes = table.column(k).combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()
            new[1:] |= codes[1:] != codes[:-1]
    return np.flatnonzero(new)


def _whole(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Sorted batches as tables that hold all rows of their keys."""
    held: list[pa.RecordBatch] = []
    rows = size = 0
    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        rows, size = rows + b.num_rows, size + b.nbytes
        if rows >= BLOCK_ROWS or size >= BLOCK_BYTES:
            table = pa.Table.from_batches(held)
            stop = int(_groups(table, keys)[-1])
            if stop:
                yield table.slice(0, stop)
            held = table.slice(stop).to_batches()
            rows, size = sum(x.num_rows for x in held), sum(x.nbytes for x in held)
    if rows:
        yield pa.Table.from_batches(held)


def _codes(role: pa.ChunkedArray) -> np.ndarray:
    found = role.combine_chunks().dictionary_encode()
    kinds = np.array([_INITIALS.get(r[:1], 0) for r in found.dictionary.to_pylist()], np.int8)
    return kinds[found.indices.to_numpy()] if len(found) else np.zeros(0, np.int8)


def _repeated(owner: np.ndarray, role: pa.ChunkedArray, text: pa.ChunkedArray) -> np.ndarray:
    """Whether an earlier row of the same owner has the same role and text."""
    if not len(owner):
        return np.zeros(0, bool)
    a, b = (c.combine_chunks().dictionary_encode().indices.to_numpy().astype(np.int64) for c in (role, text))
    both = np.unique(a * (int(b.max()) + 1) + b, return_inverse=True)[1]
    first = np.unique(owner * (int(both.max()) + 1) + both, return_index=True)[1]
    out = np.ones(len(owner), bool)
    out[first] = False
    return out


def _buckets(sizes: np.ndarray) -> Iterator[tuple[np.ndarray, int]]:
    """Conversations of like length (within a factor of 1.5 or so), and the longest length."""
    kind = np.ceil(2 * np.log2(np.maximum(sizes, 1))).astype(int)
    for k in np.unique(kind):
        mine = np.flatnonzero(kind == k)
        length = int(sizes[mine].max())
        for part in np.array_split(mine, -(-len(mine) * (length + 1) // (1 << 20))):
            yield part, length


def _tensor(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray, length: int) -> np.ndarray:
    """(time, conversation) of rows that stand one conversation behind the other."""
    at = np.arange(length)[:, None]
    if not len(values):
        return np.zeros((length, len(starts)), values.dtype)
    return np.where(at < sizes, values[np.minimum(starts + at, len(values) - 1)], 0).astype(values.dtype)


def _changes(turn: pa.ChunkedArray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Known turns (0 if null), and whether a row is the first of its owner's rows with its turn; nulls are none."""
    known = turn.is_valid().to_numpy()
    value = turn.fill_null(0).to_numpy().astype(np.int64)
    new = known.copy()
    new[1:] &= (value[1:] != value[:-1]) | (owner[1:] != owner[:-1]) | ~known[:-1]
    return value, new


_COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
_DIGEST = "conv_id long, " + ", ".join(f"{c} long" for c in _COUNTS) + ", audit string, repaired_sha256 string"
_TURNS = "conv_id long, place long, edit string, role string, text string"


def _turn_rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], ["conv_id", "place", "edit", "role", "text"])


def _short(whole_text: bool):
    """Rows sorted by conversation and turn to digests, or to repaired rows."""

    def solve(table: pa.Table) -> pa.RecordBatch:
        starts = _groups(table, ["conv_id"])
        names = [table.column("conv_id")[int(i)].as_py() for i in starts]
        alive = table.column("alive").to_numpy()
        owner = (np.searchsorted(starts, np.arange(table.num_rows), side="right") - 1)[alive]
        table, n = table.filter(table.column("alive")), len(names)
        sizes = np.bincount(owner, minlength=n)
        starts = np.cumsum(sizes) - sizes
        blank, cut = table.column("blank").to_numpy(), table.column("cut").to_numpy()
        twice = _repeated(owner, table.column("role"), table.column("text")) & ~blank
        cut = cut & ~blank & ~twice
        gone, initial = blank | twice, _codes(table.column("role"))
        value, new = _changes(table.column("turn"), owner)
        low, high = np.full(n, np.iinfo(np.int64).max), np.full(n, np.iinfo(np.int64).min)
        known = table.column("turn").is_valid().to_numpy()
        np.minimum.at(low, owner[known], value[known])
        np.maximum.at(high, owner[known], value[known])
        distinct = np.bincount(owner[new], minlength=n)
        gaps = np.where(distinct > 0, high - low + 1 - distinct, 0)
        pairs = (owner[1:] == owner[:-1]) & ~_LEGAL[initial[:-1], initial[1:]]
        cost, audits = np.zeros(n, np.int64), [b""] * n
        for part, length in _buckets(sizes):
            a, g, c = (_tensor(x, starts[part], sizes[part], length) for x in (initial, gone, cut))
            costs = backward(a, g, c, sizes[part], np.broadcast_to(END, (len(part), 4)))
            cost[part] = costs[0, :, 0]
            for i, edits in zip(part, trace(costs, a, g, c, sizes[part], np.zeros(len(part), np.int64), np.ones(len(part), bool))[0]):
                audits[i] = edits
        roles, texts = table.column("role").to_pylist(), table.column("text").to_pylist()
        spans = [slice(int(a), int(a + s)) for a, s in zip(starts, sizes)]
        if whole_text:
            return _turn_rows([(names[k], place, *x) for k, (e, s) in enumerate(zip(audits, spans)) for place, x in enumerate(repaired(e, 0, roles[s], texts[s]))])
        hashes = [hashlib.sha256(_text(repaired(e, 0, roles[s], texts[s])).encode()).hexdigest() for e, s in zip(audits, spans)]
        sums = [np.bincount(owner, x, n).astype(np.int64) for x in (blank, twice, cut)]
        illegal = np.bincount(owner[1:], pairs, n).astype(np.int64) if len(owner) else np.zeros(n, np.int64)
        columns = [pa.array(names, pa.int64()), *(pa.array(x, pa.int64()) for x in (gaps, *sums, illegal, cost)), pa.array([a.decode() for a in audits]), pa.array(hashes)]
        return pa.RecordBatch.from_arrays(columns, ["conv_id", *_COUNTS, "audit", "repaired_sha256"])

    return lambda batches: map(solve, _whole(batches, ["conv_id"]))


def prepared(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Columns conv_id, turn, role, text, blank, cut (its last character ends no sentence) and alive of a table of rows."""
    body = F.coalesce(F.col(text), F.lit(" "))
    rest = F.rtrim(body, F.lit(SPACE))
    alive = F.col("alive") if "alive" in rows.columns else F.lit(True)
    return rows.select(
        F.col(conv).cast("long").alias("conv_id"),
        F.col(turn).cast("long").alias("turn"),
        F.coalesce(F.col(role), F.lit(" ")).alias("role"),
        body.alias("text"),
        (rest == "").alias("blank"),
        (~F.right(rest, F.lit(1)).isin(".", "!", "?")).alias("cut"),
        alive.alias("alive"),
    )


def damaged(rows: DataFrame) -> DataFrame:
    """Rows as the contract damages them; a dropped row stays with alive = false, so that its conversation is known."""
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    kind = F.crc32(key.cast("binary")) % 20
    body = F.coalesce("text", F.lit(" "))
    return (
        rows.select("conv_id", "turn", "role", "text", kind.alias("__kind"))
        .withColumn("__copy", F.explode(F.when(F.col("__kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
        .select(
            "conv_id",
            "turn",
            F.when(F.col("__kind") == 4, "user").otherwise(F.coalesce("role", F.lit(" "))).alias("role"),
            F.when(F.col("__kind") == 1, "").when(F.col("__kind") == 2, F.translate(body, ".!?", "")).otherwise(body).alias("text"),
            (F.col("__kind") != 0).alias("alive"),
        )
    )


def _number(size: int):
    """Adds ``at`` (ascending in the order of rows) and ``chunk``, the ``at`` of the chunk's first row, to sorted rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, before, chunk, held = TaskContext.get().partitionId() << 40, object(), 0, 0
        for b in batches:
            numbers, chunks = np.arange(at, at + b.num_rows), []
            for conv in b.column(0).to_pylist():
                if conv != before or held == size:
                    before, chunk, held = conv, at, 0
                held += 1
                at += 1
                chunks.append(chunk)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(numbers, pa.int64()), pa.array(chunks, pa.int64())], [*b.schema.names, "at", "chunk"])

    return run


def _chunk_parts(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    starts = _groups(table, ["chunk"])
    sizes = np.diff(np.append(starts, table.num_rows))
    blank, twice, cut = (table.column(c).to_numpy() for c in ("blank", "twice", "cut"))
    return starts, sizes, table.column("initial").to_numpy().astype(np.int8), blank, twice, cut


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A chunk's costs from each state to each state and its counts."""
    for table in _whole(batches, ["chunk"]):
        starts, sizes, initial, blank, twice, cut = _chunk_parts(table)
        n, owner = len(starts), np.repeat(np.arange(len(starts)), sizes)
        between = np.zeros((n, 4, 4), np.int32)
        for part, length in _buckets(sizes):
            a, g, c = (_tensor(x, starts[part], sizes[part], length) for x in (initial, blank | twice, cut))
            end = np.where(np.eye(4, dtype=bool), 0, _FAR).astype(np.int32)
            between[part] = backward(a, g, c, sizes[part], np.broadcast_to(end, (len(part), 4, 4)))[0].transpose(0, 2, 1)
        turn = table.column("turn")
        value, new = _changes(turn, owner)
        ends = starts + sizes - 1
        pairs = (owner[1:] == owner[:-1]) & ~_LEGAL[initial[:-1], initial[1:]]
        known = np.minimum.reduceat(np.where(turn.is_valid().to_numpy(), np.arange(len(owner)), len(owner)), starts)
        low = [int(value[i]) if i <= e else None for i, e in zip(known.tolist(), ends.tolist())]
        high = [int(value[e]) if i <= e else None for i, e in zip(known.tolist(), ends.tolist())]
        columns = {
            "conv_id": table.column("conv_id").take(pa.array(starts)).combine_chunks(),
            "chunk": table.column("chunk").take(pa.array(starts)).combine_chunks(),
            "between": pa.array(between.reshape(n, 16).tolist(), pa.list_(pa.int32())),
            **{k: pa.array(np.bincount(owner, x, n).astype(np.int64)) for k, x in (("blank", blank), ("duplicate", twice), ("truncated", cut), ("turns", new))},
            "illegal": pa.array(np.bincount(owner[1:], pairs, n).astype(np.int64)),
            "first": pa.array(initial[starts].astype(np.int64)),
            "last": pa.array(initial[ends].astype(np.int64)),
            "low": pa.array(low, pa.int64()),
            "high": pa.array(high, pa.int64()),
        }
        yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))


_SUMMARY = "conv_id long, chunk long, between array<int>, blank long, duplicate long, truncated long, turns long, illegal long, first long, last long, low long, high long"
_ENDS = "chunk long, number long, final boolean, ends array<int>, " + ", ".join(f"{c} long" for c in _COUNTS)


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Costs behind each chunk, and the conversation's counts, from all summaries of a conversation in order."""
    for table in _whole(batches, ["conv_id"]):
        starts = _groups(table, ["conv_id"])
        for a, b in zip(starts.tolist(), np.append(starts[1:], table.num_rows).tolist()):
            rows = table.slice(a, b - a).to_pydict()
            n, costs, ends = b - a, END, [None] * (b - a)
            for k in range(n - 1, -1, -1):
                ends[k] = costs.tolist()
                costs = np.minimum((np.array(rows["between"][k]).reshape(4, 4) + costs).min(axis=1), _FAR)
            illegal = sum(rows["illegal"]) + sum(not _LEGAL[x, y] for x, y in zip(rows["last"], rows["first"][1:]))
            # chunks follow each other by turn; a turn that goes on in the next chunk counts once
            known = [k for k in range(n) if rows["low"][k] is not None]
            turns = sum(rows["turns"][k] for k in known) - sum(rows["high"][j] == rows["low"][k] for j, k in zip(known, known[1:]))
            gaps = rows["high"][known[-1]] - rows["low"][known[0]] + 1 - turns if known else 0
            counts = [gaps, *(sum(rows[c]) for c in ("blank", "duplicate", "truncated")), illegal, int(costs[0])]
            columns = [rows["chunk"], list(range(n)), [k == n - 1 for k in range(n)], ends, *([c] * n for c in counts)]
            kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.list_(pa.int32()), *[pa.int64()] * len(counts)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["chunk", "number", "final", "ends", *_COUNTS])


def _traces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each chunk's edits and end state from each of the four states."""
    for table in _whole(batches, ["chunk"]):
        starts, sizes, initial, blank, twice, cut = _chunk_parts(table)
        end = np.array(table.column("ends").take(pa.array(starts)).to_pylist(), np.int32)
        final = table.column("final").to_numpy()[starts]
        to, audits = np.zeros((len(starts), 4), np.int64), np.empty((len(starts), 4), object)
        for part, length in _buckets(sizes):
            a, g, c = (_tensor(x, starts[part], sizes[part], length) for x in (initial, blank | twice, cut))
            costs = backward(a, g, c, sizes[part], end[part])
            for k in range(4):
                edits, to[part, k] = trace(costs, a, g, c, sizes[part], np.full(len(part), k), final[part])
                audits[part, k] = [e.decode() for e in edits]
        columns = [table.column(c).take(pa.array(starts)).combine_chunks() for c in ("conv_id", "chunk")]
        columns += [pa.array(to.tolist(), pa.list_(pa.int64())), pa.array(audits.tolist(), pa.list_(pa.string()))]
        yield pa.RecordBatch.from_arrays(columns, ["conv_id", "chunk", "to", "audits"])


def _from(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The state in front of each chunk."""
    for table in _whole(batches, ["conv_id"]):
        starts, state, out = set(_groups(table, ["conv_id"]).tolist()), 0, []
        for row, to in enumerate(table.column("to").to_pylist()):
            state = 0 if row in starts else state
            out.append(state)
            state = to[state]
        yield pa.RecordBatch.from_arrays([table.column("chunk").combine_chunks(), pa.array(out, pa.int32())], ["chunk", "state"])


def _said(whole_text: bool, size: int):
    """Repaired rows of one chunk, or its text (null if none) and audit."""

    def run(rows: pa.Table, plan: pa.Table) -> pa.Table:
        rows = rows.sort_by("at")
        p = plan.to_pylist()[0]
        out = repaired(p["audit"].encode(), p["state"], rows.column("role").to_pylist(), rows.column("text").to_pylist())
        if whole_text:
            return pa.Table.from_batches([_turn_rows([(p["conv_id"], p["number"] * 4 * (size + 1) + k, *x) for k, x in enumerate(out)])])
        columns = [[p["conv_id"]], [p["number"]], [_text(out) if out else None], [p["audit"]]]
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.string(), pa.string()))], ["conv_id", "number", "text", "audit"])

    return run


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One conversation's chunks after the other: its hash, and its audit."""
    at, digest, audit, said, seen = None, None, [], False, False

    def done() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array(["".join(audit)]), pa.array([digest.hexdigest()])], ["conv_id", "audit", "repaired_sha256"])

    for b in batches:
        for conv, text, part in zip(b.column("conv_id").to_pylist(), b.column("text").to_pylist(), b.column("audit").to_pylist()):
            if not seen or conv != at:
                if seen:
                    yield done()
                at, digest, audit, said, seen = conv, hashlib.sha256(), [], False, True
            if text is not None:
                digest.update((("\n" if said else "") + text).encode())
                said = True
            audit.append(part)
    if seen:
        yield done()


def _long(rows: DataFrame, whole_text: bool, chunk: int) -> DataFrame:
    n = max(1, shuffle_partitions(rows.sparkSession))
    order = [F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), "role", "text", "__place"]
    live = rows.filter("alive").drop("alive").withColumn("__place", F.monotonically_increasing_id())
    dealt = live.repartitionByRange(n, *order).sortWithinPartitions(*order).drop("__place")
    numbered = stow(dealt.mapInArrow(_number(chunk), "conv_id long, turn long, role string, text string, blank boolean, cut boolean, at long, chunk long"))
    own = ["conv_id", F.xxhash64("role", "text").alias("h1"), F.xxhash64(F.lit("again"), F.octet_length("text"), "text", "role").alias("h2")]
    first = numbered.groupBy(*own).agg(F.min("at").alias("at")).select("at", F.lit(True).alias("__first"))
    initial = F.coalesce(*[F.when(F.left("role", F.lit(1)) == k, v) for k, v in _INITIALS.items()], F.lit(0))
    # joined by a key that no two rows share, however often a text is repeated
    flags = numbered.join(first, "at", "left").withColumn("twice", F.col("__first").isNull() & ~F.col("blank"))
    flags = stow(flags.select("conv_id", "chunk", "at", "turn", initial.alias("initial"), "blank", "twice", (F.col("cut") & ~F.col("blank") & ~F.col("twice")).alias("cut")))

    def by(df: DataFrame, key: str, *then: str) -> DataFrame:
        return df.repartition(n, key).sortWithinPartitions(F.asc_nulls_first(key), *then)

    summaries = by(flags, "chunk", "at").mapInArrow(_summaries, _SUMMARY)
    ends = stow(by(summaries, "conv_id", "chunk").mapInArrow(_ends, _ENDS))
    traced = flags.join(small(ends.select("chunk", "ends", "final")), "chunk")
    traced = stow(by(traced, "chunk", "at").select("conv_id", "chunk", "initial", "blank", "twice", "cut", "ends", "final").mapInArrow(_traces, "conv_id long, chunk long, to array<long>, audits array<string>"))
    state = by(traced.select("conv_id", "chunk", "to"), "conv_id", "chunk").mapInArrow(_from, "chunk long, state int")
    plan = traced.join(state, "chunk").join(ends.select("chunk", "number"), "chunk").select("conv_id", "chunk", "number", "state", F.element_at("audits", F.col("state") + 1).alias("audit"))
    spoken = numbered.select("chunk", "at", "role", "text").groupBy("chunk").cogroup(plan.groupBy("chunk"))
    if whole_text:
        return spoken.applyInArrow(_said(True, chunk), _TURNS)
    hashed = by(spoken.applyInArrow(_said(False, chunk), "conv_id long, number long, text string, audit string"), "conv_id", "number").mapInArrow(_hashed, "conv_id long, audit string, repaired_sha256 string")
    counts = ends.filter("final").join(plan.select("conv_id", "chunk"), "chunk").select("conv_id", *_COUNTS)
    return counts.join(hashed.withColumnRenamed("conv_id", "__conv"), F.col("conv_id").eqNullSafe(F.col("__conv"))).select("conv_id", *_COUNTS, "audit", "repaired_sha256")


def _solved(rows: DataFrame, whole_text: bool, long: int, chunk: int) -> DataFrame:
    """``rows``: of ``prepared``."""
    spark = rows.sparkSession
    n = max(1, shuffle_partitions(spark))
    many = stow(rows.groupBy("conv_id").count().filter(F.col("count") > long).select(F.col("conv_id").alias("__conv"), F.lit(True).alias("__long")))
    order = [F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), "role", "text"]
    rest, schema = rows, _TURNS if whole_text else _DIGEST
    any_long = not many.isEmpty()
    if any_long:
        marked = rows.join(small(many), F.col("conv_id").eqNullSafe(F.col("__conv")), "left").drop("__conv")
        rest, rows = marked.filter("__long IS NULL").drop("__long"), marked.filter("__long").drop("__long")
    out = rest.repartition(n, "conv_id").sortWithinPartitions(*order).mapInArrow(_short(whole_text), schema)
    return out.unionByName(_long(rows, whole_text, chunk)) if any_long else out


def repair(rows: DataFrame, long: int = LONG, chunk: int = CHUNK) -> DataFrame:
    """A row for each conversation: conv_id, counts of gaps, blank, duplicate, truncated and illegal rows, cost, audit and repaired_sha256."""
    return _solved(prepared(rows), False, long, chunk)


def repaired_turns(rows: DataFrame, long: int = LONG, chunk: int = CHUNK) -> DataFrame:
    """The repaired rows: conv_id, place (ascending within a conversation), edit (K, R or I), role and text."""
    return _solved(prepared(rows), True, long, chunk)


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair(damaged(read(spark, sf_dir, "conversations")))
