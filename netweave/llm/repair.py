"""Conversation structure repair: the cheapest edits, and of equally cheap ones the least audit, by prefix-doubling ranks.

A conversation is repaired when its role initials read (s?(ua)+)?: a path through four states, one row after the other.
Every edit (Delete, Insert, Keep, Rerole) is an arc; a node is (rows done, state).

1. *Costs.* Conversations are cut into chunks. A chunk is a 4 x 4 matrix of least costs; products of neighbouring
   matrices, level by level, tell each chunk what the rest of its conversation costs from each state.
2. *Ranks.* In a chunk, arcs that lie on cheapest paths form a graph. Its nodes are ranked by their least audit of one
   edit; ranks and pointers of 2^k edits give those of 2^(k+1). Of a node's optimal arcs the one with
   the least (edit, rank behind it) is on the least path.
3. *Paths.* The pointers of 1, 2, 4, ... edits list a path in as many steps; which state a chunk is entered in comes
   from products over the chunks before it, as for costs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netweave.operators.ordered import running
from netweave.stage import stage

SPACE_CHARS = " \t\n\x0b\x0c\r"
FAR = 1 << 40
#: edits in ASCII order and their costs (fixed values); a truncated row that stays costs TRUNCATED more
EDITS, DELETE, INSERT, KEEP, REROLE, TRUNCATED = "DIKR", 2, 5, 0, 1, 5
#: states: 0 nothing yet, 1 after s, 2 after u, 3 after a; an inserted or new role is the one role that may follow
FOLLOWS = np.array([2, 2, 3, 2])
ENDS = (True, False, False, True)
#: state after keeping a row with the initial s, u, a or another; -1: not allowed
KEPT = np.array([[1, 2, -1, -1], [-1, 2, -1, -1], [-1, -1, 3, -1], [-1, 2, -1, -1]])
#: a row's code: initial (0 s, 1 u, 2 a, 3 other), 4 must go, 8 truncated
MUST_GO, CUT = 4, 8


@dataclass(frozen=True)
class RepairConfig:
    chunk: int = 1024  # rows
    fan: int = 1024  # chunks multiplied at once
    block: int = 1 << 16  # rows (with padding) that a task works on at once


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least costs through both: (..., 4, 4) matrices."""
    return np.minimum(FAR, (a[..., :, :, None] + b[..., None, :, :]).min(axis=-2))


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[str]]:
    """(target, weight) of a row's Delete, Keep and Rerole by code and state; inserts' least costs; cost and edits of the end."""
    inserts = np.full((4, 4), FAR)
    inserts[np.arange(4), np.arange(4)] = 0
    once = np.full((4, 4), FAR)
    once[np.arange(4), FOLLOWS] = INSERT
    for _ in range(4):
        inserts = np.minimum(inserts, _product(inserts, once))
    target, weight = np.zeros((16, 4, 3), dtype=int), np.full((16, 4, 3), FAR)
    for code in range(16):
        for q in range(4):
            target[code, q] = q, max(0, KEPT[q, code & 3]), FOLLOWS[q]
            weight[code, q, 0] = DELETE
            if not code & MUST_GO:
                late = TRUNCATED if code & CUT else 0
                weight[code, q, 1] = KEEP + late if KEPT[q, code & 3] >= 0 else FAR
                weight[code, q, 2] = REROLE + late
    finish = np.array([min(inserts[q, e] for e in range(4) if ENDS[e]) for q in range(4)])
    return target, weight, inserts, finish, ["I" * int(c // INSERT) for c in finish]


TARGET, WEIGHT, INSERTS, FINISH, CLOSING = _tables()


def _row_matrices() -> np.ndarray:
    """Costs of inserts and then one edit of a row, by code."""
    edits = np.full((16, 4, 4), FAR)
    for code in range(16):
        for q in range(4):
            for e in range(3):
                edits[code, q, TARGET[code, q, e]] = min(edits[code, q, TARGET[code, q, e]], WEIGHT[code, q, e])
    return _product(np.broadcast_to(INSERTS, (16, 4, 4)), edits)


ROW = _row_matrices()


def chunk_matrices(codes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """(chunks, 4, 4) from right-aligned codes (chunks, rows)."""
    out = np.full((len(codes), 4, 4), FAR)
    out[:, np.arange(4), np.arange(4)] = 0
    for p in range(codes.shape[1]):
        live = sizes >= codes.shape[1] - p
        out[live] = _product(out[live], ROW[codes[live, p]])
    return out


@dataclass(frozen=True)
class Paths:
    """Least paths of right-aligned chunks: node = (chunk * (rows + 1) + row) * 4 + state; at a chunk's end nodes stay."""

    costs: np.ndarray  # (chunks, rows + 1, 4): cost from a node to the conversation's end
    label: np.ndarray  # of the edit that leaves a node on its least path: 1 + its place in EDITS, 0 at the end
    pointers: list[np.ndarray]  # nodes after 1, 2, 4, ... edits

    @property
    def ends(self) -> np.ndarray:
        return self.pointers[-1][self.pointers[-1]]

    def walk(self, starts: np.ndarray) -> np.ndarray:
        """(chunks, steps): the nodes on the paths from the given ones."""
        nodes = starts[:, None]
        for jump in self.pointers:
            nodes = np.hstack([nodes, jump[nodes]])
        return nodes


def least_paths(codes: np.ndarray, tails: np.ndarray) -> Paths:
    """Cost programme and prefix-doubling ranks of chunks whose ends cost ``tails`` (chunks, 4)."""
    n, rows = codes.shape
    costs = np.empty((n, rows + 1, 4), dtype=np.int64)
    costs[:, rows] = tails
    for p in range(rows - 1, -1, -1):
        behind = (WEIGHT[codes[:, p]] + costs[np.arange(n)[:, None, None], p + 1, TARGET[codes[:, p]]]).min(axis=-1)
        costs[:, p] = np.minimum(FAR, (INSERTS + behind[:, None, :]).min(axis=-1))
    nodes = np.arange(n * (rows + 1) * 4).reshape(n, rows + 1, 4)
    # arcs in the order of EDITS; none leaves the chunk's end, where the next chunk goes on
    here, there = nodes[:, :-1], nodes[:, 1:, :1]
    to = np.stack([there + TARGET[codes][..., 0], here[..., :1] + FOLLOWS, there + TARGET[codes][..., 1], there + TARGET[codes][..., 2]], axis=-1)
    weight = WEIGHT[codes]
    weight = np.stack([weight[..., 0], np.full_like(weight[..., 0], INSERT), weight[..., 1], weight[..., 2]], axis=-1)
    flat = costs.ravel()
    optimal = (flat[to] + weight == costs[:, :-1, :, None]) & (costs[:, :-1, :, None] < FAR)
    rank = np.zeros((n, rows + 1, 4), dtype=np.int64)
    rank[:, :-1] = np.where(optimal.any(axis=-1), optimal.argmax(axis=-1) + 1, 0)
    pointer = nodes.copy()
    pointer[:, :-1] = np.where(rank[:, :-1] > 0, np.take_along_axis(to, np.maximum(rank[:, :-1] - 1, 0)[..., None], axis=-1)[..., 0], here)
    rank, pointer = rank.ravel(), pointer.ravel()
    while True:  # ranks of 2^k edits and of those behind them
        behind = pointer[pointer]
        _, rank = np.unique(rank * (rank.max(initial=0) + 1) + np.where(pointer == np.arange(len(pointer)), 0, rank[pointer]), return_inverse=True)
        if (behind == pointer).all():
            break
        pointer = behind
    order = np.where(optimal, np.arange(4) * (rank.max(initial=0) + 1) + rank[to], np.iinfo(np.int64).max)
    pick = order.argmin(axis=-1)
    label = np.zeros((n, rows + 1, 4), dtype=np.int64)
    label[:, :-1] = np.where(optimal.any(axis=-1), pick + 1, 0)
    pointer = nodes.copy()
    pointer[:, :-1] = np.where(label[:, :-1] > 0, np.take_along_axis(to, pick[..., None], axis=-1)[..., 0], here)
    pointers = [pointer.ravel()]
    while not (pointers[-1][pointers[-1]] == pointers[-1]).all():
        pointers.append(pointers[-1][pointers[-1]])
    return Paths(costs, label.ravel(), pointers)


def _aligned(column: pa.ListArray, block: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(places of the chunks, right-aligned codes, sizes) in blocks of chunks of like size."""
    sizes = np.asarray(column.value_lengths())
    values, starts = column.flatten().to_numpy(), np.concatenate([[0], np.cumsum(sizes)])
    order = np.argsort(sizes, kind="stable")
    lo = 0
    while lo < len(order):
        hi = lo + 1
        while hi < len(order) and (hi + 1 - lo) * sizes[order[hi]] <= block:
            hi += 1
        some = order[lo:hi]
        width = int(sizes[some].max())
        codes = np.zeros((len(some), width), dtype=np.int64)
        for k, at in enumerate(some):
            codes[k, width - sizes[at]:] = values[starts[at]:starts[at + 1]]
        yield some, codes, sizes[some]
        lo = hi


# ---- over a conversation's chunks ----------------------------------------------------------


def _carried(pieces: DataFrame, start: np.ndarray, forward: bool, fan: int) -> DataFrame:
    """(key, no, v): what the pieces (key, no, m) before (forward) or after each one make of ``start``.

    ``fan`` neighbouring matrices are multiplied into one, level by level, until every key has one; then the vectors
    come down the levels. A task holds ``fan`` small matrices, however long a conversation is.
    """
    pack = F.sort_array(F.collect_list(F.struct("no", "m")), asc=forward).alias("parts")

    def matrix(m) -> np.ndarray:
        m = np.asarray(m, dtype=np.int64).reshape(4, 4)
        return m if forward else m.T

    def multiplied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for parts in batch.column(2).to_pylist():
                whole = matrix(parts[0]["m"])
                for part in parts[1:]:
                    whole = _product(whole, matrix(part["m"]))
                out.append((whole if forward else whole.T).ravel().tolist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.list_(pa.int64()))], ["key", "no", "m"])

    def handed_down(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, nos, vectors = [], [], []
            for key, parts, v in zip(*(batch.column(k).to_pylist() for k in range(3))):
                v = np.asarray(v, dtype=np.int64)
                for part in parts:
                    keys.append(key)
                    nos.append(part["no"])
                    vectors.append(v.tolist())
                    v = _product(v[None, :], matrix(part["m"]))[0]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(nos, pa.int64()), pa.array(vectors, pa.list_(pa.int64()))], ["key", "no", "v"])

    levels = [pieces]
    while (levels[-1].agg(F.max("no")).first()[0] or 0) > 0:
        packed = levels[-1].groupBy("key", F.expr(f"no div {fan}").alias("up")).agg(pack)
        levels.append(stage(packed.mapInArrow(multiplied, "key string, no bigint, m array<bigint>")))
    found = levels[-1].select("key", "no", F.array(*[F.lit(int(x)) for x in start]).cast("array<bigint>").alias("v"))
    for level in reversed(levels[:-1]):
        packed = level.groupBy("key", F.expr(f"no div {fan}").alias("up")).agg(pack)
        joined = packed.join(found.withColumnRenamed("no", "up"), ["key", "up"]).select("key", "parts", "v")
        found = stage(joined.mapInArrow(handed_down, "key string, no bigint, v array<bigint>"))
    return found


def _matrices(chunks: DataFrame, block: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.zeros((batch.num_rows, 16), dtype=np.int64)
            for some, codes, sizes in _aligned(batch.column(2), block):
                out[some] = chunk_matrices(codes, sizes).reshape(-1, 16)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out.tolist(), pa.list_(pa.int64()))], ["key", "no", "m"])

    return stage(chunks.select("key", "no", "codes").mapInArrow(run, "key string, no bigint, m array<bigint>"))


def _passages(chunks: DataFrame, block: int) -> DataFrame:
    """Which state a chunk's least path ends in from every state it may be entered in, as matrices of 0 and FAR."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tails = np.array(batch.column(3).to_pylist(), dtype=np.int64).reshape(-1, 4)
            out = np.full((batch.num_rows, 4, 4), FAR)
            for some, codes, sizes in _aligned(batch.column(2), block):
                paths, width = least_paths(codes, tails[some]), codes.shape[1]
                starts = ((np.arange(len(some)) * (width + 1) + width - sizes) * 4)[:, None] + np.arange(4)
                open_ = paths.costs[np.arange(len(some)), width - sizes] < FAR
                row, q = np.nonzero(open_)
                out[some[row], q, paths.ends[starts[row, q]] % 4] = 0
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(out.reshape(-1, 16).tolist(), pa.list_(pa.int64()))], ["key", "no", "m"],
            )

    return stage(chunks.select("key", "no", "codes", "tail").mapInArrow(run, "key string, no bigint, m array<bigint>"))


def _edited(chunks: DataFrame, config: RepairConfig) -> DataFrame:
    """(key, no, cost, illegal, audit, rows, roles): a chunk's edits; its repaired rows by position (null: inserted) and new role (null: its own)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some, codes, sizes in _aligned(batch.column(2), config.block):
                yield block(batch.take(pa.array(some)), codes, sizes)

    def block(rows: pa.RecordBatch, codes: np.ndarray, sizes: np.ndarray) -> pa.RecordBatch:
        no, last = rows.column(1).to_numpy(), rows.column(5).to_numpy(zero_copy_only=False)
        tails, entry = (np.array(rows.column(k).to_pylist(), dtype=np.int64).reshape(-1, 4) for k in (3, 4))
        entry, width, each = entry.argmin(axis=1), codes.shape[1], np.arange(len(codes))
        paths = least_paths(codes, tails)
        starts = (each * (width + 1) + width - sizes) * 4 + entry
        nodes = paths.walk(starts)
        labels = paths.label[nodes]
        ends = paths.ends[starts] % 4
        letters = np.array(["", *EDITS])
        closing = [CLOSING[q] if fin else "" for q, fin in zip(ends, last)]
        audit = ["".join(letters[row].tolist()) + end for row, end in zip(labels, closing)]
        # inserts of the conversation's end follow the last row
        states = np.hstack([nodes % 4, ends[:, None], FOLLOWS[ends][:, None]])
        more = np.array([len(c) for c in closing])[:, None] > np.arange(2)
        labels = np.hstack([labels, np.where(more, 1 + EDITS.index("I"), 0)])
        place = np.hstack([nodes // 4 % (width + 1) - (width - sizes)[:, None], np.zeros((len(codes), 2), dtype=np.int64)]) + (no * config.chunk)[:, None]
        stays = labels > 1
        cuts = pa.array(np.concatenate([[0], np.cumsum(stays.sum(axis=1))]), pa.int32())
        inserted, kept = labels[stays] == 1 + EDITS.index("I"), labels[stays] == 1 + EDITS.index("K")
        role = np.where(FOLLOWS[states[stays]] == 2, "user", "assistant").astype(object)
        pair = (codes[:, :-1] & 3) * 4 + (codes[:, 1:] & 3)
        inside = np.arange(1, width) > (width - sizes)[:, None] if width > 1 else np.zeros((len(codes), 0), dtype=bool)
        illegal = (inside & ~np.isin(pair, LEGAL)).sum(axis=1)
        return pa.RecordBatch.from_arrays([
            rows.column(0), rows.column(1), pa.array(paths.costs[each, width - sizes, entry], pa.int64()), pa.array(illegal, pa.int64()),
            pa.array(audit, pa.string()), pa.ListArray.from_arrays(cuts, pa.array(place[stays], pa.int64(), mask=inserted)),
            pa.ListArray.from_arrays(cuts, pa.array(role, pa.string(), mask=kept)),
        ], ["key", "no", "cost", "illegal", "audit", "rows", "roles"])

    schema = "key string, no bigint, cost bigint, illegal bigint, audit string, rows array<bigint>, roles array<string>"
    return stage(chunks.select("key", "no", "codes", "tail", "entry", "last").mapInArrow(run, schema))


#: neighbouring initials su, ua, au
LEGAL = (1, 6, 9)


def _digests(lines: DataFrame) -> DataFrame:
    """(key, repaired_sha256) of ordered lines (key, no, at, line), joined by newlines: streamed, so a task holds one batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        for batch in batches:
            keys, out = batch.column(0).to_pylist(), []
            for key, line in zip(keys, batch.column(1).to_pylist()):
                if key != now:
                    if state is not None:
                        out.append((now, state.hexdigest()))
                    now, state = key, hashlib.sha256()
                else:
                    state.update(b"\n")
                state.update(line.encode("utf-8", "surrogatepass"))
            yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], pa.string()) for k in range(2)], ["key", "sha"])
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now]), pa.array([state.hexdigest()])], ["key", "sha"])

    ordered = lines.repartition("key").sortWithinPartitions("key", "no", "at").select("key", "line")
    return ordered.mapInArrow(run, "key string, sha string")


def _key(conv: Column) -> Column:
    return F.coalesce(F.concat(F.lit("="), conv.cast("string")), F.lit("-"))


def repair(
    turns: DataFrame,
    keys: DataFrame | None = None,
    config: RepairConfig = RepairConfig(),
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
) -> DataFrame:
    """(conv, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256, n_rows, n_repaired) of every conversation.

    Conversations are those of ``turns`` and, if given, of ``keys``; one without rows has zeros, an empty audit and the hash of
    the empty string. Rows go by turn (nulls first), then role and text by code points; null roles and texts are one space.
    A row's first fault counts: blank, duplicate (role and text seen before in the conversation), truncated (last
    character that is no white space is none of ``.!?``). gaps are missing numbers between the least and the greatest
    turn. illegal counts neighbours whose role initials aren't su, ua or au.

    Edits: Keep 0, Rerole to user or assistant 1, Delete 2 (blank and duplicate rows must go), Insert an empty user or
    assistant row 5; a truncated row that stays costs 5 more. The cheapest edits that leave initials (s?(ua)+)? win,
    among them the ASCII-least audit. In every state one role may be inserted or given, so an audit fixes its
    repair. An empty role has no initial and can't be kept. Rows without a conversation id form one
    conversation; repeated rows are duplicates; other columns are ignored; no rows give no rows.

    A conversation may hold most rows: rows are numbered over ranges, repeats found by a grouping of digests and a plain
    join, costs and paths computed by chunk. What remains of a conversation's size are its own results: the audit
    is one string, and its SHA-256 runs over its repaired rows in order, streamed through one task.
    """
    parts = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    conv_type = dict(turns.dtypes)[conv_col]
    role, text = F.coalesce(F.col(role_col), F.lit(" ")), F.coalesce(F.col(text_col), F.lit(" "))
    rows = turns.select(F.col(conv_col).alias("conv"), _key(F.col(conv_col)).alias("key"), F.col(turn_col).alias("turn"), role.alias("role"), text.alias("text"))
    order = ["turn", "role", "text"]
    rows = stage(rows.repartitionByRange(parts, "key", *order).withColumn("part", F.spark_partition_id()))
    rows = running(rows, ["key"], order, F.col("part"), {"n": (F.lit(1), "sum")}).withColumn("pos", F.col("n").cast("long") - 1)
    solid = F.btrim("text", F.lit(SPACE_CHARS))
    rows = stage(rows.select(
        "conv", "key", "turn", "pos", "role", "text", F.unhex(F.md5(F.concat(F.md5("role"), F.md5("text")))).alias("same"),
        (F.array_position(F.array(F.lit("s"), F.lit("u"), F.lit("a")), F.substring("role", 1, 1)).cast("int") - 1).alias("initial"),
        (solid == "").alias("blank"), (~F.substring(solid, -1, 1).isin(".", "!", "?")).alias("cut"),
    ).withColumn("initial", F.when(F.col("initial") < 0, 3).otherwise(F.col("initial"))))
    small = rows.select("key", "turn", "pos", "same", "initial", "blank", "cut")
    firsts = small.groupBy("key", "same").agg(F.min("pos").alias("first"))
    fault = F.when(F.col("blank"), "blank").when(F.col("pos") > F.col("first"), "duplicate").when(F.col("cut"), "truncated")
    small = small.join(firsts, ["key", "same"]).withColumn("fault", fault)
    code = F.col("initial") + F.when(F.col("fault").isin("blank", "duplicate"), MUST_GO).when(F.col("fault") == "truncated", CUT).otherwise(0)
    small = stage(small.select("key", "turn", "pos", "initial", "fault", code.cast("tinyint").alias("code")))

    packed = small.groupBy("key", F.expr(f"pos div {config.chunk}").alias("no")).agg(F.sort_array(F.collect_list(F.struct("pos", "code"))).alias("p"))
    chunks = stage(packed.select("key", "no", F.col("p.code").alias("codes")))
    start = F.array(*[F.lit(x) for x in (0, FAR, FAR, FAR)]).cast("array<bigint>")
    if (chunks.agg(F.max("no")).first()[0] or 0) == 0:  # every conversation is one chunk
        ends = F.array(*[F.lit(int(x)) for x in FINISH]).cast("array<bigint>")
        chunks = chunks.withColumn("tail", ends).withColumn("entry", start).withColumn("last", F.lit(True))
    else:
        tails = _carried(_matrices(chunks, config.block), FINISH, False, config.fan).withColumnRenamed("v", "tail")
        chunks = stage(chunks.join(tails, ["key", "no"]))
        entries = _carried(_passages(chunks, config.block), np.array([0, FAR, FAR, FAR]), True, config.fan).withColumnRenamed("v", "entry")
        final = chunks.groupBy("key").agg(F.max("no").alias("final"))
        chunks = stage(chunks.join(entries, ["key", "no"]).join(final, "key").withColumn("last", F.col("no") == F.col("final")))
    edited = _edited(chunks, config)

    lines = edited.select("key", "no", F.posexplode(F.arrays_zip("rows", "roles")).alias("at", "line")).select(
        "key", "no", "at", F.col("line.rows").alias("pos"), F.col("line.roles").alias("given")
    )
    texts = rows.select("key", "pos", "role", "text")
    kept = lines.where("pos is not null").join(texts, ["key", "pos"]).select(
        "key", "no", "at", F.concat(F.coalesce("given", "role"), F.lit(":"), "text").alias("line")
    )
    added = lines.where("pos is null").select("key", "no", "at", F.concat("given", F.lit(":")).alias("line"))
    digests = _digests(kept.unionByName(added))

    border = small.where((F.col("pos") > 0) & (F.col("pos") % config.chunk == 0)).select("key", "pos", F.col("initial").alias("b"))
    before = small.where((F.col("pos") + 1) % config.chunk == 0).select("key", (F.col("pos") + 1).alias("pos"), F.col("initial").alias("a"))
    crossing = border.join(before, ["key", "pos"]).where(~(F.col("a") * 4 + F.col("b")).isin(*LEGAL)).groupBy("key").agg(F.count("*").alias("crossing"))
    edits = edited.groupBy("key").agg(
        F.sum(F.when(F.col("no") == 0, F.col("cost"))).alias("cost"), F.sum("illegal").alias("illegal"), F.sum(F.size("rows")).alias("n_repaired"),
        F.array_join(F.sort_array(F.collect_list(F.struct("no", "audit")))["audit"], "").alias("audit"),
    )
    numbers = small.groupBy("key", "turn").agg(
        F.count("*").alias("n"), *[F.count_if(F.col("fault") == f).alias(f) for f in ("blank", "duplicate", "truncated")]
    ).groupBy("key").agg(
        F.sum("n").alias("n_rows"), *[F.sum(f).alias(f) for f in ("blank", "duplicate", "truncated")],
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).cast("long").alias("gaps"),
    )
    every = turns.select(F.col(conv_col).alias("conv"))
    if keys is not None:
        every = every.unionByName(keys.select(F.col(conv_col).cast(conv_type).alias("conv")))
    every = every.distinct().withColumn("key", _key(F.col("conv")))
    out = every.join(numbers, "key", "left").join(edits, "key", "left").join(crossing, "key", "left").join(digests, "key", "left")
    counts = {c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "cost", "n_rows", "n_repaired")}
    illegal = (F.coalesce("illegal", F.lit(0)) + F.coalesce("crossing", F.lit(0))).cast("long").alias("illegal")
    return out.select(
        F.col("conv").alias(conv_col), *[counts[c] for c in ("gaps", "blank", "duplicate", "truncated")], illegal, counts["cost"],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("sha", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"), counts["n_rows"], counts["n_repaired"],
    )


def damaged(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Conversations with planted faults, by the CRC-32 of ``conv:turn`` modulo 20: 0 drops the row, 1 empties its text, 2 removes
    its full stops, exclamation and question marks, 3 repeats it, 4 makes it the user's. Nulls count as one space."""
    named = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in (conv_col, turn_col)]
    fate = F.crc32(F.concat(named[0], F.lit(":"), named[1]).cast("binary")) % 20
    role, text = (F.coalesce(F.col(c), F.lit(" ")) for c in (role_col, text_col))
    rows = turns.select(
        F.col(conv_col), F.col(turn_col), F.when(fate == 4, "user").otherwise(role).alias(role_col),
        F.when(fate == 1, "").when(fate == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias(text_col), fate.alias("_fate"),
    )
    copies = F.when(F.col("_fate") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.where("_fate <> 0").withColumn("_copy", F.explode(copies)).drop("_fate", "_copy")
