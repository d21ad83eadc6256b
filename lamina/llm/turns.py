"""Repair of conversation structure at the least cost, ties by the least audit.

A conversation's rows are taken by turn (nulls first; ties by role and text in code-point order). Edits keep, rerole, delete
or insert rows so that role initials are (s?(ua)+)?; the audit names them in order by K, R, D and I.

Cost: dynamic programming over nodes (rows left, state of the pattern), backwards. Arcs that lie on a cheapest path are the optimal
ones, and their labels differ at each node, as a label and a state determine the next state; so a node's pointer is its arc of least rank.
Ranks of audits of length 1, 2, 4, ... follow by doubling: a node's rank at twice the length is that of the pair (own rank, rank of
the node that its pointer leads to). The doubled pointers give the nodes of all least paths in so many steps as the
length has bits. All conversations of a batch are solved together in arrays.

A conversation of more than `long_rows` rows or `long_chars` characters is never gathered. Its rows are sorted by range over many
tasks (exactly equal rows too) and cut into segments. A segment's cost is a table from the state at its
begin to that at its end; a stream over these small tables, one a segment, gives the costs behind each segment, a second one the state before it, and every
segment is then solved by itself. Only hashing the repaired text and joining the audit's pieces, which one row holds, read a whole
conversation, in order and as a stream.

Null roles and texts count as one space, a null conv_id is a conversation. A repeated row is a duplicate. An empty table gives no rows.
Extra columns are not read. A role counts by its first character; one without any is never kept.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tables

SPACE = " \t\n\x0b\x0c\r"
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: States: 0 nothing yet, 1 after s, 2 after u, 3 after a. Roles: 0 s, 1 u, 2 a, 3 any other.
START, AFTER_S, AFTER_U, AFTER_A = range(4)
ON_KEEP = np.array([[1, 2, -1, -1], [-1, 2, -1, -1], [-1, -1, 3, -1], [-1, 2, -1, -1]])
ON_MADE = np.array([2, 2, 3, 2])
FAR = 1 << 50
#: Costs at the end of a conversation, with what must still be inserted
AT_END = np.array([0, 2 * INSERT, INSERT, 0])
LABELS = b".DIKR"
MADE = {AFTER_U: "user", AFTER_A: "assistant"}


def initial(role: str) -> int:
    return "sua".find(role[0]) % 4 if role else 3


def cost_to_go(role: np.ndarray, must: np.ndarray, late: np.ndarray, begin: np.ndarray, size: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Least cost from each boundary and state of segments to the end, given the costs after each (segments x 4).

    Segment s with rows begin[s] .. begin[s] + size[s] - 1 has boundaries begin[s] + s and following.
    """
    v = np.empty((len(role) + len(begin), 4), np.int64)
    at = begin + np.arange(len(begin))
    v[at + size] = after
    down = np.argsort(-size, kind="stable")
    many = np.searchsorted(-size[down], -np.arange(int(size.max(initial=0))), side="left")
    for k, m in enumerate(many):
        s = down[:m]
        i, b = begin[s] + size[s] - 1 - k, at[s] + size[s] - 1 - k
        then, keeps = v[b + 1], ON_KEEP[:, role[i]].T
        kept = np.where(keeps >= 0, np.take_along_axis(then, np.maximum(keeps, 0), axis=1) + KEEP, FAR)
        used = np.minimum(kept, then[:, ON_MADE] + REROLE) + late[i, None] * TRUNCATED
        w = np.minimum(then + DELETE, np.where(must[i, None], FAR, used))
        one = w[:, ON_MADE]
        v[b] = np.minimum(w, np.minimum(one + INSERT, one[:, ON_MADE] + 2 * INSERT))
    return v


class Paths:
    """The optimal arcs' nodes (4 * boundary + state), their ranks, and least paths by doubled pointers."""

    def __init__(self, role, must, late, begin, size, v, last):
        n, seg = len(role), np.repeat(np.arange(len(begin)), size + 1)
        end = np.zeros(len(v), bool)
        end[begin + np.arange(len(begin)) + size] = True
        row = np.minimum(np.arange(len(v)) - seg, max(n - 1, 0))
        node = 4 * np.arange(len(v))[:, None] + np.arange(4)
        then = np.vstack([v[1:], v[:1]])
        inside = ~end[:, None]
        r, free, pay = (role[row], ~must[row][:, None], late[row][:, None] * TRUNCATED) if n else (np.zeros(len(v), int), False, 0)
        keeps = ON_KEEP[:, r].T
        after_keep = np.take_along_axis(then, np.maximum(keeps, 0), axis=1)
        stop = end[:, None] & (~last[seg][:, None] | np.isin(np.arange(4), (START, AFTER_A)))
        arcs = (
            (1, inside & (v == then + DELETE), node + 4),
            (2, ~stop & (v == v[:, ON_MADE] + INSERT) & (inside | last[seg][:, None]), node - np.arange(4) + ON_MADE),
            (3, inside & free & (keeps >= 0) & (v == after_keep + KEEP + pay), node + 4 - np.arange(4) + keeps),
            (4, inside & free & (v == then[:, ON_MADE] + REROLE + pay), node + 4 - np.arange(4) + ON_MADE),
        )
        label, to = np.zeros(v.shape, np.int64), node.copy()
        for k, ok, target in reversed(arcs):  # the least rank at length 1 is set last
            label, to = np.where(ok & ~stop, k, label), np.where(ok & ~stop, target, to)
        self.label, self.rank = label.reshape(-1), label.reshape(-1)
        self.jumps = [to.reshape(-1)]
        while self.label[self.jumps[-1]].any():
            jump = self.jumps[-1]
            self.rank = np.unique(self.rank * (len(self.rank) + 5) + self.rank[jump], return_inverse=True)[1]
            self.jumps.append(jump[jump])

    def walk(self, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Nodes of the least path from each start, one path after another, without its last node, and the number of each."""
        path = start[:, None]
        for jump in reversed(self.jumps):
            path = np.stack([path, jump[path]], axis=2).reshape(len(start), -1)
        on = self.label[path] > 0
        return path[on], on.sum(axis=1)


def flags(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Blank, and without a mark at the end."""
    trimmed = pc.utf8_rtrim(text, characters=SPACE)
    blank = pc.equal(pc.binary_length(trimmed), 0).to_numpy(zero_copy_only=False)
    return blank, ~pc.match_substring_regex(trimmed, r"[.!?]\z").to_numpy(zero_copy_only=False) & ~blank


def lines(paths: Paths, nodes: np.ndarray, role: list[str], text: list[str], seg: np.ndarray) -> list[str]:
    """`role:text` of what the edits on a path give."""
    out = []
    for node, k, s in zip(nodes.tolist(), paths.label[nodes].tolist(), seg.tolist(), strict=True):
        if k > 1:
            i = (node >> 2) - s
            out.append(f"{role[i] if k == 3 else MADE[int(ON_MADE[node & 3])]}:{'' if k == 2 else text[i]}")
    return out


def crossing(codes: np.ndarray) -> np.ndarray:
    """Whether role codes next to each other are none of su, ua and au."""
    pair = codes[:-1] * 4 + codes[1:]
    return (pair != 1) & (pair != 6) & (pair != 9)


COUNTS = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long"


def solved(conv: list, begin: np.ndarray, turn: list, role: list[str], text: pa.Array) -> dict[str, list]:
    """Results of whole conversations, rows begin[s] .. begin[s + 1] - 1 each."""
    size, texts, n = np.diff(begin), text.to_pylist(), len(role)
    blank, late = flags(text)
    seg = np.repeat(np.arange(len(size)), size)
    seen, again = set(), np.zeros(n, bool)
    for i, key in enumerate(zip(seg.tolist(), role, texts, strict=True)):
        again[i] = key in seen
        seen.add(key)
    again, late = again & ~blank, late & ~again
    codes, must = np.array([initial(r) for r in role], np.int64), blank | again
    v = cost_to_go(codes, must, late, begin[:-1], size, np.tile(AT_END, (len(size), 1)))
    paths = Paths(codes, must, late, begin[:-1], size, v, np.ones(len(size), bool))
    starts = begin[:-1] + np.arange(len(size))
    nodes, count = paths.walk(4 * starts)
    audit, ends = np.frombuffer(LABELS, np.uint8)[paths.label[nodes]].tobytes().decode(), np.cumsum(count)
    out: dict[str, list] = {"conv_id": conv, "gaps": [], "audit": [], "repaired_sha256": []}
    for s, (a, b) in enumerate(zip((ends - count).tolist(), ends.tolist(), strict=True)):
        known = {t for t in turn[begin[s] : begin[s + 1]] if t is not None}
        out["gaps"].append(max(known) - min(known) + 1 - len(known) if known else 0)
        out["audit"].append(audit[a:b])
        out["repaired_sha256"].append(hashlib.sha256("\n".join(lines(paths, nodes[a:b], role, texts, np.full(b - a, s))).encode()).hexdigest())
    sums = lambda x, of=seg: np.bincount(of, weights=x, minlength=len(size)).astype(np.int64).tolist()
    same = seg[1:] == seg[:-1]
    return out | {"blank": sums(blank), "duplicate": sums(again), "truncated": sums(late), "illegal": sums((crossing(codes) & same).astype(int), seg[1:]), "cost": v[starts, START].tolist()}


def short(rows: DataFrame, kind: str) -> DataFrame:
    """Conversations that fit into a batch: one shuffle, then a stream over sorted rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def given(table: pa.Table) -> pa.RecordBatch:
            conv, here = table.column("conv_id").to_pylist(), table.column("here").to_numpy(zero_copy_only=False)
            first = [i for i in range(len(conv)) if not i or conv[i] != conv[i - 1]]
            kept = table.filter(pa.array(here))
            begin = np.concatenate([[0], np.cumsum(here)])[[*first, len(conv)]]
            got = solved([conv[i] for i in first], begin, kept.column("turn").to_pylist(), kept.column("role").to_pylist(), kept.column("text").combine_chunks())
            return pa.RecordBatch.from_arrays([pa.array(got["conv_id"], table.schema.field("conv_id").type), *(pa.array(got[c]) for c in names[1:])], names=names)

        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= 4000 or sum(b.nbytes for b in held) >= 8 << 20:
                table = pa.Table.from_batches(held)
                conv = table.column("conv_id").to_pylist()
                cut = len(conv)
                while cut and conv[cut - 1] == conv[-1]:
                    cut -= 1
                if cut:
                    yield given(table.slice(0, cut).combine_chunks())
                    held = table.slice(cut).combine_chunks().to_batches()
        if sum(b.num_rows for b in held):
            yield given(pa.Table.from_batches(held))

    names = ["conv_id", *(x.split()[0] for x in COUNTS.split(", ")), "audit", "repaired_sha256"]
    dealt = rows.repartition("conv_id").sortWithinPartitions("conv_id", F.asc_nulls_first("turn"), "role", "text")
    return dealt.mapInArrow(run, f"conv_id {kind}, {COUNTS}, audit string, repaired_sha256 string")


def folded(df: DataFrame, kind: str, schema: str, step, rising: bool = True) -> DataFrame:
    """step(state or None, row) -> (state, rows to give) along the segments of each conversation, as a stream; row is None at a conversation's end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = {n: t for n, t in zip(names, wanted, strict=True)}
        state, before, any_ = None, None, False
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if any_ and row["conv_id"] != before:
                    out += step(state, None)[1]
                    state = None
                state, more = step(state, row)
                out += more
                before, any_ = row["conv_id"], True
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], types[c]) for c in names], names=names)
        if any_:
            out = step(state, None)[1]
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], types[c]) for c in names], names=names)

    from pyspark.sql.pandas.types import to_arrow_schema

    fields = to_arrow_schema(df.sparkSession.createDataFrame([], schema).schema)
    names, wanted = fields.names, fields.types
    order = F.col("seg") if rising else F.desc("seg")
    return df.repartition("conv_id").sortWithinPartitions("conv_id", order).mapInArrow(run, schema)


def segment_arrays(batch: pa.RecordBatch) -> tuple:
    """begin, size, role codes, must and late of the segments in a batch."""
    rows = batch.column("rows")
    size = pc.list_value_length(rows).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = rows.flatten()
    role, must, late = (flat.field(k).to_numpy(zero_copy_only=False) for k in ("role", "must", "late"))
    return np.cumsum(size) - size, size, role.astype(np.int64), must, late


def exits(batch: pa.RecordBatch) -> np.ndarray:
    return np.array(batch.column("after").to_pylist(), np.int64).reshape(-1, 4)


def long(rows: DataFrame, kind: str, seg_rows: int, seg_chars: int) -> DataFrame:
    """Conversations in segments that many tasks share."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, seg, pos, chars, before, begun = TaskContext.get().partitionId() << 32, -1, 0, 0, None, False
        for batch in batches:
            segs, places = [], []
            for conv, k in zip(batch.column("conv_id").to_pylist(), pc.binary_length(batch.column("text")).to_pylist(), strict=True):
                if not begun or conv != before or pos >= seg_rows or chars >= seg_chars:
                    seg, pos, chars = seg + 1, 0, 0
                segs.append(base + seg)
                places.append(pos)
                pos, chars, before, begun = pos + 1, chars + k, conv, True
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("conv_id", "turn", "role", "text")), pa.array(segs, pa.int64()), pa.array(places, pa.int32())], names=["conv_id", "turn", "role", "text", "seg", "pos"])

    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            begin, size, role, must, late = segment_arrays(batch)
            m = np.empty((len(begin), 4, 4), np.int64)
            for q in range(4):
                v = cost_to_go(role, must, late, begin, size, np.tile(np.where(np.arange(4) == q, 0, FAR), (len(begin), 1)))
                m[:, :, q] = np.minimum(v[begin + np.arange(len(begin))], FAR)
            wrong = np.concatenate([crossing(role), [False]])
            wrong[begin + size - 1] = False
            out = {"conv_id": batch.column("conv_id"), "seg": batch.column("seg"), "m": pa.array(m.reshape(-1, 16).tolist()), "first": pa.array(role[begin]), "final": pa.array(role[begin + size - 1]), "late": pa.array(np.add.reduceat(late.astype(np.int64), begin)), "wrong": pa.array(np.add.reduceat(wrong.astype(np.int64), begin))}
            yield pa.RecordBatch.from_pydict(out)

    def behind(state, row):
        if row is None:
            return None, []
        after, last = (AT_END, True) if state is None else (state, False)
        v = (np.array(row["m"]).reshape(4, 4) + after).min(axis=1)
        return v, [{"seg": row["seg"], "after": [int(x) for x in after], "last": last, "cost": int(v[START])}]

    def ahead(state, row):
        if row is None:
            return None, []
        return row["to"][state or 0], [{"seg": row["seg"], "state": state or 0}]

    def opened(batch: pa.RecordBatch) -> tuple[Paths, np.ndarray]:
        begin, size, role, must, late = segment_arrays(batch)
        v = cost_to_go(role, must, late, begin, size, exits(batch))
        return Paths(role, must, late, begin, size, v, batch.column("last").to_numpy(zero_copy_only=False)), begin + np.arange(len(begin))

    def leads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                paths, at = opened(batch)
                to = paths.jumps[-1][(4 * at[:, None] + np.arange(4)).reshape(-1)].reshape(-1, 4) & 3
                yield pa.RecordBatch.from_pydict({"conv_id": batch.column("conv_id"), "seg": batch.column("seg"), "to": pa.array(to.tolist(), pa.list_(pa.int32()))})

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            paths, at = opened(batch)
            nodes, count = paths.walk(4 * at + batch.column("state").to_numpy(zero_copy_only=False))
            flat = batch.column("texts").flatten()
            got = np.split(nodes, np.cumsum(count)[:-1])
            role, text = flat.field("role").to_pylist(), flat.field("text").to_pylist()
            pieces = [lines(paths, x, role, text, np.full(len(x), s)) for s, x in enumerate(got)]
            out = {"conv_id": batch.column("conv_id"), "seg": batch.column("seg"), "cost": batch.column("cost"), "audit": pa.array([bytes(LABELS[k] for k in paths.label[x]).decode() for x in got]), "kept": pa.array([len(p) for p in pieces], pa.int64()), "piece": pa.array(["\n".join(p) for p in pieces])}
            yield pa.RecordBatch.from_pydict(out)

    def ended(state, row):
        if row is None:
            return None, [{"conv_id": state["id"], "cost": state["cost"], "audit": "".join(state["audit"]), "repaired_sha256": state["sha"].hexdigest()}]
        if state is None:
            state = {"id": row["conv_id"], "cost": row["cost"], "audit": [], "sha": hashlib.sha256(), "any": False}
        state["audit"].append(row["audit"])
        if row["kept"]:
            state["sha"].update((("\n" if state["any"] else "") + row["piece"]).encode())
            state["any"] = True
        return state, []

    def counted(state, row):
        if row is None:
            return None, [state]
        if state is None:
            return {"conv_id": row["conv_id"], "truncated": row["late"], "illegal": row["wrong"], "final": row["final"]}, []
        wrong = row["wrong"] + int(crossing(np.array([state["final"], row["first"]]))[0])
        return state | {"truncated": state["truncated"] + row["late"], "illegal": state["illegal"] + wrong, "final": row["final"]}, []

    order = ("conv_id", F.asc_nulls_first("turn"), "role", "text", "id")
    dealt = rows.withColumn("id", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order)
    cuts = tables.stored(dealt.mapInArrow(cut, f"conv_id {kind}, turn long, role string, text string, seg long, pos int"), "turns-rows")
    place, name = F.struct("seg", "pos"), F.sha2("text", 256)
    firsts = cuts.groupBy("conv_id", "role", name.alias("name")).agg(F.min(place).alias("first"), F.count("*").alias("k")).filter("k > 1").selectExpr("conv_id as c", "role as r", "name", "first")
    trimmed = F.rtrim(F.translate("text", SPACE[1:], " " * (len(SPACE) - 1)))
    blank, again = trimmed == "", F.coalesce(place > F.col("first"), F.lit(False))
    code = F.substring("role", 1, 1)
    code = F.when(code == "s", 0).when(code == "u", 1).when(code == "a", 2).otherwise(3)
    marked = cuts.join(firsts, cuts.conv_id.eqNullSafe(F.col("c")) & (cuts.role == F.col("r")) & (name == F.col("name")), "left")
    row = F.struct("pos", code.alias("role"), (blank | again).alias("must"), (~blank & ~again & ~trimmed.rlike(r"[.!?]\z")).alias("late"))
    slim = tables.stored(marked.groupBy("conv_id", "seg").agg(F.sort_array(F.collect_list(row)).alias("rows"), F.sum(blank.cast("long")).alias("blank"), F.sum((again & ~blank).cast("long")).alias("duplicate")), "turns-slim")
    cost = tables.stored(slim.select("conv_id", "seg", "rows").mapInArrow(matrices, f"conv_id {kind}, seg long, m array<long>, first long, final long, late long, wrong long"), "turns-cost")
    after = tables.stored(folded(cost, kind, "seg long, after array<long>, last boolean, cost long", behind, rising=False), "turns-after")
    both = slim.select("conv_id", "seg", "rows").join(after, "seg")
    to = both.mapInArrow(leads, f"conv_id {kind}, seg long, to array<int>")
    states = tables.stored(folded(to, kind, "seg long, state int", ahead), "turns-state")
    texts = cuts.groupBy("seg").agg(F.sort_array(F.collect_list(F.struct("pos", "role", "text"))).alias("texts"))
    done = both.join(states, "seg").join(texts, "seg").mapInArrow(written, f"conv_id {kind}, seg long, cost long, audit string, kept long, piece string")
    ends = folded(done, kind, f"conv_id {kind}, cost long, audit string, repaired_sha256 string", ended)
    kinds = folded(cost, kind, f"conv_id {kind}, truncated long, illegal long", counted)
    sums = slim.groupBy("conv_id").agg(F.sum("blank").alias("blank"), F.sum("duplicate").alias("duplicate"))
    gaps = cuts.groupBy("conv_id").agg(F.coalesce(F.max("turn") - F.min("turn") + 1 - F.countDistinct("turn"), F.lit(0)).alias("gaps"))
    out = ends
    for k, part in enumerate((kinds, sums, gaps)):
        part = part.withColumnRenamed("conv_id", f"c{k}")
        out = out.join(part, out.conv_id.eqNullSafe(part[f"c{k}"])).drop(f"c{k}")
    return out.select("conv_id", *(x.split()[0] for x in COUNTS.split(", ")), "audit", "repaired_sha256")


def repair(rows: DataFrame, *, long_rows: int = 20_000, long_chars: int = 64 << 20, seg_rows: int = 2048, seg_chars: int = 256 << 10) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit and repaired_sha256 of each conversation.

    rows: conv_id, turn, role, text and, if wanted, here: false for a row that is gone but whose conversation still is reported.
    """
    tables.small_batches(rows.sparkSession, 500)
    here = F.coalesce(F.col("here"), F.lit(True)) if "here" in rows.columns else F.lit(True)
    clean = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit(" ")).alias("text"), here.alias("here"))
    kind = clean.schema["conv_id"].dataType.simpleString()
    sizes = clean.filter("here").groupBy(F.col("conv_id").alias("c")).agg(F.count("*").alias("k"), F.sum(F.length("text")).alias("chars"))
    large = tables.stored(sizes.filter((F.col("k") > long_rows) | (F.col("chars") > long_chars)).select("c"), "turns-long")
    if not large.limit(1).count():
        return short(clean, kind)
    same = clean.conv_id.eqNullSafe(F.col("c"))
    return short(clean.join(large, same, "left_anti"), kind).unionByName(long(clean.filter("here").join(large, same, "left_semi").drop("here"), kind, seg_rows, seg_chars))


def damaged(convs: DataFrame) -> DataFrame:
    """Rows of conversations with known faults by crc32(`conv_id:turn`) % 20: 0 gone, 1 emptied, 2 without marks, 3 twice, 4 as user."""
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    k = F.crc32(F.concat(shown("conv_id"), F.lit(":"), shown("turn")).cast("binary")) % 20
    text = F.when(k == 1, "").when(k == 2, F.translate(shown("text"), ".!?", "")).otherwise(shown("text"))
    once = F.array(F.lit(1))
    return convs.select("conv_id", "turn", F.when(k == 4, "user").otherwise(shown("role")).alias("role"), text.alias("text"), (k != 0).alias("here"), F.explode(F.when(k == 3, F.array(F.lit(1), F.lit(1))).otherwise(once)).alias("copy")).drop("copy")
