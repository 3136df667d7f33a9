"""Structure repair of conversations by rank-compressed dynamic programming (operator 11).

A repair is a string of edits: for each turn a run of inserts and then one edit of the turn itself (a macro edit: I*X), and
inserts at the end. Macro edits are prefix-free, so of two strings of as many macros the first that differs decides, and
codes numbered in the order of their strings compare as the strings do. A layer (turn) therefore keeps no strings: for
each of the four states of the grammar ``(s?(ua)+)?`` its cost, the rank of its best string among the layer's states, and
a pointer (state before, code). Strings come back from the pointers at the end.

Layers are worked on in segments of up to ``SEGMENT`` turns, for each of the four states that a segment may begin in, many
segments at once. A conversation's segments are then joined in order, again by cost and rank, which gives each segment
its states of entry and exit, and every segment writes out its own edits. So a conversation of any length is spread over
tasks; one task sees its segments' 4 x 4 costs, and later its rows one after another for the hash, which has no other
way, holding no more than the counts and the audit that is the result.

More than one insert before a turn is never cheapest: two bring no state that is better than the one before them (a kept
system turn is cheaper deleted than completed by two).

Rows: null role and text are one space, and so are null conv_id and turn within the key of the damage; null turns come
first. Rows of null conv_id are one conversation. Rows that share a turn are in order of a hash of role and text as
given, so a repeated row and the copy that the damage makes are neighbours. Long texts are streamed. Equal costs: the
least audit in ASCII. Columns other than conv_id, turn, role and text play no part. Empty tables give no rows.
"""

from __future__ import annotations

import hashlib
import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batch, materialize
from .turns import CRC_SQL, crc_sql, ordered

SEGMENT = 64
SPACES = " \t\n\x0b\x0c\r"
START, S, U, A = range(4)
INITIALS = "sua"
CODES = sorted(run + edit for run in ("", "I") for edit in "DKR")
#: state after a user or assistant turn that the grammar allows in a state: users after all but a user
NEXT = (U, U, A, U)
ROLES = {U: "user", A: "assistant"}
COST = {"K": 0, "R": 1, "D": 2, "I": 5}
TRUNCATED = 5
#: inserts that end a conversation in a state, in number
LAST = (0, 2, 1, 0)
NONE, BLANK, DUPLICATE, CUT = range(4)
INF = 1 << 40
_BITS = 8  # more than the codes


def _steps() -> np.ndarray:
    """[class of a turn, state after, state before, code]: the cost of a macro edit. A class is 3 * initial + (sound,
    truncated, to be deleted)."""
    out = np.full((12, 4, 4, len(CODES)), INF, np.int64)
    for initial, how, before, (j, code) in itertools.product(range(4), range(3), range(4), enumerate(CODES)):
        at = NEXT[before] if len(code) == 2 else before
        cost, edit = COST["I"] * (len(code) - 1) + COST[code[-1]], code[-1]
        if edit == "D":
            after = at
        elif how == 2:
            continue
        else:
            cost += TRUNCATED * (how == 1)
            if edit == "R":
                after = NEXT[at]
            elif initial == 0 and at == START:
                after = S
            elif initial in (1, 2) and NEXT[at] == (U, A)[initial - 1]:
                after = NEXT[at]
            else:
                continue
        out[3 * initial + how, after, before, j] = cost
    return out


STEPS = _steps()
SEGMENTS = "conv_id long, first long, ords array<long>, cost array<long>, rank array<int>, pointers binary"
_SEGMENTS = pa.schema([("conv_id", pa.int64()), ("first", pa.int64()), ("ords", pa.list_(pa.int64())), ("cost", pa.list_(pa.int64())), ("rank", pa.list_(pa.int32())), ("pointers", pa.binary())])
_PATHS = pa.schema([("first", pa.int64()), ("entry", pa.int32()), ("exit", pa.int32()), ("last", pa.bool_())])
_EDITS = pa.schema([("ord", pa.int64()), ("before", pa.int32()), ("code", pa.int32()), ("tail", pa.int32())])
REPAIRED = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
_REPAIRED = pa.schema([("conv_id", pa.int64()), *((c, pa.int64()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), ("audit", pa.string()), ("repaired_sha256", pa.string())])


def layers(classes: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(cost, rank, pointers) of segments of turns: cost and rank [segment, state at its begin, state at its end], and for
    each layer of the longest ones pointers [segment, state at begin, state after], in the order given (longest first)."""
    m = len(starts)
    cost, rank, pointers = np.full((m, 4, 4), INF, np.int64), np.zeros((m, 4, 4), np.int64), []
    cost[:, range(4), range(4)] = 0
    codes = np.arange(len(CODES))
    for t in range(int(lengths[0]) if m else 0):
        n = int(np.searchsorted(-lengths, -t, side="left"))  # those that are longer than t
        step = STEPS[classes[starts[:n] + t]]
        string = rank[:n, :, None, :, None] * _BITS + codes
        value = (cost[:n, :, None, :, None] + step[:, None]) * (4 * _BITS) + string
        value = value.reshape(n, 4, 4, -1)
        best = value.argmin(axis=3)
        value = np.take_along_axis(value, best[..., None], 3)[..., 0]
        cost[:n] = np.minimum(value // (4 * _BITS), INF)
        rank[:n] = (value % (4 * _BITS)).argsort(axis=2).argsort(axis=2)
        pointers.append(best.astype(np.uint8))
    return cost, rank, pointers


def _segments(batches):
    """Rows (conv_id, ord, class) in order, as segments with their costs, ranks and pointers."""
    for rows in batches:
        convs, ords, classes = rows.column(0).to_pylist(), rows.column(1).to_pylist(), rows.column(2).to_numpy()
        cuts = [0]
        for i in range(1, len(convs) + 1):
            if i == len(convs) or convs[i] != convs[i - 1] or i - cuts[-1] == SEGMENT:
                cuts.append(i)
        if len(cuts) == 1:
            continue
        starts, ends = np.array(cuts[:-1]), np.array(cuts[1:])
        by = np.argsort(starts - ends, kind="stable")
        starts, lengths = starts[by], (ends - starts)[by]
        cost, rank, pointers = layers(classes, starts, lengths)
        own = [b"".join(pointers[t][i].tobytes() for t in range(n)) for i, n in enumerate(lengths)]
        yield batch(
            _SEGMENTS, [convs[i] for i in starts], [ords[i] for i in starts], [ords[i : i + n] for i, n in zip(starts, lengths)],
            list(cost.reshape(-1, 16)), list(rank.reshape(-1, 16).astype(np.int32)), own,
        )


def _joined(segments: list[tuple]) -> list[tuple]:
    """(first, entry, exit, last) of a conversation's segments (first, cost, rank) in order."""
    cost, rank, back = [0, INF, INF, INF], [0] * 4, []
    for _, c, r in segments:
        best = [min((cost[e] + c[4 * e + x], rank[e], r[4 * e + x], e) for e in range(4)) for x in range(4)]
        places = sorted(set(b[1:3] for b in best))
        cost, rank = [min(b[0], INF) for b in best], [places.index(b[1:3]) for b in best]
        back.append([b[3] for b in best])
    at = min(range(4), key=lambda x: (cost[x] + COST["I"] * LAST[x], rank[x]))
    out = []
    for i in range(len(segments) - 1, -1, -1):
        out.append((segments[i][0], back[i][at], at, i == len(segments) - 1))
        at = back[i][at]
    return out


def _paths(batches):
    conv, held, out = None, [], []
    for rows in batches:
        for c, *segment in zip(*(rows.column(i).to_pylist() for i in range(4))):
            if held and c != conv:
                out += _joined(held)
                held = []
            conv = c
            held.append(segment)
        if out:
            yield batch(_PATHS, *zip(*out))
            out = []
    if held:
        yield batch(_PATHS, *zip(*_joined(held)))


def _edits(batches):
    """The edits of each turn of segments whose states of entry and exit are known."""
    for rows in batches:
        out = []
        for ords, pointers, entry, state, last in zip(*(rows.column(i).to_pylist() for i in range(5))):
            tail = LAST[state] if last else 0
            for t in range(len(ords) - 1, -1, -1):
                before, code = divmod(pointers[16 * t + 4 * entry + state], len(CODES))
                out.append((ords[t], before, code, tail))
                state, tail = before, 0
        if out:
            yield batch(_EDITS, *zip(*out))


class _Conversation:
    """What is known of a conversation whose rows come one after another."""

    def __init__(self, conv):
        self.conv, self.counts, self.audit, self.sha, self.lines, self.cost, self.illegal = conv, [0] * 4, [], hashlib.sha256(), 0, 0, 0
        self.before, self.first, self.turn, self.turns = None, None, None, 0

    def line(self, role: str, text: str) -> None:
        self.sha.update((("\n" if self.lines else "") + role + ":" + text).encode())
        self.lines += 1

    def insert(self, state: int) -> int:
        self.line(ROLES[NEXT[state]], "")
        self.cost += COST["I"]
        return NEXT[state]

    def add(self, turn, role, text, fault, before, code, tail) -> None:
        if turn is not None:
            self.first = turn if self.first is None else self.first
            self.turns += turn != self.turn
            self.turn = turn
        self.counts[fault] += 1
        self.illegal += self.before is not None and self.before + role[:1] not in ("su", "ua", "au")
        self.before, edits = role[:1], CODES[code]
        self.audit.append(edits + "I" * tail)
        state = self.insert(before) if len(edits) == 2 else before
        self.cost += COST[edits[-1]] + TRUNCATED * (fault == CUT and edits[-1] != "D")
        if edits[-1] == "K":
            self.line(role, text)
            state = S if role[:1] == "s" else NEXT[state]
        elif edits[-1] == "R":
            self.line(ROLES[NEXT[state]], text)
            state = NEXT[state]
        for _ in range(tail):
            state = self.insert(state)

    def row(self) -> tuple:
        gaps = 0 if self.first is None else self.turn - self.first + 1 - self.turns
        return (self.conv, gaps, *self.counts[1:], self.illegal, self.cost, "".join(self.audit), self.sha.hexdigest())


def _repaired(batches):
    own, out = None, []
    for rows in batches:
        for part in _parts(rows):
            for conv, *row in zip(*(c.to_pylist() for c in part.columns)):
                if own is None or conv != own.conv:
                    if own is not None:
                        out.append(own.row())
                    own = _Conversation(conv)
                own.add(*row)
        if out:
            yield batch(_REPAIRED, *zip(*out))
            out = []
    if own is not None:
        yield batch(_REPAIRED, *zip(*[own.row()]))


def _parts(rows: pa.RecordBatch, most: int = 500):
    for at in range(0, rows.num_rows, most):
        yield rows.slice(at, most)


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, h) of the rows after the damage; h is of role and text before it."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), space("role").alias("role"), space("text").alias("text"))
    key = F.concat(space("conv_id"), F.lit(":"), space("turn"))
    how = F.col("how")
    rows = rows.withColumns({"how": F.crc32(key.cast("binary")) % 20, "h": F.xxhash64("role", "text")}).where(how != 0)
    text = F.when(how == 1, "").when(how == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    rows = rows.select("conv_id", "turn", F.when(how == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), "h", F.when(how == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))).alias("copies"))
    return rows.withColumn("copy", F.explode("copies")).drop("copies", "copy")


def faults(rows: DataFrame) -> DataFrame:
    """(conv_id, ord, initial, fault) of ordered rows."""
    bare = F.rtrim(F.col("text"), F.lit(SPACES))
    initial = F.coalesce(F.nullif(F.instr(F.lit(INITIALS), F.substring("role", 1, 1)), F.lit(0)) - 1, F.lit(3))
    marks = rows.select("conv_id", "ord", F.when(F.col("role") == "", 3).otherwise(initial).alias("initial"), F.substring(bare, -1, 1).alias("last"), F.xxhash64("role", "text").alias("a"), F.xxhash64(F.lit("row"), "text", "role").alias("b"))
    # the first of equal rows, joined by its own number: what is repeated often is one row of the grouping
    firsts = marks.groupBy("conv_id", "a", "b").agg(F.min("ord").alias("ord"), F.lit(True).alias("first")).select("ord", "first")
    last = F.col("last")
    fault = F.when(last == "", BLANK).when(F.col("first").isNull(), DUPLICATE).when(~last.isin(".", "!", "?"), CUT).otherwise(NONE)
    return marks.join(firsts, "ord", "left").select("conv_id", "ord", "initial", fault.alias("fault"))


def turn_class(initial: Column, fault: Column) -> Column:
    return (3 * initial + F.when(fault.isin(BLANK, DUPLICATE), 2).when(fault == CUT, 1).otherwise(0)).cast("long")


def edits(marks: DataFrame) -> DataFrame:
    """(ord, before, code, tail) of the cheapest repair of each conversation of ``marks`` (conv_id, ord, initial, fault)."""
    rows = marks.select("conv_id", "ord", turn_class(F.col("initial"), F.col("fault")).alias("class")).repartitionByRange("ord").sortWithinPartitions("ord")
    segments = materialize(rows.mapInArrow(_segments, SEGMENTS), "repair-segments")
    own = segments.select("conv_id", "first", "cost", "rank").repartition("conv_id").sortWithinPartitions("conv_id", "first")
    paths = own.mapInArrow(_paths, "first long, entry int, exit int, last boolean")
    return segments.join(paths, "first").select("ords", "pointers", "entry", "exit", "last").mapInArrow(_edits, "ord long, before int, code int, tail int")


def repair(rows: DataFrame) -> DataFrame:
    """The faults, cheapest repair and hash of the repaired text of every conversation of (conv_id, turn, role, text, h)."""
    own = ordered(rows, "repair-order", "h")
    marks = materialize(faults(own), "repair-faults")
    both = own.join(marks.select("ord", "fault"), "ord").join(edits(marks), "ord")
    both = both.repartition("conv_id").sortWithinPartitions("conv_id", "ord").select("conv_id", "turn", "role", "text", "fault", "before", "code", "tail")
    return both.mapInArrow(_repaired, REPAIRED)


def op11_structure_repair(conversations: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of every conversation, after the damage."""
    every = conversations.select(F.col("conv_id").cast("long").alias("own")).distinct()
    joined = every.join(repair(damaged(conversations)), F.col("own").eqNullSafe(F.col("conv_id")), "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    nothing = F.lit(hashlib.sha256(b"").hexdigest())
    return joined.select(F.col("own").alias("conv_id"), *map(zero, ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", nothing).alias("repaired_sha256"))


def _sql() -> str:
    """Backward over turns with whole strings: the best repair of what is left, for each state."""
    names, roles = ("z", "s", "u", "a"), ("user", "user", "assistant", "user")
    pack = lambda c, a, t: f"struct_pack(c := {c}, a := {a}, t := {t})"
    line = lambda role, text: f"chr(10) || {role} || ':' || {text}"
    more = f"{TRUNCATED} * (fault = {CUT})::INT"

    def own(p: int) -> str:
        f, n = names[p], names[NEXT[p]]
        keep = f"WHEN g = '{'a' if p == U else 'u'}' THEN {pack(f'{more} + {n}.c', f"'K' || {n}.a", f'{line("role", "text")} || {n}.t')}"
        if p == START:
            keep += f" WHEN g = 's' THEN {pack(f'{more} + s.c', "'K' || s.a", f'{line("role", "text")} || s.t')}"
        again = pack(f"1 + {more} + {n}.c", f"'R' || {n}.a", f"{line(repr(roles[p]), 'text')} || {n}.t")
        return f"list_min([{pack(f'2 + {f}.c', f"'D' || {f}.a", f'{f}.t')}, CASE WHEN fault IN ({BLANK}, {DUPLICATE}) THEN NULL {keep} END, CASE WHEN fault NOT IN ({BLANK}, {DUPLICATE}) THEN {again} END])"

    def with_inserts(p: int) -> str:
        n = NEXT[p]
        one = pack(f"5 + {names[n]}_.c", f"'I' || {names[n]}_.a", f"{line(repr(roles[p]), "''")} || {names[n]}_.t")
        m = NEXT[n]
        two = pack(f"10 + {names[m]}_.c", f"'II' || {names[m]}_.a", f"{line(repr(roles[p]), "''")} || {line(repr(roles[n]), "''")} || {names[m]}_.t")
        return f"list_min([{names[p]}_, {one}, {two}])"

    end = {START: pack("0", "''", "''"), A: pack("0", "''", "''"), U: pack("5", "'I'", line("'assistant'", "''")), S: pack("10", "'II'", f"{line("'user'", "''")} || {line("'assistant'", "''")}")}
    space = "[^\\x20\\x09-\\x0D]"
    return f"""WITH RECURSIVE {CRC_SQL},
k AS (SELECT conv_id, turn, coalesce(role, ' ') AS r0, coalesce(text, ' ') AS t0, {crc_sql("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS how FROM conversations, crc),
d AS (SELECT conv_id, turn, r0, t0, CASE how WHEN 4 THEN 'user' ELSE r0 END AS role, CASE how WHEN 1 THEN '' WHEN 2 THEN translate(t0, '.!?', '') ELSE t0 END AS text, unnest(CASE how WHEN 3 THEN [0, 1] ELSE [0] END) AS copy FROM k WHERE how <> 0),
o AS (SELECT *, left(role, 1) AS g, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, r0, t0, copy) AS i FROM d),
f AS (SELECT *, lag(g) OVER (PARTITION BY conv_id ORDER BY i) || g AS pair, count(*) OVER (PARTITION BY conv_id) AS n,
 CASE WHEN NOT regexp_matches(text, '{space}') THEN {BLANK} WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN {DUPLICATE} WHEN NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*$') THEN {CUT} ELSE {NONE} END AS fault FROM o),
dp AS (SELECT conv_id, n AS i, {', '.join(f'{end[p]} AS {names[p]}' for p in range(4))} FROM (SELECT DISTINCT conv_id, n FROM f)
UNION ALL SELECT conv_id, i - 1, {', '.join(f'{with_inserts(p)} AS {names[p]}' for p in range(4))} FROM (SELECT dp.conv_id, dp.i, {', '.join(f'{own(p)} AS {names[p]}_' for p in range(4))} FROM dp JOIN f ON f.conv_id IS NOT DISTINCT FROM dp.conv_id AND f.i = dp.i)),
s AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = {BLANK}) AS blank, count(*) FILTER (fault = {DUPLICATE}) AS duplicate, count(*) FILTER (fault = {CUT}) AS truncated,
 count(*) FILTER (i > 1 AND pair NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv_id)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(z.c, 0)::BIGINT AS cost, coalesce(z.a, '') AS audit, sha256(coalesce(substr(z.t, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN s ON s.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN dp ON dp.conv_id IS NOT DISTINCT FROM c.conv_id AND dp.i = 0"""


OP11_SQL = _sql()
