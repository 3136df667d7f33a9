"""Turns of conversations in order, for the operators on conversations.

A conversation's turns are in the order of turn (null first); where several share a turn, by a hash of role and text, so
rows that are equal are neighbours. A conversation may hold any share of all rows: the order is a range sort over unique
keys, which cuts it like any other, and places within it come from the partitions' own and one offset for each partition.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import batch, materialize

#: crc32 of short ASCII strings for another engine: a table of 256 entries from the polynomial, and a fold over characters
CRC_SQL = """bits(i, v, k) AS (SELECT i, i, 0 FROM range(256) r(i) UNION ALL SELECT i, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384::BIGINT) ELSE v >> 1 END, k + 1 FROM bits WHERE k < 8),
crc AS (SELECT list(v ORDER BY i) AS t FROM bits WHERE k = 8)"""


def crc_sql(text: str) -> str:
    """crc32 of a string, where ``crc`` is joined."""
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({text}, ''), lambda x: ascii(x)::BIGINT)), lambda c, x: xor(c >> 8, t[((xor(c, x)) & 255) + 1])), 4294967295::BIGINT)"


def ordered(rows: DataFrame, name: str, *more: str) -> DataFrame:
    """(..., ord): the rows by conv_id, turn (null first), ``more``, as a written table; ord grows in that order, by one within
    a partition, whose number is ord >> 33."""
    keys = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), *map(F.col, more), F.col("__row")]
    rows = rows.withColumn("__row", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys).drop("__row")
    return materialize(rows.withColumn("ord", F.monotonically_increasing_id()), name)


def placed(rows: DataFrame) -> DataFrame:
    """(..., k): the place from 0 of each row of ``ordered`` within its conversation."""
    rows = rows.withColumn("part", F.shiftright("ord", 33))
    # at most one conversation of a partition begins in an earlier one, so there are no more offsets than partitions
    counts = rows.groupBy("conv_id", "part").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    begun = counts.withColumn("start", before).where("start is not null").select("conv_id", "part", "start")
    own = F.row_number().over(Window.partitionBy("conv_id", "part").orderBy("ord"))
    return rows.withColumn("own", own).join(F.broadcast(begun), ["conv_id", "part"], "left").withColumn("k", F.coalesce("start", F.lit(0)) + F.col("own") - 1).drop("part", "own", "start")


_PIECES = pa.schema([("rep", pa.int64()), ("first", pa.int64()), ("piece", pa.string())])
_DIGESTS = pa.schema([("rep", pa.int64()), ("ends_sha256", pa.string())])


def _pieces(batches):
    """Ids of the same group, in order, as comma-joined pieces of at most one batch."""
    for rows in batches:
        reps, ids, at = rows.column(0).to_pylist(), rows.column(1).to_pylist(), 0
        out: tuple[list, list, list] = ([], [], [])
        for i in range(1, len(reps) + 1):
            if i == len(reps) or reps[i] != reps[at]:
                for column, x in zip(out, (reps[at], ids[at], ",".join(map(str, ids[at:i])))):
                    column.append(x)
                at = i
        yield batch(_PIECES, *out)


def _digests(batches):
    """The hash of each group's pieces, which come in order: a group is never held, only the hash so far."""
    rep, state = None, None
    for rows in batches:
        out: tuple[list, list] = ([], [])
        for r, piece in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist()):
            if state is not None and r == rep:
                state.update(b"," + piece.encode())
                continue
            if state is not None:
                out[0].append(rep)
                out[1].append(state.hexdigest())
            rep, state = r, hashlib.sha256(piece.encode())
        yield batch(_DIGESTS, *out)
    if state is not None:
        yield batch(_DIGESTS, [rep], [state.hexdigest()])


def id_digests(members: DataFrame) -> DataFrame:
    """(rep, ends_sha256) of (rep, conv_id): the hash of each group's decimal ids, ascending and comma-joined. Range-sorted
    pieces of ids first, so that what a large group's one task has left is a row for thousands of ids."""
    pieces = members.repartitionByRange("rep", "conv_id").sortWithinPartitions("rep", "conv_id").select("rep", "conv_id").mapInArrow(_pieces, "rep long, first long, piece string")
    return pieces.repartition("rep").sortWithinPartitions("rep", "first").select("rep", "piece").mapInArrow(_digests, "rep long, ends_sha256 string")
