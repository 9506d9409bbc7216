"""Sharding by histogram sort: shards of nearly equal bytes, found without sorting first.

A row's key is 32 hexadecimal digits: a hash of its text, then one of its id. Equal texts are thus
neighbours. The splitters between shards are found by counting: in each round, candidate boundaries
subdivide the one interval in which a splitter must lie, and the exact bytes below every candidate are
counted over all partitions; a splitter is settled once it is within the tolerance of its mark. Then the
rows are dealt out once. A group of equal texts that is larger than the tolerance is split at an id.

Only counts by boundary reach the driver: at most ``shards`` x 16 ** DIGITS a round.

Slots follow the key, so that a shard comes out sorted. The rows are numbered in parts, ranges of keys with nearly equal numbers of rows, whose
boundaries are found in the same way; a group of equal texts is spread over as many parts as it fills.

Defined results: a null text has size 1 and checksum 0; rows that agree in id and text have one key and
go to one shard, their slots in any order; an empty table gives no rows; texts of any length count whole; columns that the caller brings stay,
those named shard and slot are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, Window as W

from quillspark.llm.common import cut, small

#: Hexadecimal digits by which a round refines a boundary.
DIGITS = 3
#: Bytes that a splitter may be off, as a share of a shard.
TOLERANCE = 0.002
#: Rows are numbered in as many parts at once as have so many rows each, 16 at least and MOST_PARTS at most.
ROWS_IN_PART, MOST_PARTS = 50_000, 4_096


def sort_key(text: Column, id_col: Column) -> Column:
    """The text's hash, then the row's, each as 16 digits."""
    h = F.xxhash64(F.coalesce(text, F.lit("")), text.isNull())
    return F.concat(F.lpad(F.hex(h), 16, "0"), F.lpad(F.hex(F.xxhash64(id_col, h)), 16, "0"))


def splitters(rows: DataFrame, shards: int, tolerance: float = TOLERANCE) -> list[str]:
    """Boundaries (a key belongs to the number of boundaries that are not above it), from (key, size)."""
    total = rows.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("n")).first()["n"]
    slack = tolerance * total / shards
    marks = {i: total * i / shards for i in range(1, shards)}
    found: dict[int, str] = {}
    at = {i: ("", 0) for i in marks}  # prefix in which the splitter lies, exact bytes below the prefix
    for length in range(DIGITS, 32 + 2 * DIGITS, DIGITS):
        if not at or not total:
            break
        prefixes = sorted({p for p, _ in at.values()})
        near = rows if prefixes == [""] else rows.where(F.substring("key", 1, length - DIGITS).isin(prefixes))
        counts = near.groupBy(F.substring("key", 1, length).alias("p")).agg(F.sum("size").alias("n")).collect()
        below: dict[str, list[tuple[str, int]]] = {}
        for r in sorted(counts, key=lambda r: r["p"]):
            below.setdefault(r["p"][: length - DIGITS], []).append((r["p"], r["n"]))
        for i, (prefix, base) in list(at.items()):
            for p, n in below[prefix]:
                # Boundaries at both ends of the interval [base, base + n) of keys that start with p.
                if base + n >= marks[i]:
                    if marks[i] - base <= slack and marks[i] - base <= base + n - marks[i] or len(p) >= 32:
                        found[i] = p
                    elif base + n - marks[i] <= slack:
                        found[i] = p + "g"  # above every key that starts with p
                    else:
                        at[i] = (p, base)
                        break
                    del at[i]
                    break
                base += n
    return [found[i] for i in sorted(found)]


def shard_of(key: Column, bounds: list[str]) -> Column:
    """The number of bounds, in order, that are not above the key: a tree of comparisons."""

    def search(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(key < F.lit(bounds[mid]), search(lo, mid)).otherwise(search(mid + 1, hi))

    return search(0, len(bounds)).cast("int")


def assign(rows: DataFrame, shards: int = 8, tolerance: float = TOLERANCE) -> DataFrame:
    """Add shard and slot to (key, size, ...). The slots of a shard run from 0 without a gap, in the order of the keys."""
    rows = cut(rows.drop("shard", "slot"))
    bounds = splitters(rows, shards, tolerance)
    parts = min(MOST_PARTS, max(16, rows.count() // ROWS_IN_PART + 1))
    between = splitters(rows.select("key", F.lit(1).alias("size")), parts, 0.5)
    every = sorted({*bounds, *between})
    first_part = {i: every.index(b) + 1 for i, b in enumerate(bounds, 1)}
    made = f"__{max(map(len, rows.columns))}"  # begins no other column's name
    part, before = f"{made}_part", f"{made}_before"
    dealt = rows.withColumn(part, shard_of(F.col("key"), every))
    # Parts that begin a shard say which one it is.
    shard = F.lit(0)
    for i, at in first_part.items():
        shard = F.when(F.col(part) >= at, F.lit(i)).otherwise(shard)
    counts = cut(dealt.groupBy(part).agg(F.count("*").alias("n")).withColumn("shard", shard.cast("int")))
    first = F.sum("n").over(W.partitionBy("shard").orderBy(part)) - F.col("n")
    placed = dealt.withColumn("slot", F.row_number().over(W.partitionBy(part).orderBy("key")) - 1)
    placed = placed.join(small(counts.select(part, "shard", first.alias(before))), part)
    return placed.withColumn("slot", F.col("slot") + F.col(before)).drop(before, part)


def digest(documents: DataFrame, shards: int = 8) -> DataFrame:
    text = F.col("text")
    rows = documents.select(
        "doc_id",
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("bigint").alias("size"),
        F.crc32(F.coalesce(text, F.lit(""))).cast("bigint").alias("text_crc32"),
        sort_key(text, F.col("doc_id")).alias("key"),
    )
    return assign(rows, shards).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
