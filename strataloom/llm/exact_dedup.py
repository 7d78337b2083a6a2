"""Exact dedup by two passes over Bloom filters, in DataFrame operations only.

The texts' hashes are written once, as a table of 48 bytes a row. Pass one deals them by range into as many filters as keep
each within MOST_BITS, and sets two bits a row in the filter of its range: only the bits that two or more rows asked for are
kept, as bitmaps of 4 KB, and only rows that have both are grouped, by their SHA-256. Pass two sets the bits of the texts that
do occur again; a row that has not both goes straight through, and only the others shuffle. A false positive costs a shuffled
row, never a wrong answer.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Tables

BITS_PER_ROW = 16
MOST_BITS = 1 << 28  # 32 MB: what is broadcast at once never exceeds this, whatever the input
PER_BITMAP = 32768


def filter_bits(rows: int, most: int = MOST_BITS) -> int:
    """A power of two of about BITS_PER_ROW bits a row, from one bitmap up to the bound."""
    return max(PER_BITMAP, min(most, 1 << max(0, rows * BITS_PER_ROW - 1).bit_length()))


def ranges(rows: int, most: int = MOST_BITS) -> int:
    """The filters of pass one."""
    return -(-rows * BITS_PER_ROW // max(PER_BITMAP, most)) or 1


def _bits(h: str, size: int) -> list[Column]:
    return [F.pmod(F.col(h), F.lit(size)), F.pmod(F.shiftrightunsigned(h, 31), F.lit(size))]


def _bitmaps(bits: DataFrame) -> DataFrame:
    """(bucket, map) of bits(bit): at most MOST_BITS / 8 bytes, bounded by filter_bits and not by the data."""
    return bits.groupBy(F.floor(F.col("bit") / PER_BITMAP).alias("bucket")).agg(F.bitmap_construct_agg(F.col("bit") % PER_BITMAP).alias("map"))


def _has(map_: Column, bit: Column) -> Column:
    """Whether a bitmap, null if there is none, has a bit (the lowest bit of the first byte is bit 0)."""
    at = bit % PER_BITMAP
    byte = F.conv(F.hex(F.substring(map_, F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.coalesce(F.getbit(byte, (at % 8).cast("int")) == 1, F.lit(False))


def with_maybe(rows: DataFrame, maps: DataFrame, size: int) -> DataFrame:
    """rows(_h, ...) with _maybe: whether the bitmaps have both bits of _h."""
    out = rows
    for i, bit in enumerate(_bits("_h", size)):
        found = maps.select(F.col("bucket").alias(f"_k{i}"), F.col("map").alias(f"_m{i}"))
        out = out.withColumns({f"_b{i}": bit, f"_k{i}": F.floor(bit / PER_BITMAP)}).join(F.broadcast(found), f"_k{i}", "left")
    return out.select(*rows.columns, (_has(F.col("_m0"), F.col("_b0")) & _has(F.col("_m1"), F.col("_b1"))).alias("_maybe"))


def possible_copies(hashes: DataFrame, rows: int, most: int = MOST_BITS) -> DataFrame:
    """hashes(_h, ...) with _maybe, which is false only for those of which there is one: both of its bits were asked for twice."""
    size = filter_bits(rows, most)
    asked = hashes.select(F.explode(F.array_distinct(F.array(*_bits("_h", size)))).alias("bit"))
    return with_maybe(hashes, _bitmaps(asked.groupBy("bit").count().where("count > 1")), size)


def _hashes(text: Column) -> dict[str, Column]:
    text = F.coalesce(text, F.lit(""))
    return {"_sha": F.unhex(F.sha2(text, 256)), "_h": F.xxhash64(text)}


def repeated_texts(hashes: DataFrame, tables: Tables, rows: int, most: int = MOST_BITS) -> DataFrame:
    """(_sha, _h, keep_id, group_size) of every text of hashes(doc_id, _sha, _h) that occurs more than once."""
    many = ranges(rows, most)
    if many > 1:
        # one file a range, so that each pass reads its own rows only
        hashes = hashes.withColumn("_range", F.pmod(F.xxhash64("_h"), F.lit(many)))
        hashes = tables.write(hashes.repartition("_range"), "ranges", "_range")
    found = []
    for i in range(many):
        own = hashes.where(F.col("_range") == i) if many > 1 else hashes
        maybe = possible_copies(own, -(-rows // many), most).where("_maybe")
        groups = maybe.groupBy("_sha").agg(F.first("_h").alias("_h"), F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        found.append(tables.write(groups.where("group_size > 1"), "repeated"))
    return functools.reduce(DataFrame.unionByName, found)


def _with_groups(rows: DataFrame, groups: DataFrame, many: int, most: int) -> tuple[DataFrame, DataFrame]:
    """rows(_h, _sha, ...) in two parts: those that have no copy for sure, and the others with keep_id and group_size, null for
    rows that have none after all. The groups are a written table, so that adaptive execution may split those of a large one."""
    size = filter_bits(many, most)
    bits = groups.select(F.explode(F.array(*_bits("_h", size))).alias("bit"))
    marked = with_maybe(rows, _bitmaps(bits), size)
    return marked.where(~F.col("_maybe")).drop("_maybe"), marked.where("_maybe").drop("_maybe").join(groups.drop("_h"), "_sha", "left")


def _read(docs: DataFrame, tables: Tables, most: int) -> tuple[DataFrame, DataFrame, int]:
    hashes = tables.write(docs.select(F.col("doc_id").cast("long").alias("doc_id"), *[c.alias(k) for k, c in _hashes(F.col("text")).items()]), "hashes")
    groups = repeated_texts(hashes, tables, hashes.count(), most)
    return hashes, groups, groups.count()


def exact_copies(docs: DataFrame, most_bits: int = MOST_BITS) -> DataFrame:
    """For every row of docs(doc_id, text, ...): doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after no change; of equal texts the row with the largest doc_id stays. A null text counts
    as the empty one, and so equals it. Rows that repeat a doc_id with the same text count in group_size and all carry the
    same kept; of equal texts without any doc_id all have a null keep_id and kept is false. Very long texts are hashed whole;
    an empty table gives an empty result; other columns are ignored.
    """
    hashes, groups, many = _read(docs, Tables(docs.sparkSession, "exact"), most_bits)
    alone, maybe = _with_groups(hashes, groups, many, most_bits)
    size = F.coalesce("group_size", F.lit(1).cast("long"))
    keep = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    rows = alone.withColumns({"keep_id": F.col("doc_id"), "group_size": F.lit(1).cast("long")}).unionByName(maybe.withColumns({"keep_id": keep, "group_size": size}))
    kept = F.coalesce(F.col("doc_id") == F.col("keep_id"), F.lit(False))
    return rows.select("doc_id", "keep_id", "group_size", kept.alias("kept"), F.lower(F.hex("_sha")).alias("text_sha256"))


def drop_copies(docs: DataFrame, most_bits: int = MOST_BITS) -> DataFrame:
    """The rows of docs that stay, with all their columns; of rows with one doc_id and one text, one stays.

    Of equal texts the row with the largest doc_id stays; a row without a doc_id stays where no row with one has its text, one
    of each text. A null text equals the empty one; an empty table gives an empty result. Texts that occur once never shuffle.
    """
    _, groups, many = _read(docs, Tables(docs.sparkSession, "exact"), most_bits)
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), *[c.alias(k) for k, c in _hashes(F.col("text")).items()])
    alone, maybe = _with_groups(rows, groups, many, most_bits)
    once = maybe.where("group_size IS NULL")
    last = maybe.where(F.col("group_size").isNotNull() & F.col("doc_id").eqNullSafe(F.col("keep_id"))).dropDuplicates(["_sha"])
    return alone.select("row.*").unionByName(once.select("row.*")).unionByName(last.select("row.*"))


ORACLE = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, text_sha256
FROM (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256 FROM documents)
WINDOW w AS (PARTITION BY text_sha256)
"""
