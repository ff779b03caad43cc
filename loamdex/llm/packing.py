"""Operator 10: harmonic packing of token ids into sequences of at most CAPACITY.

Class k (2 <= k < CLASSES) has slots of CAPACITY // k ids, and its bins hold exactly k pieces, whatever they are. A document
gives whole sequences, then pieces that fill slots: a rest of r ids gives a piece to the widest slot that it fills, or goes
whole to a slot that it fills but for SLACK of it. Rests narrower than the last slot form the last class, which is filled
by next fit: its pieces stand one after the other and are cut where a sequence ends.

Bins are filled independently: a piece's number in its class is its number in its bucket of pieces plus the counts of
the buckets before, so one row for each bucket and class is all that meets. Pieces that make no whole bin of their class
(fewer than k each) are packed by decreasing length into shared sequences. The last class's last sequence is cut at
powers of two, which need no padding.

Null texts count as empty and are one end id. Repeated rows are packed each; a null doc_id stays null. Columns other than
doc_id and text are not read. An empty table gives no rows.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, small_batches, table
from .tokens import mapped, vocabulary

CAPACITY, END = 4096, 2
#: Classes, and the part of a slot that may stay empty rather than cut a document once more.
CLASSES, SLACK = 16, 1 / 64
#: Pieces of a bucket, in which pieces are numbered independently, about; how many buckets there are at least and at most (a
#: row for each bucket and class is broadcast, 300,000 rows at most).
BUCKET, LEAST, MOST = 200_000, 1024, 16_384


def slots(length: int, capacity: int = CAPACITY, classes: int = CLASSES) -> list[tuple[int, int]]:
    """(class, length) of a document's pieces in order; class 0 is the last class."""
    out = [(1, capacity)] * (length // capacity)
    rest = length % capacity
    while rest:
        fit = next((k for k in range(2, classes) if capacity // k <= rest), 0)
        wider = (fit or classes) - 1
        if capacity // wider * (1 - SLACK) <= rest and rest <= capacity // wider:
            return [*out, (wider, rest)]
        if not fit:
            return [*out, (0, rest)]
        out.append((fit, capacity // fit))
        rest -= capacity // fit
    return out


def pack(docs: DataFrame, path: str, end: int = END, capacity: int = CAPACITY, classes: int = CLASSES) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset of each piece, and its class."""
    spark = docs.sparkSession
    small_batches(spark)
    kind = dict(docs.dtypes)["doc_id"]
    tail = struct.pack("<I", end)

    def cut(doc_ids: pa.Array, texts: Iterator[bytes]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for k, ids in enumerate(texts):
            ids += tail
            n, at = len(ids) // 4, 0
            for c, length in slots(n, capacity, classes):
                part = ids[4 * at : 4 * (at + length)]
                rows.append((k, at, length, zlib.crc32(part), n, c, part if c == 0 else None))
                at += length
        k, *rest = zip(*rows, strict=True) if rows else [()] * 7
        yield pa.RecordBatch.from_arrays([doc_ids.take(pa.array(k, pa.int64())), *(pa.array(x, t) for x, t in zip(rest, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()), strict=True))], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "class", "ids"])

    pieces = docs.select("doc_id", "text").mapInArrow(mapped(cut, path), f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, class int, ids binary")
    # dealt by a written number of each piece, so that no id, however often it stands there, fills a bucket
    pieces = materialize(pieces.withColumn("piece", F.monotonically_increasing_id()))
    buckets = min(MOST, max(LEAST, pieces.count() // BUCKET))
    pieces = pieces.withColumn("bucket", F.pmod(F.xxhash64("piece"), F.lit(buckets)).cast("int"))

    # how many pieces, and in the last class how many ids, the buckets before hold: at most MOST x CLASSES rows
    size = F.when(F.col("class") == 0, F.col("length")).otherwise(1)
    sums = pieces.groupBy("class", "bucket").agg(F.sum(size).alias("n"))
    sums = sums.withColumn("before", F.sum("n").over(Window.partitionBy("class").orderBy("bucket")) - F.col("n")).withColumn("all", F.sum("n").over(Window.partitionBy("class")))
    upto = Window.partitionBy("class", "bucket").orderBy("piece").rowsBetween(Window.unboundedPreceding, 0)
    placed = pieces.withColumn("nth", F.sum(size).over(upto) - size).join(F.broadcast(sums.drop("n")), ["class", "bucket"]).withColumn("nth", F.col("nth") + F.col("before")).drop("before", "bucket", "piece")

    # sequence_id: a sequence's number in its class, then the class; the shared ones have class `classes`
    seq = lambda number, c: number * (classes + 1) + c
    whole = (F.col("class") > 0) & (F.col("nth") < F.col("all") - F.col("all") % F.col("class"))
    bins = placed.where(whole).withColumn("bin", F.floor(F.col("nth") / F.col("class")))
    over = Window.partitionBy("class", "bin").orderBy("nth").rowsBetween(Window.unboundedPreceding, 0)
    bins = bins.withColumn("offset", F.sum("length").over(over) - F.col("length")).withColumn("sequence_id", seq(F.col("bin"), F.col("class")))

    def share(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("length", "descending"), ("class", "ascending"), ("nth", "ascending")])
        room: list[int] = []
        where, at = [], []
        for n in rows["length"].to_pylist():
            b = next((i for i, left in enumerate(room) if left >= n), len(room))
            if b == len(room):
                room.append(capacity)
            where.append(b * (classes + 1) + classes)
            at.append(capacity - room[b])
            room[b] -= n
        return rows.select(names[:6]).append_column("sequence_id", pa.array(where, pa.int64())).append_column("offset", pa.array(at, pa.int64()))

    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "class", "sequence_id", "offset"]
    schema = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, class int, sequence_id long, offset long"
    # fewer than k pieces of each class k: at most CLASSES ** 2 / 2 rows
    left = placed.where((F.col("class") > 0) & ~whole).drop("ids").withColumn("one", F.lit(0)).groupBy("one").applyInArrow(share, schema)

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for r in b.to_pylist():
                at, end_at = r["nth"], r["nth"] + r["length"]
                last = r["all"] // capacity * capacity
                while at < end_at:
                    if at < last:
                        first, stop = at // capacity * capacity, (at // capacity + 1) * capacity
                        number = first // capacity
                    else:  # the last sequence, cut at powers of two
                        first, number, rest = last, last // capacity, r["all"] - last
                        while True:
                            width = 1 << (rest.bit_length() - 1)
                            if at < first + width:
                                break
                            first, number, rest = first + width, number + 1, rest - width
                        stop = first + width
                    stop = min(stop, end_at)
                    i, j = at - r["nth"], stop - r["nth"]
                    out.append((r["doc_id"], r["start"] + i, j - i, zlib.crc32(r["ids"][4 * i : 4 * j]), r["doc_tokens"], 0, number * (classes + 1), at - first))
                    at = stop
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True) if out else [()] * 8, (b.schema.field("doc_id").type, pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64()), strict=True)], names)

    last = placed.where(F.col("class") == 0).select("doc_id", "start", "length", "doc_tokens", "nth", "all", "ids").mapInArrow(chain, schema)
    return bins.select(names).unionByName(left).unionByName(last)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), vocabulary())
