"""Has this key been seen before? A Golomb-coded set of reduced key hashes.

Building. Every key is hashed to 64 bits and reduced to a target range of about ``keys * 2**fp_bits``
values, cut into blocks of equal width. A block is one row: its sorted reduced values as Golomb-Rice
coded gaps, each value stored once, or twice (a zero gap) where more than one arrival has it. A block
takes about ``fp_bits + 1.5`` bits a key instead of the key itself, so billions of earlier keys
fit in a few GB spread over the executors, and no task ever holds more than one block's values.

Probing. Distinct reduced values meet their block in a co-grouped join; only blocks that are probed
are decoded. A value stored twice may have been seen; a value stored once is certainly new. The few
that may have been seen are then settled by their whole keys, which gives the audited rate of wrong
answers beside the theoretical one.

Hot keys. A key on a third of all rows is one reduced value with a capped count after partial
aggregation, so no block grows with it; the rows themselves are joined to the one answer for their value.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumencase.staging import cut, small_enough

#: Fixed value: the MD5 of empty content.
EMPTY_MD5 = "d41d8cd98f00b204e9800998ecf8427e"
#: Expected values in a block.
BLOCK_KEYS = 4096


def md5_key(column: Column | str) -> Column:
    """The usable MD5 in a column: 32 hex digits as its 16 bytes, white space and byte-order marks ignored, else null."""
    text = F.lower(F.regexp_replace(F.col(column) if isinstance(column, str) else column, r"^[\s\p{Z}\x{FEFF}]+|[\s\p{Z}\x{FEFF}]+$|\x{FEFF}", ""))
    return F.when(text.rlike("^[0-9a-f]{32}$") & (text != EMPTY_MD5), F.unhex(text))


def golomb_encode(values: np.ndarray, k: int) -> bytes:
    """Golomb-Rice code of the gaps of sorted non-negative integers.

    The unary quotients and the k low bits stand in two streams, so both are read without a loop;
    a head of four bytes tells where the second begins.
    """
    gaps = np.diff(values, prepend=0).astype(np.int64)
    quotient = gaps >> k
    unary = np.ones(int(quotient.sum()) + len(gaps), dtype=np.uint8)
    unary[np.cumsum(quotient + 1) - 1] = 0
    low = ((gaps[:, None] >> np.arange(k - 1, -1, -1)[None, :]) & 1).astype(np.uint8)
    first = np.packbits(unary).tobytes()
    return len(first).to_bytes(4, "big") + first + np.packbits(low.ravel()).tobytes()


def golomb_decode(code: bytes, n: int, k: int) -> np.ndarray:
    """The n sorted integers that ``golomb_encode`` coded."""
    cut_at = 4 + int.from_bytes(code[:4], "big")
    ends = np.flatnonzero(np.unpackbits(np.frombuffer(code[4:cut_at], dtype=np.uint8)) == 0)[:n]
    quotient = np.diff(ends, prepend=-1) - 1
    low = np.unpackbits(np.frombuffer(code[cut_at:], dtype=np.uint8))[: n * k].reshape(n, k).astype(np.int64)
    return np.cumsum((quotient << k) + low @ (1 << np.arange(k - 1, -1, -1, dtype=np.int64)))


def _block(reduced: Column, width: int) -> Column:
    return F.floor(reduced / F.lit(width)).cast("long")


class GolombSet:
    """A table of coded blocks: block, n, code; and the numbers that reading it needs."""

    def __init__(self, blocks: DataFrame, target: int, width: int, k: int, keys: int):
        self.blocks, self.target, self.width, self.k, self.keys = blocks, target, width, k, keys

    @property
    def theoretical_fp(self) -> float:
        """The chance that a new key's reduced value is already there."""
        return -math.expm1(-self.keys / self.target) if self.target else 0.0

    def reduced(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.target))


def build(keys: DataFrame, fp_bits: int = 10) -> GolombSet:
    """The set of a table (key, arrivals INT); null keys are left out, an empty table gives an empty set."""
    # the target range follows the number of distinct keys, estimated by a mergeable sketch over all rows
    n = max(1, keys.agg(F.approx_count_distinct("key", 0.02)).first()[0])
    target, k = n << fp_bits, max(0, round(math.log2(max(1.0, 0.69 * (1 << fp_bits)))))
    width = BLOCK_KEYS << fp_bits
    made = GolombSet(None, target, width, k, n)
    values = (
        keys.where("key is not null")
        .groupBy(made.reduced(F.col("key")).alias("value"))
        .agg(F.least(F.sum("arrivals"), F.lit(2)).cast("int").alias("times"))
        .select(_block(F.col("value"), width).alias("block"), "value", "times")
    )

    def encode(table: pa.Table) -> pa.Table:
        block = table["block"][0].as_py()
        value = np.repeat(table["value"].to_numpy(), table["times"].to_numpy())
        value = np.sort(value) - block * width
        return pa.table({"block": [block], "n": pa.array([len(value)], pa.int32()), "code": pa.array([golomb_encode(value, k)], pa.binary())})

    made.blocks = cut(values.groupBy("block").applyInArrow(encode, "block long, n int, code binary"))
    return made


def probe(found: GolombSet, values: DataFrame) -> DataFrame:
    """value, times of those of the distinct reduced ``values`` (column value) that the set has."""
    width, k = found.width, found.k

    def decode(asked: pa.Table, blocks: pa.Table) -> pa.Table:
        empty = pa.table({"value": pa.array([], pa.int64()), "times": pa.array([], pa.int32())})
        if not asked.num_rows or not blocks.num_rows:
            return empty
        block = blocks["block"][0].as_py()
        there = golomb_decode(blocks["code"][0].as_py(), blocks["n"][0].as_py(), k) + block * width
        want = asked["value"].to_numpy()
        times = np.searchsorted(there, want, "right") - np.searchsorted(there, want, "left")
        hit = times > 0
        return pa.table({"value": pa.array(want[hit], pa.int64()), "times": pa.array(times[hit].astype(np.int32), pa.int32())})

    asked = values.select(_block(F.col("value"), width).alias("block"), "value")
    return asked.groupBy("block").cogroup(found.blocks.groupBy("block")).applyInArrow(decode, "value long, times int")


def _parts(arrivals: DataFrame, known: list[DataFrame], id: str, key: Column, at: str):
    rows = arrivals.select(F.col(id).alias("id"), F.col(at).cast("double").alias("at"), key.alias("key")).where("key is not null")
    refs = None
    for part in known:
        part = part.select(F.col("key")).where("key is not null")
        refs = part if refs is None else refs.unionByName(part)
    return rows, refs


def seen_before(arrivals: DataFrame, known: list[DataFrame], key: Column, id: str = "id", at: str = "ingested_at", fp_bits: int = 10) -> dict[str, DataFrame | GolombSet]:
    """For each arriving row whether its key is in ``known`` (tables with a column key) or on an earlier arrival.

    Earlier is by (at, id); a row without a time counts as the last to arrive. Rows without a usable
    key are never seen. Returns the set, ``maybe`` (rows the set says may have been seen, with the
    truth in the column ``seen``) and ``rows`` (all rows with a key).
    """
    rows, refs = _parts(arrivals, known, id, key, at)
    keys = rows.select("key", F.lit(1).alias("arrivals"))
    keys = keys if refs is None else keys.unionByName(refs.select("key", F.lit(2).alias("arrivals")))
    found = build(keys, fp_bits)
    valued = rows.withColumn("value", found.reduced(F.col("key")))
    hits = cut(probe(found, valued.select("value").distinct()).where("times > 1").select("value"))
    n_hits = hits.count()
    near = F.broadcast(hits) if small_enough(n_hits, 16) else hits
    maybe = valued.join(near, "value").select("id", F.coalesce("at", F.lit(float("inf"))).alias("at"), "key")
    # whole keys settle the rows that may have been seen
    first = maybe.groupBy("key").agg(F.min(F.struct("at", "id")).alias("first"))
    if refs is not None:
        # of the earlier keys only those whose reduced value was probed and hit are read whole
        refs = refs.withColumn("value", found.reduced(F.col("key"))).join(near, "value", "left_semi").select("key").distinct()
        first = first.unionByName(refs.select("key", F.lit(None).cast(first.schema["first"].dataType).alias("first")))
    first = first.groupBy("key").agg(F.max("first").alias("first"), F.count("*").alias("parts"), F.count("first").alias("own")).where("own > 0")
    settled = maybe.join(first.select("key", "first", (F.col("parts") > F.col("own")).alias("listed")), "key")
    settled = settled.select("id", (F.col("listed") | (F.struct("at", "id") > F.col("first"))).alias("seen"), "listed")
    return {"set": found, "maybe": settled, "rows": rows}


def found_ids(arrivals: DataFrame, known: list[DataFrame], key: Column, **names) -> DataFrame:
    """id of every arriving row whose key was seen before."""
    return seen_before(arrivals, known, key, **names)["maybe"].where("seen").select("id")


def error_report(arrivals: DataFrame, known: list[DataFrame], key: Column, **names) -> DataFrame:
    """One row: rows_with_key, keys_in_set, said_seen, truly_seen, first_of_a_repeated_key, wrong_answers,
    audited_rate with its 95 % bounds (Wilson) and theoretical_rate; bytes_coded of the set.

    A wrong answer is a row said to be seen whose whole key is on no other row and in no list; the
    set never says 'new' of a seen key. The audited rate is over the rows whose key is new.
    """
    got = seen_before(arrivals, known, key, **names)
    found = got["set"]
    per_key = got["rows"].groupBy("key").agg(F.count("*").alias("n"))
    said = got["maybe"].agg(F.count("*").alias("said_seen"), F.count_if("seen").alias("truly_seen"))
    once = cut(got["maybe"].where("not seen").select("id").join(got["rows"].select("id", "key"), "id").join(per_key, "key").groupBy().agg(F.count_if(F.col("n") == 1).alias("wrong_answers"), F.count_if(F.col("n") > 1).alias("first_of_a_repeated_key")))
    new, z = F.greatest(F.col("rows_with_key") - F.col("truly_seen") - F.col("first_of_a_repeated_key"), F.lit(1)), 1.959964
    rate = F.col("wrong_answers") / new
    middle, half = rate + z * z / (2 * new), z * F.sqrt(rate * (1 - rate) / new + z * z / (4 * new * new))
    total = got["rows"].agg(F.count("*").alias("rows_with_key"))
    size = found.blocks.agg(F.sum("n").alias("values_coded"), F.sum(F.length("code")).alias("bytes_coded"))
    return (
        total.crossJoin(said).crossJoin(once).crossJoin(size)
        .withColumn("keys_in_set", F.lit(found.keys))
        .withColumn("audited_rate", rate).withColumn("audited_low", (middle - half) / (1 + z * z / new)).withColumn("audited_high", (middle + half) / (1 + z * z / new))
        .withColumn("theoretical_rate", F.lit(found.theoretical_fp))
    )
