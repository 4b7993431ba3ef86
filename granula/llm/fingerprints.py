"""Document fingerprints: one-permutation MinHash, optimal densification, b-bit codes.

Every shingle of five words is hashed once; the hash's top bits choose one of BINS bins, whose least hash stands for it. An
empty bin takes the value of a filled one found by a hash sequence of (bin, attempt), the same for every document (optimal
densification). Each value is mixed with its bin's number, and the BITS
low bits are stored, packed, as hex. Two codes of unlike values agree by chance with
probability 2^-BITS, so likeness is (agreeing share - 2^-BITS) / (1 - 2^-BITS), kept within 0 and 1.

Defined results: a null text counts as empty; a text of fewer than five words is one shingle; a text without words has the
fingerprint "none", alike only to itself. The next document follows by (doc_id, text hash), null ids last, and after the last
comes the first; a single row is its own next. Extra columns are not carried.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BINS, BITS, SHINGLE, NONE = 512, 2, 5, "none"
#: Texts are handled so many at a time inside a batch.
STEP = 128
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], dtype=np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def shingle_hashes(text: str, size: int = SHINGLE) -> np.ndarray:
    """A hash of every shingle of `size` words; of the whole sequence if there are fewer."""
    digest = xxhash.xxh64_intdigest
    words = text.encode("utf-8", "surrogatepass").lower().split()
    h = np.fromiter(map(digest, words), dtype=np.uint64, count=len(words))
    size = min(size, len(h)) or 1
    out = np.full(max(0, len(h) - size + 1), np.uint64(size))
    for i in range(size):
        out += h[i : len(h) - size + 1 + i] * _ODD[i]
    return _mix(out)


@lru_cache(maxsize=32)
def _sequence(attempts: int, bins: int) -> np.ndarray:
    """[attempt, bin]: the bin to borrow from; a longer table begins with the shorter one."""
    at = np.arange(attempts, dtype=np.uint64)[:, None] * np.uint64(bins) + np.arange(bins, dtype=np.uint64)[None, :]
    return (_mix(at + np.uint64(1)) % np.uint64(bins)).astype(np.int16)


def codes(text: str | None, bins: int = BINS, bits: int = BITS) -> np.ndarray | None:
    """The low bits of every bin's least hash; None for a text without words."""
    h = shingle_hashes(text or "")
    if not len(h):
        return None
    h.sort()
    bin_of = (h >> np.uint64(64 - bins.bit_length() + 1)).astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], bin_of[1:] != bin_of[:-1])))
    values, filled = np.zeros(bins, dtype=np.uint64), np.zeros(bins, dtype=bool)
    values[bin_of[first]] = h[first]
    filled[bin_of[first]] = True
    empty, at, step = np.flatnonzero(~filled), 0, 8
    while len(empty):  # every attempt draws anew, so this ends with probability one
        table = _sequence(1 << max(6, (at + step - 1).bit_length()), bins)
        source = table[at : at + step, empty]
        hit = filled[source]
        good, first = hit.any(axis=0), hit.argmax(axis=0)
        values[empty[good]] = values[source[first[good], np.flatnonzero(good)]]
        empty, at, step = empty[~good], at + step, min(2 * step, 256)
    own = _mix(values ^ (np.arange(bins, dtype=np.uint64) * _ODD[0]))  # bins that borrowed one value still get codes of their own
    return (own & np.uint64((1 << bits) - 1)).astype(np.uint8)


def pack(code: np.ndarray | None, bits: int = BITS) -> str:
    if code is None:
        return NONE
    return np.packbits((code[:, None] >> np.arange(bits - 1, -1, -1, dtype=np.uint8)) & 1).tobytes().hex()


def unpack(fingerprint: str, bits: int = BITS) -> np.ndarray | None:
    if fingerprint == NONE:
        return None
    flat = np.unpackbits(np.frombuffer(bytes.fromhex(fingerprint), np.uint8)).reshape(-1, bits)
    return (flat << np.arange(bits - 1, -1, -1, dtype=np.uint8)).sum(axis=1).astype(np.uint8)


def likeness(a: np.ndarray | None, b: np.ndarray | None, bits: int = BITS) -> float:
    if a is None or b is None:
        return float(a is None and b is None)
    chance = 0.5**bits
    return float(min(1.0, max(0.0, ((a == b).mean() - chance) / (1 - chance))))


def edited(text: str, following: str) -> str:
    """The last quarter of the code points replaced by the first as many of the next document."""
    k = len(text) // 4
    return text[: len(text) - k] + following[:k] if k else text


def with_next(docs: DataFrame, run, schema: str, parts: int | None = None) -> DataFrame:
    """run(batches) over (bucket, ghost, doc_id, text), every bucket a range of doc_id in order, its last row the ghost that follows it.

    One shuffle of the texts. Ranges, several a task, come from quantiles of doc_id; of each range only its first row's hash reaches
    the driver, and that row goes a second time, as a ghost, to the range before.
    """
    spark = docs.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = parts or 4 * tasks
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("h", F.xxhash64("text")).withColumn("k", F.xxhash64("doc_id", "h"))
    bounds = sorted(set(rows.approxQuantile("doc_id", [i / parts for i in range(1, parts)], 0.1 / parts))) if parts > 1 else []
    bucket = F.when(F.col("doc_id").isNull(), len(bounds) + 1).otherwise(F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b <= F.col("doc_id"))) if bounds else F.lit(0))
    ranged = rows.withColumn("bucket", bucket.cast("int"))
    heads = sorted((r.bucket, r["first"].k) for r in ranged.groupBy("bucket").agg(F.min(F.struct("doc_id", "h", "k")).alias("first")).collect())
    own = F.struct("bucket", F.lit(0).alias("ghost"))
    if heads:
        at = F.array_position(F.array(*[F.lit(k) for _, k in heads]), F.col("k"))
        before = F.get(F.array(*[F.lit(heads[i - 1][0]) for i in range(len(heads))]), (at - 1).cast("int"))
        own = F.array_compact(F.array(own, F.when(at > 0, F.struct(before.alias("bucket"), F.lit(1).alias("ghost")))))
    else:
        own = F.array(own)
    dealt = ranged.withColumn("to", F.explode(own))
    return dealt.select("to.bucket", "to.ghost", "doc_id", "text", "h").repartition(tasks, "bucket").sortWithinPartitions("bucket", "ghost", F.col("doc_id").asc_nulls_last(), "h").drop("h").mapInArrow(run, schema)


def _fingerprint_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: tuple[int, int | None, str, np.ndarray | None] | None = None
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def row(doc_id, text, code, following, next_code):
        other = edited(text, following)
        code2 = codes(other)
        return doc_id, len(text), hashlib.sha256(other.encode("utf-8", "surrogatepass")).hexdigest(), pack(code), pack(code2), likeness(code, code2), likeness(code, next_code)

    for batch in batches:
        for at in range(0, batch.num_rows, STEP):
            part, out = batch.slice(at, STEP), []
            for bucket, ghost, doc_id, text in zip(*(part.column(i).to_pylist() for i in range(4)), strict=True):
                if held is None and ghost:
                    continue  # further rows of the same least id
                code = codes(text)
                if held is not None and held[0] == bucket:
                    out.append(row(*held[1:], text, code))
                held = None if ghost else (bucket, doc_id, text, code)
            cols = list(zip(*out, strict=True)) or [[]] * len(names)
            types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, types, strict=True)], names=names)


def op5_one_permutation_minhash(docs: DataFrame) -> DataFrame:
    """The contract's query."""
    return with_next(docs, _fingerprint_rows, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
