"""Line dedup by winnowing.

A text is cut into units: lines, and inside a line sentences (LINE; the pieces joined give the text back). Windows are runs of
whole units with at least MIN_WORDS words that are shortest from their first unit on or shortest back from their last. Winnowing
keeps, of each window, the unit with the least hash (the rightmost on ties) as its fingerprint; equal windows choose equal
fingerprints, so a repeated run of whole units with MIN_WORDS words or more is guaranteed to share one. Words of a unit that is
repeated only in part do not count: a passage that begins or ends in mid-sentence is found only if the whole units inside it
have MIN_WORDS words.

Positions are joined by fingerprint; those that occur once are dropped. A match is extended both ways through the windows that
chose the fingerprint: each window's content hash is compared over all documents, the earliest by (doc_id, text hash, unit)
stays, and every unit of a later equal window is deleted. Windows that go forward from a unit cover a repeated run up to where
fewer than MIN_WORDS words are left, and the window back from its last unit covers the rest; so what is deleted is the union of
all repeated runs of whole units, each from its first unit to its last. No pair of occurrences is ever formed: groups are
aggregated to their first member.

Defined results: a null text counts as empty; texts under MIN_WORDS words have no window and stay; pieces without words are never
deleted; a very long text has as many windows as units, twice as many at most; null doc_ids come last in the order; rows with the
same doc_id and text are one document and are cut alike; an empty table gives an empty result; extra columns are not carried.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granula.llm.common import stored

MIN_WORDS = 50
LINE = r"[^.!?\n]*[.!?\n]+[ \t\n]*|[^.!?\n]+$"
#: The same over UTF-8, as LINE names ASCII alone. A piece's words are those of bytes.split, which knows ASCII's white space only.
_LINE, _BYTES = re.compile(LINE), re.compile(LINE.encode())


def units(text: str | None) -> list[str]:
    return _LINE.findall(text or "")


def winnow(pieces: list[str], min_words: int = MIN_WORDS) -> tuple[np.ndarray, ...]:
    """(start, end, chosen unit, its hash, window hash) of every window; units are indexes of `pieces`, ends inclusive."""
    return _winnow([p.encode("utf-8", "surrogatepass") for p in pieces], min_words)


def _winnow(pieces: list[bytes], min_words: int = MIN_WORDS) -> tuple[np.ndarray, ...]:
    sizes = [len(p.split()) for p in pieces]
    if sum(sizes) < min_words:
        return (np.empty(0, np.int64),) * 3 + (np.empty(0, np.uint64),) * 2
    index = [i for i, n in enumerate(sizes) if n]
    n = np.array([sizes[i] for i in index], dtype=np.int64)
    digest = xxhash.xxh64_intdigest
    values = [digest(pieces[i].strip()) for i in index]
    h = np.array(values, dtype=np.uint64)
    upto = np.concatenate(([0], np.cumsum(n)))
    # the shortest windows from s end at first[s]; those back from e start at s for e from first[s] to before first[s + 1]
    first = np.append(np.searchsorted(upto, upto[:-1] + min_words, side="left") - 1, len(n))
    whole = np.flatnonzero(first < len(n))
    many = np.maximum(1, first[whole + 1] - first[whole])
    start = np.repeat(whole, many)
    end = first[start] + np.arange(len(start)) - np.repeat(np.cumsum(many) - many, many)
    chosen, window, deque = [], [], []
    raw, head, pushed = h.tobytes(), 0, 0
    for s, e in zip(start.tolist(), end.tolist(), strict=True):
        while pushed <= e:
            while len(deque) > head and values[deque[-1]] >= values[pushed]:
                deque.pop()
            deque.append(pushed)
            pushed += 1
        while deque[head] < s:
            head += 1
        chosen.append(deque[head])
        window.append(digest(raw[8 * s : 8 * e + 8]))
    at, chosen = np.array(index, dtype=np.int64), np.array(chosen, dtype=np.int64)
    return at[start], at[end], chosen, h[chosen], np.array(window, dtype=np.uint64)


def _positions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a selected fingerprint position: the windows that chose it."""
    for batch in batches:
        rows, many, long = [], [], [np.empty(0, np.int64)]
        fp, starts, ends, grams = [[np.empty(0, np.int64)] for _ in range(4)]
        texts = batch.column(2).cast(pa.binary())
        for i in range(0, batch.num_rows, 128):
            for row, text in enumerate(texts.slice(i, 128).to_pylist(), i):
                start, end, chosen, least, gram = _winnow(_BYTES.findall(text))
                if not len(start):
                    continue
                edge = np.flatnonzero(np.concatenate(([True], chosen[1:] != chosen[:-1], [True])))
                rows.append(row)
                many.append(len(edge) - 1)
                for c, v in ((long, np.diff(edge)), (fp, least[edge[:-1]].view(np.int64)), (starts, start), (ends, end), (grams, gram.view(np.int64))):
                    c.append(v)
        at = pa.array(np.repeat(np.array(rows, dtype=np.int64), many))
        upto = pa.array(np.concatenate(([0], np.cumsum(np.concatenate(long)))).astype(np.int32))
        lists = [pa.ListArray.from_arrays(upto, pa.array(np.concatenate(c).astype(kind))) for c, kind in ((starts, np.int32), (ends, np.int32), (grams, np.int64))]
        yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(np.concatenate(fp)), *lists], names=["doc_id", "h", "fp", "starts", "ends", "grams"])


def repeated_windows(docs: DataFrame) -> DataFrame:
    """(doc_id, h, start, end): the later occurrences of every window that stands more than once. docs: doc_id, h, text."""
    found = stored(docs.mapInArrow(_positions, "doc_id long, h long, fp long, starts array<int>, ends array<int>, grams array<long>"))
    # stored, so that either side of a join below is a plain exchange, whose hot keys adaptive execution may split
    again = stored(found.groupBy("fp").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("fp"))
    windows = found.join(again, "fp", "left_semi").select("doc_id", "h", F.explode(F.arrays_zip("starts", "ends", "grams")).alias("w")).select(F.col("w.grams").alias("gram"), F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "h", F.col("w.starts").alias("start")).alias("at"), F.col("w.ends").alias("end"))
    windows = stored(windows)
    first = stored(windows.groupBy("gram").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"))
    return windows.join(first, "gram").where(~F.col("at").eqNullSafe(F.col("first"))).select("at.doc_id", "at.h", "at.start", "end")


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A text without spans stays as it is: only its units are counted."""
    for batch in batches:
        texts, spans = batch.column(1).cast(pa.binary()), batch.column(2)
        upto, start, end = spans.offsets.to_pylist(), spans.values.field("start").to_numpy(), spans.values.field("end").to_numpy()
        kept, counts = [], np.zeros((3, batch.num_rows), dtype=np.int64)
        for i in range(0, batch.num_rows, 128):
            for row, text in enumerate(texts.slice(i, 128).to_pylist(), i):
                pieces = _BYTES.findall(text)
                counts[0, row] = len(pieces)
                if upto[row] == upto[row + 1]:
                    kept.append(text)
                    continue
                edge = np.zeros(len(pieces) + 1, dtype=np.int64)
                np.add.at(edge, start[upto[row] : upto[row + 1]], 1)
                np.add.at(edge, end[upto[row] : upto[row + 1]] + 1, -1)
                gone = (np.cumsum(edge[:-1]) > 0).tolist()
                sizes = [len(p.split()) if g else 0 for p, g in zip(pieces, gone, strict=True)]
                kept.append(b"".join([p for p, n in zip(pieces, sizes, strict=True) if not n]))
                counts[1:, row] = sum(map(bool, sizes)), sum(sizes)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(kept, pa.binary()).cast(pa.string()), *map(pa.array, counts)], names=["doc_id", "text", "n_units", "removed_units", "removed_words"])


def dedup_lines(docs: DataFrame) -> DataFrame:
    """doc_id, text without its later repeated runs, n_units, removed_units, removed_words: a row for every row."""
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    # of rows with one doc_id and text, windows count once
    spans = repeated_windows(keyed.select("doc_id", "h", "text")).groupBy("doc_id", "h").agg(F.collect_set(F.struct("start", "end")).alias("spans")).select(F.col("doc_id").alias("d"), F.col("h").alias("k"), "spans")
    joined = keyed.join(spans, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("h") == F.col("k")), "left")
    return joined.select("doc_id", "text", "spans").mapInArrow(_cut, "doc_id long, text string, n_units long, removed_units long, removed_words long")


def op1_line_winnowing(docs: DataFrame) -> DataFrame:
    """Every document: its units, how many go, and the MD5 of what stays."""
    return dedup_lines(docs).select("doc_id", "n_units", "removed_units", "removed_words", F.md5(F.col("text").cast("binary")).alias("clean_md5"))


def oracle_sql() -> str:
    """Brute force: every window, forward from a unit or back from one, of every document against every other."""
    space = r"[\x20\x09-\x0D]+"
    return rf"""
    WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
    u AS (SELECT rid, doc_id, text, unnest(p) AS piece, generate_subscripts(p, 1) AS i FROM (SELECT *, regexp_extract_all(text, '[^.!?\n]*[.!?\n]+[ \t\n]*|[^.!?\n]+$') AS p FROM d)),
    w AS (SELECT *, len(regexp_extract_all(piece, '[^\x20\x09-\x0D]+')) AS n, regexp_replace(piece, '^{space}|{space}$', '', 'g') AS body FROM u),
    x AS (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY i) AS k, sum(n) OVER (PARTITION BY rid ORDER BY i) AS upto FROM w WHERE n > 0),
    a0 AS (SELECT a.rid, a.doc_id, a.text, a.k AS lo, b.k AS hi FROM (SELECT *, upto - n + {MIN_WORDS} AS need FROM x) a ASOF JOIN x b ON a.rid = b.rid AND a.need <= b.upto),
    a1 AS (SELECT a0.*, coalesce(lead(hi) OVER (PARTITION BY a0.rid ORDER BY lo), c.n + 1) AS until FROM a0 JOIN (SELECT rid, count(*) AS n FROM x GROUP BY rid) c ON a0.rid = c.rid),
    a AS (SELECT rid, doc_id, text, lo, unnest(range(hi, greatest(until, hi + 1))) AS hi FROM a1),
    l AS (SELECT rid, list(body ORDER BY k) AS bodies FROM x GROUP BY rid),
    g AS (SELECT a.*, array_to_string(bodies[lo : hi], chr(1)) AS gram FROM a JOIN l USING (rid)),
    f AS (SELECT *, first_value(rid) OVER (PARTITION BY gram ORDER BY doc_id NULLS LAST, text, lo) AS frid, first_value(lo) OVER (PARTITION BY gram ORDER BY doc_id NULLS LAST, text, lo) AS flo FROM g),
    gone AS (SELECT DISTINCT rid, unnest(range(lo, hi + 1)) AS k FROM f WHERE NOT (rid = frid AND lo = flo)),
    m AS (SELECT w.rid, w.i, w.piece, w.n, gone.k IS NOT NULL AS removed FROM w LEFT JOIN x ON w.rid = x.rid AND w.i = x.i LEFT JOIN gone ON x.rid = gone.rid AND x.k = gone.k),
    s AS (SELECT rid, count(*) AS n_units, count(*) FILTER (removed) AS removed_units, coalesce(sum(n) FILTER (removed), 0) AS removed_words, coalesce(string_agg(piece, '' ORDER BY i) FILTER (NOT removed), '') AS kept FROM m GROUP BY rid)
    SELECT d.doc_id, coalesce(n_units, 0)::BIGINT AS n_units, coalesce(removed_units, 0)::BIGINT AS removed_units, coalesce(removed_words, 0)::BIGINT AS removed_words, md5(coalesce(kept, '')) AS clean_md5
    FROM d LEFT JOIN s USING (rid)"""
