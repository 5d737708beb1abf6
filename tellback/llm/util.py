"""Helpers shared by the operators: folders, slices of Arrow batches, words and shingles as hashes."""

from __future__ import annotations

import tempfile
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructField, StructType

#: Bytes of text that one numpy step looks at; its arrays take about 60 times as much.
SLICE_BYTES = 1 << 19


def folder(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all executors share (``spark.checkpoint.dir``).

    Only a session within one process may go without that setting; it then gets a temporary folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="tellback-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read again: cuts the lineage and survives lost executors."""
    path = folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def held_out(doc_id: str) -> Column:
    """Documents that no model learns from: crc32 of the id as text leaves 2 when divided by 4. Null ids are learnt from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches with at most ``limit`` bytes of ``column`` (a longer value stands alone)."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        values = batch.column(batch.schema.get_field_index(column))
        ends = np.cumsum(np.asarray(pc.binary_length(values).fill_null(0), dtype=np.int64))
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def text_bytes(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all values one after the other, and their offsets (nulls are empty)."""
    values = values.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(values.buffers()[1], dtype=np.int64)[values.offset : values.offset + len(values) + 1]
    raw = values.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8)[offsets[0] : offsets[-1]] if raw is not None and len(offsets) else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def _byte_table(word: bool) -> tuple[np.ndarray, np.ndarray]:
    """Per byte: itself with A-Z in lower case, or 0 between words."""
    table = np.arange(256, dtype=np.uint8)
    table[ord("A") : ord("Z") + 1] += 32
    keep = np.zeros(256, bool)
    if word:
        keep[128:] = True
        for low, high in ((48, 57), (97, 122)):
            keep[low : high + 1] = True
        keep[65:91] = True
    else:
        keep[:] = True
        keep[[32, 9, 10, 11, 12, 13]] = False
    table[~keep] = 0
    return table, keep


SPACED = _byte_table(False)
LETTERS = _byte_table(True)

_ODD = np.uint64(0x9E3779B97F4A7C15)
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values with good spread (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number modulo 2**64 and their inverses, at least ``n`` of them."""
    have = _powers.get("up")
    if have is None or len(have) < n:
        size = max(n, SLICE_BYTES + 1)
        base = np.uint64(0xD6E8FEB86659FD93)
        inverse = np.uint64(pow(int(base), -1, 1 << 64))
        for key, by in (("up", base), ("down", inverse)):
            table = np.full(size, by, np.uint64)
            table[0] = 1
            _powers[key] = np.multiply.accumulate(table)
    return _powers["up"], _powers["down"]


def word_hashes(data: np.ndarray, offsets: np.ndarray, table=SPACED) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hashes of all words, first word of each document (one more at the end), and each word's first and last byte + 1.

    Words are runs of bytes that ``table`` keeps; A-Z count as lower case. No word spans two documents.
    """
    lower, keep = table
    n = len(data)
    inside = keep[data]
    start = inside.copy()
    start[1:] &= ~inside[:-1]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < n)]
    start[cuts] = inside[cuts]
    begins = np.flatnonzero(start)
    stop = inside.copy()
    if n:
        stop[:-1] &= ~inside[1:]
        stop[cuts - 1] = inside[cuts - 1]
    ends = np.flatnonzero(stop) + 1
    up, down = powers(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(lower[data].astype(np.uint64) * up[:n], out=sums[1:])
    hashes = mix((sums[ends] - sums[begins]) * down[begins] + (ends - begins).astype(np.uint64) * _ODD)
    return hashes, np.searchsorted(begins, offsets), begins, ends


def shingle_hashes(words: np.ndarray, n: int = 5) -> np.ndarray:
    """Hashes of the ``n`` words from each place on; the last ``n - 1`` places have none."""
    m = len(words) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(m, np.uint64)
    factor = 0x2545F4914F6CDD1D
    for k in range(n):
        total += words[k : k + m] * np.uint64(factor)
        factor = factor * 0xDA942042E4DD58B5 % (1 << 64) | 1
    return mix(total)


def shingle_sets(values: pa.Array, n: int = 5) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its ``n``-word shingles.

    Fewer words count as one shingle; without words or text the set is empty. Two different shingles share a hash with a
    chance of 2**-64.
    """
    data, offsets = text_bytes(values)
    words, first, _, _ = word_hashes(data, offsets)
    every = shingle_hashes(words, n)
    out = []
    for a, b in zip(first[:-1], first[1:]):
        if b - a >= n:
            out.append(np.unique(every[a : b - n + 1]))
        elif b > a:
            total = words[a:b] * (np.arange(1, b - a + 1, dtype=np.uint64) * np.uint64(2) + np.uint64(1))
            out.append(mix(total.sum(dtype=np.uint64, keepdims=True) + np.uint64(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def crc_of_ids(ids: np.ndarray) -> int:
    """Unsigned crc32 of ids written as little-endian unsigned 32-bit integers."""
    return zlib.crc32(np.ascontiguousarray(ids, dtype="<u4").tobytes())


def appended(docs: DataFrame, text: str, name: str, kind: str, judge) -> DataFrame:
    """All rows and columns of ``docs`` and, as the last column, ``judge(texts)`` for slices of the texts.

    A column that is called ``name`` already is replaced.
    """
    docs = docs.drop(name)
    schema = StructType([*docs.schema.fields, StructField(name, DataType.fromDDL(kind))])

    def run(batches):
        for batch in slices(batches, text):
            found = judge(batch.column(batch.schema.get_field_index(text)))
            yield pa.RecordBatch.from_arrays([*batch.columns, found], names=[*batch.schema.names, name])

    return docs.mapInArrow(run, schema)
