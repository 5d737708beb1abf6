"""Order-preserving packing: a stream of documents is cut into windows by dynamic programming.

A window holds at most ``width`` tokens. Windows may end behind a document (free), behind a sentence or, in sentences longer
than ``STEP`` tokens, behind every ``STEP`` tokens (both at a price). The cuts with the least padding plus prices are
found in one pass: with d(i) the least cost of the windows up to place i,

    d(j) = price(j) + width - j + min over i in [j - width, j) of (d(i) + i),

and the minimum of a sliding range comes from a queue whose values never fall. Each task packs the rows of its own partition in
their order, in chunks whose last window is carried on; nothing is shuffled, and at most one window per task is short.
"""

from __future__ import annotations

import zlib
from collections import deque
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tellback.llm import tokens, util

WIDTH = 2048
END_ID = 1
#: Prices in tokens of padding.
SENTENCE, INSIDE = 8, 24
STEP = 32
CHUNK = 1 << 19


def cuts(place: list[int], price: list[int], width: int) -> list[int]:
    """Indices of the chosen cuts. ``place`` rises from the start, in steps of ``width`` at most, to the end of the stream."""
    best, back = [0] * len(place), [0] * len(place)
    queue: deque[tuple[int, int]] = deque([(place[0], 0)])  # (d(i) + i, index), rising
    for j in range(1, len(place)):
        while place[queue[0][1]] < place[j] - width:
            queue.popleft()
        value, back[j] = queue[0]
        best[j] = price[j] + width - place[j] + value
        own = best[j] + place[j]
        while queue and queue[-1][0] > own:
            queue.pop()
        queue.append((own, j))
    chosen, j = [], len(place) - 1
    while j:
        chosen.append(j)
        j = back[j]
    return chosen[::-1]


@dataclass
class Stream:
    """Pieces of documents one after the other: ids, and per piece the id, start in and length of its document, and its size."""

    ids: np.ndarray
    doc: np.ndarray
    known: np.ndarray
    start: np.ndarray
    total: np.ndarray
    size: np.ndarray

    def __add__(self, other: Stream) -> Stream:
        return Stream(*(np.concatenate((getattr(self, k), getattr(other, k))) for k in self.__dataclass_fields__))

    @classmethod
    def empty(cls) -> Stream:
        return cls(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool), *(np.zeros(0, np.int64) for _ in range(3)))


def _candidates(stream: Stream, ending: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray]:
    """Places where a window may end and their prices, with the start of the stream first."""
    n = len(stream.ids)
    price = np.full(n + 1, -1, np.int64)
    price[1:][ending[stream.ids]] = SENTENCE
    price[0] = 0
    price[np.cumsum(stream.size)] = 0
    place = np.flatnonzero(price >= 0)
    gap = np.diff(place)
    long = np.flatnonzero(gap > step)
    more = (gap[long] - 1) // step
    first = np.cumsum(more) - more
    inside = np.repeat(place[long], more) + step * (np.arange(more.sum()) - np.repeat(first, more) + 1)
    price[inside] = INSIDE
    place = np.flatnonzero(price >= 0)
    return place, price[place]


def _windows(stream: Stream, ends: np.ndarray, first: int) -> pa.RecordBatch:
    """A row per piece: the parts of documents in the windows that end at ``ends``."""
    doc_ends = np.cumsum(stream.size)
    stops = np.unique(np.concatenate((ends, doc_ends[doc_ends < ends[-1]])))
    begins = np.concatenate(([0], stops[:-1]))
    window = np.searchsorted(ends, begins, side="right")
    owner = np.searchsorted(doc_ends, begins, side="right")
    raw = memoryview(stream.ids.astype("<u4").tobytes())
    window_start = np.concatenate(([0], ends))[window]
    return pa.RecordBatch.from_arrays(
        [
            pa.array(stream.doc[owner], pa.int64(), mask=~stream.known[owner]),
            pa.array(stream.start[owner] + begins - (doc_ends - stream.size)[owner]),
            pa.array(stops - begins),
            pa.array([zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(begins, stops)], pa.int64()),
            pa.array(stream.total[owner]),
            pa.array(first + window),
            pa.array(begins - window_start),
        ],
        names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
    )


def _rest(stream: Stream, at: int) -> Stream:
    """What lies behind place ``at``."""
    doc_ends = np.cumsum(stream.size)
    keep = doc_ends > at
    cut = np.maximum(at - (doc_ends - stream.size)[keep], 0)
    return Stream(stream.ids[at:], stream.doc[keep], stream.known[keep], stream.start[keep] + cut, stream.total[keep], stream.size[keep] - cut)


def packed(docs: DataFrame, tokenizer: str | None = None, width: int = WIDTH, end_id: int = END_ID, id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id and offset.

    Every row of ``docs`` is its own document, also when ids repeat; null and empty texts are the end id alone, null ids
    stay null. A document of any length is cut into as many pieces as it needs. ``sequence_id`` is the task's number times 2**32
    plus the number of the window in the task. An empty table gives no pieces. Other columns are not looked at.
    """
    path = tokenizer or tokens.default_path()

    def run(batches):
        encoder = tokens.Encoder.of(path)
        ending = encoder.ending()
        stream, done = Stream.empty(), TaskContext.get().partitionId() << 32

        def pack(stream: Stream, done: int, last: bool):
            place, price = _candidates(stream, ending, min(STEP, width))
            ends = place[cuts(place.tolist(), price.tolist(), width)]
            if not last:
                ends = ends[:-1]
            if not len(ends):
                return None, stream, done
            return _windows(stream, ends, done), _rest(stream, int(ends[-1])), done + len(ends)

        held, held_size = [stream], 0
        for batch in util.slices(batches, "text", tokens.SLICE_BYTES):
            ids, offsets = encoder.documents(batch.column(1), end_id)
            own = batch.column(0)
            size = np.diff(offsets)
            held.append(Stream(ids, own.fill_null(0).to_numpy(zero_copy_only=False), ~own.is_null().to_numpy(zero_copy_only=False), np.zeros(len(size), np.int64), size, size))
            held_size += len(ids)
            if held_size >= CHUNK:
                out, stream, done = pack(sum(held[1:], held[0]), done, False)
                held, held_size = [stream], len(stream.ids)
                if out is not None:
                    yield out
        stream = sum(held[1:], held[0])
        if len(stream.ids):
            yield pack(stream, done, True)[0]

    rows = docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
