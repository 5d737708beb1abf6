"""Token ids in files: canonical Huffman codes of limited length, in blocks that are decoded on their own.

A folder holds ``codebook`` (Parquet, one row with the code length of each id) and ``blocks``: binary files, each a
row of blocks with one line feed behind each. A block, all numbers little-endian:

    magic "TKH1" | part u32 | block u32 | ids of the part before it u64 | documents u32 | ids u64 | payload bytes u64
    document ids i64[documents] | 1 where the id is known u8[documents] | ids of each document u32[documents]
    checkpoints u64[ids / CHECKPOINT, rounded up]: bit offset of every CHECKPOINT-th id
    payload: the codes, high bit first

Parts are numbered in the order of document ids, and so are the blocks of a part. From a checkpoint on, decoding needs
nothing that stands before it; all stretches of a block are decoded together, an id of each per step.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tellback.llm import tokens, util

MAX_BITS = 18
CHECKPOINT = 512
BLOCK_IDS = 1 << 19
FILE_BLOCKS = 16
HEAD = struct.Struct("<4sIIQIQQ")
MAGIC = b"TKH1"


def code_lengths(counts: np.ndarray, max_bits: int = MAX_BITS) -> np.ndarray:
    """Code length of each id, 0 for ids without a count: the least total under ``max_bits`` (package-merge)."""
    out = np.zeros(len(counts), np.uint8)
    used = np.flatnonzero(counts)
    n = len(used)
    if n < 2:
        out[used] = 1
        return out
    if n > 1 << max_bits:
        raise ValueError(f"{n} ids don't fit in codes of {max_bits} bits")
    order = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[order].astype(np.int64)
    level, leaf_flags = leaves, [np.ones(n, bool)]
    for _ in range(max_bits - 1):
        pairs = level[: len(level) // 2 * 2].reshape(-1, 2).sum(1)
        both = np.concatenate((leaves, pairs))
        at = np.argsort(both, kind="stable")
        level = both[at]
        leaf_flags.append(at < n)
    lengths, k = np.zeros(n, np.int64), 2 * n - 2
    for flags in leaf_flags[::-1]:
        taken = int(flags[:k].sum())
        lengths[:taken] += 1
        k = 2 * (k - taken)
    out[order] = lengths
    return out


class Code:
    """Canonical codes: shorter ones first, ids of one length in their order."""

    def __init__(self, lengths: np.ndarray):
        self.length = lengths.astype(np.int64)
        used = np.flatnonzero(self.length)
        order = used[np.lexsort((used, self.length[used]))]
        self.bits = int(self.length.max(initial=1))
        spans = (np.int64(1) << (self.bits - self.length[order])).astype(np.int64)
        starts = np.cumsum(spans) - spans
        self.code = np.zeros(len(lengths), np.uint64)
        self.code[order] = (starts >> (self.bits - self.length[order])).astype(np.uint64)
        # one entry for each value of the next ``bits`` bits
        self.id_of = np.zeros(1 << self.bits, np.uint32)
        self.size_of = np.ones(1 << self.bits, np.uint8)
        self.id_of[: spans.sum()] = np.repeat(order, spans)
        self.size_of[: spans.sum()] = np.repeat(self.length[order], spans)

    def encode(self, ids: np.ndarray) -> tuple[np.ndarray, bytes]:
        """Checkpoints and payload."""
        size = self.length[ids]
        ends = np.cumsum(size)
        begin = ends - size
        total = int(ends[-1]) if len(ids) else 0
        words = np.zeros(total // 64 + 2, np.uint64)
        word, room = begin >> 6, 64 - (begin & 63) - size  # bits left in the word; below 0: the code reaches into the next
        over = np.flatnonzero(room < 0)
        code = self.code[ids]
        high = np.where(room >= 0, code << np.maximum(room, 0).astype(np.uint64), code >> np.maximum(-room, 0).astype(np.uint64))
        if len(ids):
            first = np.flatnonzero(np.diff(word, prepend=-1))
            words[word[first]] = np.add.reduceat(high, first)
            words[word[over] + 1] += code[over] << (64 + room[over]).astype(np.uint64)
        return begin[::CHECKPOINT].astype("<u8"), words.astype(">u8").tobytes()[: (total + 7) // 8]

    def decode(self, payload: bytes, checkpoints: np.ndarray, n: int) -> np.ndarray:
        """The ``n`` ids of a block."""
        if not n:
            return np.zeros(0, np.int64)
        raw = np.frombuffer(payload + bytes(8), np.uint8).astype(np.uint32)
        window = raw[:-3] << np.uint32(24) | raw[1:-2] << np.uint32(16) | raw[2:-1] << np.uint32(8) | raw[3:]
        at = checkpoints.astype(np.int64)
        out = np.zeros((CHECKPOINT, len(at)), np.uint32)
        shift = np.uint32(32 - self.bits)
        for k in range(CHECKPOINT):
            if k * 1 == n - (len(at) - 1) * CHECKPOINT:  # only the last stretch can be shorter
                at = at[:-1]
                if not len(at):
                    break
            index = window[at >> 3] << (at & 7).astype(np.uint32) >> shift
            out[k, : len(at)] = self.id_of[index]
            at = at + self.size_of[index]
        return out.T.reshape(-1)[:n].astype(np.int64)


def block_bytes(code: Code, part: int, number: int, before: int, doc: np.ndarray, known: np.ndarray, size: np.ndarray, ids: np.ndarray) -> bytes:
    checkpoints, payload = code.encode(ids)
    head = HEAD.pack(MAGIC, part, number, before, len(doc), len(ids), len(payload))
    return b"".join((head, doc.astype("<i8").tobytes(), known.astype("u1").tobytes(), size.astype("<u4").tobytes(), checkpoints.tobytes(), payload))


def blocks_of(code: Code, content: bytes):
    """(part, block, ids before it in the part, document ids, known, sizes, ids) of each block of a file."""
    at = 0
    while at < len(content):
        magic, part, number, before, docs, n, length = HEAD.unpack_from(content, at)
        if magic != MAGIC:
            raise ValueError(f"no block at byte {at}")
        at += HEAD.size
        fields = []
        for kind, count in (("<i8", docs), ("u1", docs), ("<u4", docs), ("<u8", -(-n // CHECKPOINT))):
            fields.append(np.frombuffer(content, kind, count, at))
            at += fields[-1].nbytes
        ids = code.decode(content[at : at + length], fields[3], n)
        at += length + 1
        yield part, number, before, fields[0], fields[1].astype(bool), fields[2].astype(np.int64), ids


def write(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = 1, id: str = "doc_id", text: str = "text") -> None:
    """Write the ids of all documents to the folder ``path`` in ascending order of document ids (unknown ids first).

    Rows with one id stand next to each other in a fixed order; each is a document of its own. Null texts are empty.
    """
    spark, where = docs.sparkSession, tokenizer or tokens.default_path()

    def tokenize(batches):
        encoder = tokens.Encoder.of(where)
        kind = "<u2" if encoder.tokenizer.get_vocab_size() <= 1 << 16 else "<u4"
        for batch in util.slices(batches, "text", tokens.SLICE_BYTES):
            ids, offsets = encoder.documents(batch.column(1), end_id)
            raw, width = ids.astype(kind).tobytes(), int(kind[-1])
            parts = [raw[a * width : b * width] for a, b in zip(offsets[:-1], offsets[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(parts, pa.binary()), pa.array([width] * len(parts), pa.int32()), pa.array([zlib.crc32(p) for p in parts], pa.int64())], names=["doc_id", "ids", "width", "tie"])

    rows = docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    coded = util.stored(rows.mapInArrow(tokenize, "doc_id long, ids binary, width int, tie long"), "token-ids")

    def count(batches):
        total = np.zeros(0, np.int64)
        for batch in util.slices(batches, "ids"):
            raw, _ = _flat(batch.column(0), batch.column(1))
            own = np.bincount(raw, minlength=len(total))
            own[: len(total)] += total
            total = own
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["id", "n"])

    counted = coded.select("ids", "width").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(int(max(counted["id"].to_numpy(), default=0)) + 1, np.int64)  # one number per id of the vocabulary
    counts[counted["id"].to_numpy()] = counted["n"].to_numpy()
    lengths = code_lengths(counts)
    spark.createDataFrame([(bytearray(lengths.tobytes()),)], "lengths binary").coalesce(1).write.parquet(f"{path}/codebook")
    shared = spark.sparkContext.broadcast(Code(lengths))

    def encode(batches):
        code, part = shared.value, TaskContext.get().partitionId()
        number, before, held, have = 0, 0, [], 0

        def block():
            doc, known, size, ids = (np.concatenate(x) for x in zip(*held))
            return block_bytes(code, part, number, before, doc, known, size, ids), len(ids)

        for batch in util.slices(batches, "ids"):
            ids, offsets = _flat(batch.column(1), batch.column(2))
            own = batch.column(0)
            held.append((own.fill_null(0).to_numpy(zero_copy_only=False), ~own.is_null().to_numpy(zero_copy_only=False), np.diff(offsets), ids))
            have += len(ids)
            if have >= BLOCK_IDS:
                raw, n = block()
                yield pa.RecordBatch.from_arrays([pa.array([raw], pa.binary())], names=["block"])
                number, before, held, have = number + 1, before + n, [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([block()[0]], pa.binary())], names=["block"])

    ordered = coded.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "ids", "width")
    # a cast leaves the bytes as they are, and the text writer puts a line feed behind each value
    ordered.mapInArrow(encode, "block binary").select(F.col("block").cast("string").alias("value")).write.option("maxRecordsPerFile", FILE_BLOCKS).text(f"{path}/blocks")


def _flat(values: pa.Array, widths: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Ids of a column of byte strings, one after the other, and their offsets."""
    width = int(widths[0].as_py()) if len(widths) else 2
    parts = values.to_pylist()
    return np.frombuffer(b"".join(parts), f"<u{width}").astype(np.int64), np.concatenate(([0], np.cumsum([len(p) // width for p in parts])))


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids of each document in the folder ``path``."""
    return _read(spark, path, "ids binary", lambda ids: pa.array([x.astype("<u4").tobytes() for x in ids], pa.binary()))


def _read(spark: SparkSession, path: str, column: str, made) -> DataFrame:
    lengths = np.frombuffer(bytes(spark.read.parquet(f"{path}/codebook").first()["lengths"]), np.uint8)
    shared, name = spark.sparkContext.broadcast(lengths), column.split()[0]

    def decode(batches):
        code = Code(shared.value)
        for batch in batches:
            for content in batch.column(0):
                for part, _, before, doc, known, size, ids in blocks_of(code, content.as_py()):
                    ends = np.cumsum(size)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([part] * len(doc), pa.int32()), pa.array(doc, pa.int64(), mask=~known), pa.array(before + ends - size), pa.array(size), made(np.split(ids, ends[:-1]))],
                        names=["part", "doc_id", "start", "n_tokens", name],
                    )

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(f"{path}/blocks").select("content")
    found = files.mapInArrow(decode, f"part int, doc_id long, start long, n_tokens long, {column}")
    if column.startswith("ids_crc32"):
        found = util.stored(found, "decoded")
    sums = sorted(found.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect())  # a row per task that wrote
    starts = np.cumsum([0, *(r["n"] for r in sums)])[:-1].tolist()
    before = spark.createDataFrame([(r["part"], s) for r, s in zip(sums, starts)], "part int, before long")
    return found.join(F.broadcast(before), "part").select("doc_id", (F.col("start") + F.col("before")).alias("start"), "n_tokens", name)


def token_files(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Write ``docs`` and read them back: doc_id, start, n_tokens and ids_crc32 for each row, taken from the files.

    Empty and null texts are the end id alone; an empty table gives no rows. Columns other than doc_id and text are not
    looked at.
    """
    spark = docs.sparkSession
    path = path or util.folder(spark, "token-files")
    write(docs, path)
    return _read(spark, path, "ids_crc32 long", lambda ids: pa.array([util.crc_of_ids(x) for x in ids], pa.int64()))
