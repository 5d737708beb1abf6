"""Quality scores by gradient-boosted trees over statistics of the whole text.

Each feature is cut into bins at quantiles of the training rows; a tree grows level by level from histograms of gradients
per (node, feature, bin). All trees are full binary trees of one depth, so the forest is three flat arrays and numpy walks
it for a batch of documents at once.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructType

from tellback.llm import util

#: Labelled documents that training reads at most; the ones with the smallest hash of their id.
TRAIN_ROWS = 20_000
THRESHOLD = 0.7

FEATURES = [
    "log_bytes", "upper", "digit", "space", "newline", "stop", "comma", "loud", "symbol", "bar", "angle", "wide",
    "word_length", "word_spread", "longest_word", "distinct_words", "repeated_word", "short_words", "distinct_shingles",
    "log_words", "log_lines", "line_words", "distinct_lines", "symbol_words",
]

_CLASSES = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digit": b"0123456789", "space": b" \t", "newline": b"\n\r", "stop": b".",
    "comma": b",;:", "loud": b"!?", "symbol": b"*#&%$@^~=+_", "bar": b"|", "angle": b"<>{}[]\\",
}


def _share(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Distinct values per document divided by all values; 1 without values."""
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    order = np.lexsort((hashes, doc))
    d, h = doc[order], hashes[order]
    new = np.ones(len(h), bool)
    new[1:] = (d[1:] != d[:-1]) | (h[1:] != h[:-1])
    distinct = np.bincount(d[new], minlength=len(first) - 1)
    return np.where(np.diff(first) > 0, distinct / np.maximum(np.diff(first), 1), 1.0)


def statistics(texts: pa.Array) -> np.ndarray:
    """One row of ``FEATURES`` per text; null counts as empty."""
    data, offsets = util.text_bytes(texts)
    size = np.diff(offsets)
    n, some = len(size), np.maximum(size, 1)
    out = np.zeros((n, len(FEATURES)))
    put = lambda name, values: out.__setitem__((slice(None), FEATURES.index(name)), values)
    doc = np.repeat(np.arange(n), size)
    kind = np.zeros(256, np.uint8)
    for k, chars in enumerate(_CLASSES.values(), 1):
        kind[np.frombuffer(chars, np.uint8)] = k
    kind[128:] = len(_CLASSES) + 1
    table = np.bincount(doc * 16 + kind[data], minlength=16 * n).reshape(n, 16)
    put("log_bytes", np.log1p(size))
    for k, name in enumerate([*_CLASSES, "wide"], 1):
        put(name, table[:, k] / some)

    words, first, begins, ends = util.word_hashes(data, offsets)
    count = np.diff(first)
    many = np.maximum(count, 1)
    word_doc = np.repeat(np.arange(n), count)
    length = (ends - begins).astype(np.float64)
    mean = np.bincount(word_doc, length, n) / many
    put("log_words", np.log1p(count))
    put("word_length", mean)
    put("word_spread", np.sqrt(np.maximum(np.bincount(word_doc, length**2, n) / many - mean**2, 0)))
    longest = np.zeros(n)
    np.maximum.at(longest, word_doc, length)
    put("longest_word", np.log1p(longest))
    put("distinct_words", _share(words, first))
    same = np.zeros(len(words), bool)
    same[1:] = (words[1:] == words[:-1]) & (word_doc[1:] == word_doc[:-1])
    put("repeated_word", np.bincount(word_doc, same, n) / many)
    put("short_words", np.bincount(word_doc, length <= 3, n) / many)
    put("symbol_words", np.bincount(word_doc, np.isin(kind[data[np.minimum(ends - 1, max(len(data) - 1, 0))]], (7, 8)) if len(data) else length, n) / many)
    triples = util.shingle_hashes(words, 3)
    inside = word_doc[2:] == word_doc[:-2] if len(words) > 2 else np.zeros(0, bool)
    put("distinct_shingles", _share(triples[inside], np.concatenate(([0], np.cumsum(np.bincount(word_doc[: len(triples)][inside], minlength=n))))))

    keep = np.ones(256, bool)
    keep[[10, 13]] = False
    lines, line_first, _, _ = util.word_hashes(data, offsets, (util.SPACED[0], keep))
    put("log_lines", np.log1p(np.diff(line_first)))
    put("line_words", np.log1p(count / np.maximum(np.diff(line_first), 1)))
    put("distinct_lines", _share(lines, line_first))
    return out


@dataclass
class Forest:
    """``feature`` and ``cut`` have a row per tree and a column per inner node, ``leaf`` a column per leaf."""

    base: float
    feature: np.ndarray
    cut: np.ndarray
    leaf: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        total, depth = np.full(len(x), self.base), int(np.log2(self.leaf.shape[1]))
        rows = np.arange(len(x))
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf):
            node = np.zeros(len(x), np.int64)
            for _ in range(depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
            total += leaf[node - (2**depth - 1)]
        return 1 / (1 + np.exp(-total))


def grow(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 64, least: float = 4.0, ridge: float = 1.0) -> Forest:
    """Boosted trees with the logistic loss. Without rows, or with labels of one kind, the score is one constant."""
    ones, n = float(y.sum()), len(y)
    base = float(np.log((ones + 1) / (n - ones + 1)))
    if n == 0 or ones in (0, n):
        trees = 0
    inner = 2**depth - 1
    feature, cut, leaf = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, inner + 1))
    if not trees:
        return Forest(base, feature, cut, leaf)
    edges = [np.unique(np.quantile(column, np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for column in x.T]
    binned = np.stack([np.searchsorted(e, column, side="left") for e, column in zip(edges, x.T)])
    margin = np.full(n, base)
    for t in range(trees):
        p = 1 / (1 + np.exp(-margin))
        grad, weight = y - p, p * (1 - p)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            at = node - (2**level - 1)
            width = 2**level
            best = np.full(width, 1e-9)
            choice = np.full((width, 2), -1)
            for f in range(x.shape[1]):
                key = at * bins + binned[f]
                g = np.bincount(key, grad, width * bins).reshape(width, bins).cumsum(1)
                h = np.bincount(key, weight, width * bins).reshape(width, bins).cumsum(1)
                gr, hr = g[:, -1:] - g, h[:, -1:] - h
                gain = g**2 / (h + ridge) + gr**2 / (hr + ridge) - (g[:, -1:] ** 2) / (h[:, -1:] + ridge)
                gain[(h < least) | (hr < least)] = -1
                gain[:, len(edges[f]) :] = -1
                k = gain.argmax(1)
                found = gain[np.arange(width), k]
                better = found > best
                best[better] = found[better]
                choice[better] = np.stack([np.full(width, f), k], 1)[better]
            right = np.zeros(n, bool)
            for w in range(width):
                f, k = choice[w]
                if f >= 0:
                    feature[t, 2**level - 1 + w], cut[t, 2**level - 1 + w] = f, edges[f][k]
                    here = at == w
                    right[here] = binned[f][here] > k
            node = 2 * node + 1 + right
        at = node - inner
        leaf[t] = rate * np.bincount(at, grad, inner + 1) / (np.bincount(at, weight, inner + 1) + ridge)
        margin += leaf[t][at]
    return Forest(base, feature, cut, leaf)


def fit(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label: str = "quality", rows: int = TRAIN_ROWS) -> Forest:
    """Learn from at most ``rows`` labelled documents that are not held out; everything else is left unread.

    Ids that are labelled twice count with their smaller label; of documents with one id the largest statistics count.
    The driver receives ``rows`` short arrays.
    """
    picked = (
        labels.select(F.col(id).alias("id"), F.col(label).cast("int").alias("y"))
        .where(F.col("y").isin(0, 1) & F.col("id").isNotNull())
        .groupBy("id").agg(F.min("y").alias("y"))
        .where(~util.held_out("id"))
        .orderBy(F.xxhash64("id"), "id").limit(rows)
    )

    def run(batches):
        for batch in util.slices(batches, "text"):
            x = statistics(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(x), pa.list_(pa.float64()))], names=["id", "x"])

    texts = docs.select(F.col(id).alias("id"), F.col(text).alias("text")).join(F.broadcast(picked.select("id")), "id", "left_semi")
    seen = texts.mapInArrow(run, StructType([texts.schema["id"]]).add("x", ArrayType(DoubleType()))).groupBy("id").agg(F.max("x").alias("x"))
    found = sorted((r for r in seen.join(F.broadcast(picked), "id").select("id", "x", "y").collect()), key=lambda r: str(r["id"]))
    x = np.array([r["x"] for r in found]).reshape(-1, len(FEATURES))
    return grow(x, np.array([r["y"] for r in found], dtype=np.float64))


def scored(docs: DataFrame, forest: Forest, text: str = "text", name: str = "quality_score") -> DataFrame:
    """``docs`` with the score of each whole text in ``name`` (0 to 1); null and empty texts get the score of an empty one."""
    model = docs.sparkSession.sparkContext.broadcast(forest)
    return util.appended(docs, text, name, "double", lambda texts: pa.array(model.value.score(statistics(texts)), pa.float64()))


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted (1 from a score of 0.7 on), a row for each row of ``docs``.

    An empty table gives an empty result; without labelled rows each score is 0.5. Other columns of either table are not
    looked at, so their names don't matter.
    """
    docs = docs.select("doc_id", "text")
    out = scored(docs, fit(docs, labels), name="score")
    return out.select("doc_id", util.held_out("doc_id").alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
