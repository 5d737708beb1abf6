"""Benchmark decontamination: rare n-grams of test items find passages, Smith-Waterman alignment scores them.

The benchmark is read in blocks of bounded size; a block's n-grams and words are broadcast, so that no text is shuffled. One pass counts in
how many documents each n-gram of the items stands. The seeds of an item are its n-grams that stand in at most COMMON of all documents or are
no more frequent than its median one: at least half of those that occur, also when the whole item is in many documents. A second pass looks the seeds up; each hit gives a
diagonal, near diagonals make one window, and the window is aligned with the whole item.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tellback.llm import util

SEED_WORDS = 3
#: Shorter items say nothing: their words stand together by chance.
LEAST_WORDS = 8
THRESHOLD = 0.4
COMMON = 0.01
MATCH, MISMATCH, GAP = 2, -1, -1
#: Text bytes of the items that are broadcast at once; more items take more passes.
BLOCK_BYTES = 8 << 20
#: Cells of an alignment that numpy computes at once.
CELLS = 1 << 20


def _words(texts: pa.Array):
    """As ``util.word_hashes``, for runs of letters and digits in lower case."""
    return util.word_hashes(*util.text_bytes(pc.utf8_lower(texts)), util.LETTERS)


@dataclass
class Items:
    """Words of the items one after the other, and their seeds as sorted hashes with every (item, place) of each."""

    ids: list
    words: np.ndarray
    first: np.ndarray
    hashes: np.ndarray
    begin: np.ndarray
    item: np.ndarray
    place: np.ndarray
    bitmap: np.ndarray

    @classmethod
    def of(cls, ids: list, texts: list) -> Items:
        words, first, _, _ = _words(pa.array(texts, pa.string()))
        keep = [k for k in range(len(ids)) if first[k + 1] - first[k] >= LEAST_WORDS]
        parts = [words[first[k] : first[k + 1]] for k in keep]
        grams = [util.shingle_hashes(p, SEED_WORDS) for p in parts]
        counts = [len(g) for g in grams]
        empty = [np.zeros(0, np.uint64)]
        return cls([ids[k] for k in keep], np.concatenate(parts + empty), np.concatenate(([0], np.cumsum([len(p) for p in parts]))).astype(np.int64), *_index(np.concatenate(grams + empty), np.repeat(np.arange(len(keep)), counts), np.concatenate([np.arange(c) for c in counts] + [np.zeros(0, np.int64)])))

    def rare(self, documents: np.ndarray, total: int) -> Items:
        """Only the seeds that occur, in at most COMMON of all documents or no more than the median one of their item."""
        each = np.repeat(documents, np.diff(self.begin))
        keep = np.zeros(len(self.item), bool)
        for k in range(len(self.ids)):
            own = np.flatnonzero(self.item == k)
            own = own[each[own] > 0]
            keep[own] = each[own] <= max(np.median(each[own]) if len(own) else 0, COMMON * total)
        hashes = np.repeat(self.hashes, np.diff(self.begin))[keep]
        return Items(self.ids, self.words, self.first, *_index(hashes, self.item[keep], self.place[keep]))

    def find(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in ``grams`` that hold a seed, and the index of the seed."""
        some = np.flatnonzero(self.bitmap[(grams >> np.uint64(44)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.hashes, grams[some]), max(len(self.hashes) - 1, 0))
        hit = self.hashes[at] == grams[some] if len(self.hashes) else np.zeros(len(some), bool)
        return some[hit], at[hit]


def _index(grams: np.ndarray, item: np.ndarray, place: np.ndarray):
    order = np.argsort(grams, kind="stable")
    hashes, begin = np.unique(grams[order], return_index=True)
    bitmap = np.zeros(1 << 20, bool)
    bitmap[(hashes >> np.uint64(44)).astype(np.int64)] = True
    return hashes, np.append(begin, len(grams)), item[order], place[order], bitmap


def align(items: list[np.ndarray], windows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Best local alignment of each pair: its score as a share of a full match, and where it ends in the window.

    A row of the table per word of the item, for all pairs at once; gaps along a row are a running maximum.
    """
    rows, width = max(map(len, items)), max(map(len, windows))
    a, b = np.zeros((len(items), rows), np.uint64), np.zeros((len(items), width), np.uint64)
    for k, (x, y) in enumerate(zip(items, windows)):
        a[k, : len(x)], b[k, : len(y)] = x, y
    there, slope = b != 0, -GAP * np.arange(width, dtype=np.int32)
    above = np.zeros((len(items), width + 1), np.int32)
    best, end = np.zeros(len(items), np.int32), np.zeros(len(items), np.int64)
    for i in range(rows):
        word = a[:, i : i + 1]
        own = above[:, :-1] + np.where((b == word) & there & (word != 0), MATCH, MISMATCH)
        own = np.maximum(np.maximum(own, above[:, 1:] + GAP), 0).astype(np.int32)
        own = np.maximum.accumulate(own + slope, axis=1) - slope
        at = own.argmax(1)
        top = own[np.arange(len(items)), at]
        better = top > best
        best[better], end[better] = top[better], at[better]
        above[:, 1:] = own
    return best / (MATCH * np.array([len(x) for x in items])), end


def leaks(texts: pa.Array, items: Items, threshold: float) -> list[list[tuple]]:
    """For each text (item id, score, number of the text's word where the match ends), best first."""
    words, first, _, _ = _words(texts)
    out: list[list[tuple]] = [[] for _ in range(len(texts))]
    at, seed = items.find(util.shingle_hashes(words, SEED_WORDS))
    doc = np.searchsorted(first, at, side="right") - 1
    inside = at + SEED_WORDS <= first[doc + 1] if len(at) else np.zeros(0, bool)
    at, seed, doc = at[inside], seed[inside], doc[inside]
    many = items.begin[seed + 1] - items.begin[seed] if len(at) else np.zeros(0, np.int64)
    entry = np.repeat(items.begin[seed] if len(at) else many, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    item, doc = items.item[entry], np.repeat(doc, many)
    diagonal = np.repeat(at, many) - items.place[entry]
    order = np.lexsort((diagonal, item, doc))
    found: dict[tuple[int, int], tuple[float, int]] = {}
    held: list[tuple[int, int, int, int]] = []

    def flush():
        scores, ends = align([items.words[items.first[k] : items.first[k + 1]] for _, k, _, _ in held], [words[x:y] for _, _, x, y in held])
        for (d, k, x, _), score, end in zip(held, scores.tolist(), ends.tolist()):
            if score >= threshold and score > found.get((d, k), (0,))[0]:
                found[d, k] = score, int(x + end - first[d])
        held.clear()

    last, size = None, 0
    for d, k, g in zip(doc[order].tolist(), item[order].tolist(), diagonal[order].tolist()):
        length = int(items.first[k + 1] - items.first[k])
        slack = length // 4 + 2
        if last == (d, k) and g - start <= slack:
            continue  # the window reaches over this diagonal, too
        last, start = (d, k), g
        x, y = max(int(first[d]), g - slack), min(int(first[d + 1]), g + length + 2 * slack)
        if held and (len(held) + 1) * max(size, y - x) > CELLS:
            flush()
            size = 0
        size = max(size, y - x)
        held.append((d, k, x, y))
    if held:
        flush()
    for (d, k), (score, end) in found.items():
        out[d].append((items.ids[k], score, end))
    return [sorted(x, key=lambda r: (-r[1], r[0])) for x in out]


def _blocks(benchmark: DataFrame):
    """Items of the benchmark in blocks of about BLOCK_BYTES: (ids, texts)."""
    rows = benchmark.select(F.col("item_id").cast("long").alias("id"), F.col("text").alias("text")).where("id is not null and text is not null")
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-total // BLOCK_BYTES)
    for k in range(blocks):
        found = rows.where(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == k).distinct().orderBy("id", "text").collect()
        yield [r["id"] for r in found], [r["text"] for r in found]


def contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", name: str = "leaks", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with an array ``name`` of (item_id, score, word): the test items found in each whole text, best first.

    Items of fewer than LEAST_WORDS words and items without id or text are not searched; words are runs of letters and
    digits in lower case. Null and empty texts have no leaks, nor has any text without items. Repeated rows are judged alike.
    A text may leak any number of items; the best passage counts for each.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(text).alias("text"))
    docs, parts = docs.drop(name), []
    for k, (ids, bodies) in enumerate(_blocks(benchmark)):
        items = Items.of(ids, bodies)
        if not items.ids:
            continue
        every = spark.sparkContext.broadcast(items)

        def count(batches, every=every):
            total, rows = np.zeros(len(every.value.hashes), np.int64), 0
            for batch in util.slices(batches, "text"):
                rows += batch.num_rows
                words, first, _, _ = _words(batch.column(0))
                at, seed = every.value.find(util.shingle_hashes(words, SEED_WORDS))
                doc = np.searchsorted(first, at, side="right") - 1
                pair = np.unique((doc * len(total) + seed)[at + SEED_WORDS <= first[doc + 1]])
                total += np.bincount(pair % len(total), minlength=len(total))
            used = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(np.append(used, -1)), pa.array(np.append(total[used], rows))], names=["seed", "n"])

        counted = texts.mapInArrow(count, "seed long, n long").groupBy("seed").agg(F.sum("n").alias("n")).toArrow()
        documents = np.zeros(len(items.hashes) + 1, np.int64)  # at -1 all documents
        documents[counted["seed"].to_numpy()] = counted["n"].to_numpy()
        rare = spark.sparkContext.broadcast(items.rare(documents[:-1], int(documents[-1])))
        kind = pa.list_(pa.struct([("item_id", pa.int64()), ("score", pa.float64()), ("word", pa.int64())]))

        def judge(values, rare=rare):
            found = leaks(values, rare.value, threshold)
            return pa.array([[dict(zip(("item_id", "score", "word"), r)) for r in x] for x in found], kind)

        parts.append(f"{name}_{k}")
        docs = util.appended(docs, text, parts[-1], "array<struct<item_id:bigint,score:double,word:bigint>>", judge)
    if not parts:
        return docs.withColumn(name, F.expr("cast(array() as array<struct<item_id:bigint,score:double,word:bigint>>)"))
    best = F.array_sort(F.concat(*parts), lambda x, y: F.when(x["score"] > y["score"], -1).when(x["score"] < y["score"], 1).when(x["item_id"] < y["item_id"], -1).when(x["item_id"] > y["item_id"], 1).otherwise(0))
    return docs.withColumn(name, best).drop(*parts)


def leaked(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, score and word (number of the word where the match ends) for each document with a test item in it."""
    found = contaminated(docs.select("doc_id", "text"), benchmark)
    return found.select("doc_id", F.explode("leaks").alias("leak")).select("doc_id", "leak.*")
