"""Language of whole texts: multinomial naive Bayes over hashed character n-grams.

Counts of n-grams per language come from all learnt documents; they are summed by Spark. The model is a matrix of log
probabilities, one row per bucket, and goes to the executors as a broadcast of fixed size. A batch of texts is scored as a
sparse product: rows of the matrix are gathered for the n-grams and added up per document.
"""

from __future__ import annotations

import sys
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tellback.llm import util

BUCKET_BITS = 16
#: The model may take so many bytes; 1,000 languages need 524 MB with the usual buckets.
MODEL_BYTES = 1 << 29
UNKNOWN = "und"

_tables: dict[str, np.ndarray] = {}


def _letters() -> np.ndarray:
    if "letters" not in _tables:
        _tables["letters"] = np.fromiter((chr(c).isalpha() for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)
    return _tables["letters"]


def ngrams(texts: pa.Array, bits: int = BUCKET_BITS) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the 1- to 3-grams of all texts, ordered by text, and the number of them per text.

    Texts are in lower case and have one blank before and behind each run of letters; whatever is no letter is a blank.
    """
    parts = [(t or "").lower() for t in texts.to_pylist()]
    sizes = np.array([len(p) + 2 for p in parts], dtype=np.int64)
    code = np.frombuffer(("\0" + "\0\0".join(parts) + "\0").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    code *= _letters()[code]
    doc = np.repeat(np.arange(len(parts)), sizes)
    # runs of blanks shrink to one, so that no n-gram reaches from one text into the next
    keep = np.ones(len(code), bool)
    keep[1:] = (code[1:] != 0) | (code[:-1] != 0) | (doc[1:] != doc[:-1])
    code, doc = code[keep], doc[keep]
    some, shift = code != 0, np.uint64(64 - bits)
    spread = lambda x, k: ((x * np.uint64(0x9E3779B97F4A7C15) + np.uint64(k * 0x632BE59BD9B4E019 % 2**64)) * np.uint64(0xD6E8FEB86659FD93)) >> shift
    at1 = np.flatnonzero(some)
    pair = code[:-1] << np.uint64(21) | code[1:]
    at2 = np.flatnonzero((some[:-1] | some[1:]) & (doc[:-1] == doc[1:]))
    at3 = np.flatnonzero(some[1:-1] | (some[:-2] & some[2:])) if len(code) > 2 else at1[:0]
    at3 = at3[doc[at3] == doc[at3 + 2]]
    buckets = [spread(code[at1], 1), spread(pair[at2], 2), spread(pair[at3] << np.uint64(21) | code[at3 + 2], 3)]
    return buckets, [np.bincount(doc[at], minlength=len(parts)) for at in (at1, at2, at3)]


@dataclass
class Model:
    langs: list[str]
    prior: np.ndarray
    weight: np.ndarray

    def judge(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        """The likeliest language (the first by name among equals) and its posterior probability."""
        n = len(texts)
        buckets, counts = ngrams(texts)
        letters = counts[0] > 0
        if not self.langs:
            return [UNKNOWN] * n, np.zeros(n)
        total = np.tile(self.prior, (n, 1))
        for own, count in zip(buckets, counts):
            ends = np.cumsum(count)
            full = np.flatnonzero(count)
            for k in range(len(self.langs)):
                if len(full):
                    total[full, k] += np.add.reduceat(self.weight[k][own], (ends - count)[full])
        best = total.argmax(1)
        score = 1 / np.exp(total - total.max(1, keepdims=True)).sum(1)
        return [self.langs[b] if some else UNKNOWN for b, some in zip(best, letters)], np.where(letters, score, 0.0)


def fit(docs: DataFrame, text: str = "text", lang: str = "lang") -> Model:
    """Count the n-grams of all rows with a language. The driver receives one number per bucket and language."""

    def run(batches):
        held: dict[str, np.ndarray] = {}
        rows: dict[str, int] = {}
        for batch in util.slices(batches, "text"):
            names = batch.column(1).to_pylist()
            buckets, counts = ngrams(batch.column(0))
            langs = sorted(set(names))
            of = np.array([langs.index(x) for x in names])
            sums = np.zeros((len(langs), 1 << BUCKET_BITS), np.int64)
            for own, count in zip(buckets, counts):
                key = (np.repeat(of, count) << BUCKET_BITS) | own.astype(np.int64)
                sums += np.bincount(key, minlength=sums.size).reshape(sums.shape)
            for k, name in enumerate(langs):
                held[name] = held[name] + sums[k] if name in held else sums[k]
                rows[name] = rows.get(name, 0) + names.count(name)
        for name, row in held.items():
            at = np.flatnonzero(row)
            keys, numbers = np.append(at, -1).astype(np.int32), np.append(row[at], rows[name])
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(keys), pa.string()), pa.array(keys), pa.array(numbers)], names=["lang", "bucket", "n"])

    learnt = docs.select(F.col(text).alias("text"), F.col(lang).alias("lang")).where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    found = learnt.mapInArrow(run, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    found = util.stored(found, "language-counts")
    langs = [r["lang"] for r in found.where("bucket = -1").orderBy("lang").collect()]
    if len(langs) << (BUCKET_BITS + 3) > MODEL_BYTES:
        raise ValueError(f"{len(langs)} languages don't fit in a model of {MODEL_BYTES} bytes; use fewer buckets")
    counts, prior = np.zeros((len(langs), 1 << BUCKET_BITS)), np.zeros(len(langs))
    place = {x: k for k, x in enumerate(langs)}
    rows = found.toArrow()
    of = np.array([place[x] for x in rows["lang"].to_pylist()], dtype=np.int64)
    bucket, n = rows["bucket"].to_numpy(), rows["n"].to_numpy()
    is_rows = bucket < 0
    prior[of[is_rows]] = n[is_rows]
    counts[of[~is_rows], bucket[~is_rows]] = n[~is_rows]
    counts += 0.5
    return Model(langs, np.log(prior / max(prior.sum(), 1)) if langs else prior, np.log(counts / counts.sum(1, keepdims=True)))


def judged(docs: DataFrame, model: Model, text: str = "text", name: str = "language") -> DataFrame:
    """``docs`` with a struct of lang and score in ``name``. Null texts and texts without letters: ``und`` with score 0."""
    known = docs.sparkSession.sparkContext.broadcast(model)

    def judge(texts: pa.Array) -> pa.Array:
        langs, score = known.value.judge(texts)
        return pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(score, pa.float64())], ["lang", "score"])

    return util.appended(docs, text, name, "struct<lang:string,score:double>", judge)


def language_id(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score, a row for each row of ``docs``; held-out rows are not learnt from.

    Without any learnt row all texts are ``und``. Other columns are not looked at.
    """
    docs = docs.select("doc_id", "text", "lang")
    out = judged(docs.select("doc_id", "text"), fit(docs.where(~util.held_out("doc_id"))))
    return out.select("doc_id", util.held_out("doc_id").alias("held_out"), F.col("language.lang").alias("lang_pred"), F.col("language.score").alias("score"))
