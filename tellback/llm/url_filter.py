"""URL rules for hosts with their subdomains and path prefixes.

A rule is a canonical URL (host and start of the path) with an action. Every URL gives the keys that a rule for it can have: each of its
host's suffixes with each prefix of its path that is as long as some rule's. A blocked Bloom filter of the listed keys, one 512-bit block per
key, passes possible hits; a hash join with the exact list removes false ones, and the longest rule left decides.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tellback.llm import util

#: Filter size: 16 bits per listed key, but never more than this many blocks of 64 bytes (64 MB).
MAX_BLOCKS = 1 << 20
PROBES = 6
#: The list is broadcast for the exact join up to this many bytes of keys; beyond, the join is a shuffle with the list in SALTS copies.
BROADCAST_BYTES = 8 << 20
SALTS = 16


def host_of(url: Column) -> Column:
    """What stands between the first ``://`` and the next ``/``, ``?``, ``#`` or end, A-Z in lower case; else empty."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^(?:(?!://).)*://([^/?#]*)", 1), F.lit("")), upper, lower)


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^(?:(?!://).)*://[^/?#]*([^?#]*)", 1), F.lit(""))


class BlockedBloom:
    """Blocks of eight 64-bit words; the upper half of a key's hash picks the block, the lower half its bits."""

    def __init__(self, blocks: int):
        self.words = np.zeros((blocks, 8), np.uint64)

    def _places(self, hashes: np.ndarray):
        h = util.mix(hashes.view(np.uint64))
        block = ((h >> np.uint64(32)) * np.uint64(len(self.words))) >> np.uint64(32)
        for k in range(PROBES):
            bit = (h * np.uint64(0x9E3779B97F4A7C15 + 2 * k * 0x6A09E667F3BCC909 & (1 << 64) - 1 | 1)) >> np.uint64(55)
            yield block.astype(np.int64), (bit >> np.uint64(6)).astype(np.int64), np.uint64(1) << (bit & np.uint64(63))

    def add(self, hashes: np.ndarray) -> None:
        for block, word, bit in self._places(hashes):
            np.bitwise_or.at(self.words, (block, word), bit)

    def may_have(self, hashes: np.ndarray) -> np.ndarray:
        out = np.ones(len(hashes), bool)
        for block, word, bit in self._places(hashes):
            out &= (self.words[block, word] & bit) != 0
        return out


def build_filter(listed: DataFrame, rows: int) -> BlockedBloom:
    """Filter of the column ``key``. Tasks set the bits of their keys, Spark joins the words by OR; the driver gets the bounded filter."""
    blocks = max(1, min(MAX_BLOCKS, -(-rows * 16 // 512)))

    def run(batches):
        own = BlockedBloom(blocks)
        for batch in batches:
            own.add(batch.column(0).to_numpy(zero_copy_only=False))
        at = np.flatnonzero(own.words)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(own.words.reshape(-1)[at].view(np.int64))], names=["word", "bits"])

    found = listed.select(F.xxhash64("key")).mapInArrow(run, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = BlockedBloom(blocks)
    out.words.reshape(-1)[found["word"].to_numpy()] = found["bits"].to_numpy().view(np.uint64)
    return out


def filtered(pages: DataFrame, rules: DataFrame, default: str = "allow", id: str = "page_id", url: str = "url") -> DataFrame:
    """id, host, path, rule and verdict, a row for each row of ``pages``.

    ``rules`` has host, path and action; of rules with one host and path the smallest action counts, rules without a host are
    dropped. A URL that no rule fits has a null rule and the verdict ``default``. Null URLs and those without ``://`` have an empty host and path and fit no
    rule. Among fitting rules of one length the one with the longer host wins. Repeated rows come back as often as they stand there. Other columns
    are not looked at.
    """
    spark = pages.sparkSession
    listed = (
        rules.select(F.translate(F.col("host"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz").alias("rule_host"), F.coalesce("path", F.lit("")).alias("rule_path"), "action")
        .where("rule_host != ''")
        .groupBy("rule_host", "rule_path").agg(F.min("action").alias("action"))
        .withColumn("key", F.concat("rule_host", F.lit("\n"), "rule_path"))
    )
    listed = util.stored(listed, "rules")
    size = listed.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("key") + 40), F.lit(0)).alias("bytes"), F.collect_set(F.length("rule_path")).alias("lengths")).first()
    bloom = spark.sparkContext.broadcast(build_filter(listed, size["n"]))

    # repeated rows are counted and judged once; the count brings them back
    rows = pages.select(F.col(id).alias("id"), F.col(url).alias("url")).groupBy("id", "url").agg(F.count("*").alias("repeats"))
    rows = rows.select("id", "url", "repeats", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    labels = F.split("host", r"\.", -1)
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    lengths = F.filter(F.array(*[F.lit(n) for n in sorted(size["lengths"])]).cast("array<int>"), lambda n: n <= F.length("path"))
    keys = F.flatten(F.transform(suffixes, lambda h: F.transform(lengths, lambda n: F.concat(h, F.lit("\n"), F.substring(F.col("path"), F.lit(1), n)))))
    rows = rows.withColumn("keys", F.when(F.col("host") != "", keys).otherwise(F.array().cast("array<string>")))
    rows = rows.withColumn("hashes", F.transform("keys", lambda k: F.xxhash64(k)))

    @F.pandas_udf("array<boolean>")
    def possible(hashes):
        counts = hashes.map(len).to_numpy()
        flat = np.concatenate([*hashes, np.zeros(0, np.int64)]).astype(np.int64)
        return type(hashes)(np.split(bloom.value.may_have(flat), np.cumsum(counts)[:-1]) if len(counts) else [])

    rows = rows.withColumn("pass", possible("hashes"))
    hits = F.filter(F.arrays_zip("keys", "pass"), lambda x: x["pass"])
    rows = rows.select("id", "url", "repeats", "host", "path", F.explode_outer(F.transform(hits, lambda x: x["keys"])).alias("key"))
    if size["bytes"] <= BROADCAST_BYTES:
        joined = rows.join(F.broadcast(listed), "key", "left")
    else:  # one host may have a third of all rows: its key is dealt to SALTS tasks
        salted = listed.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = rows.withColumn("salt", F.pmod(F.xxhash64("id", "url"), F.lit(SALTS)).cast("int")).join(salted, ["key", "salt"], "left")
    rule = F.when(F.col("rule_host").isNotNull(), F.struct((F.length("rule_host") + F.length("rule_path")).alias("n"), F.length("rule_host").alias("h"), F.concat("rule_host", "rule_path").alias("rule"), "action"))
    judged = joined.groupBy("id", "url").agg(F.first("repeats").alias("repeats"), F.first("host").alias("host"), F.first("path").alias("path"), F.max(rule).alias("best"))
    # a row for each repeat
    return judged.withColumn("_", F.explode(F.sequence(F.lit(1).cast("long"), F.col("repeats")))).select(
        F.col("id").alias(id), "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.action", F.lit(default)).alias("verdict")
    )
