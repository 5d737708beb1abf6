"""Jaccard self-join of shingle sets by parity sketches, and the groups of documents that its links form.

The hash of each shingle is XORed into one cell of a sketch. A shingle that two documents share cancels out, so two sketches
differ in at most as many cells as the symmetric difference has shingles. A link needs a symmetric difference of at most a
seventh of both sizes together (at a similarity of 0.75), and so leaves cells untouched that are the same in both.

* Documents with one set of shingles are one node; nodes are named by a hash of their set.
* Sizes are in bands of factor two; a node stands in its own band and, near the upper end, in the next one too, so that all
  sizes that can link meet in a band. A band has enough cells that a pair at the threshold shares at least ``SHARED``
  non-empty cells on average; the chance to share ``SPARE`` or fewer is below 1e-9, like that of equal hashes.
* Below 64 shingles each shingle is a cell of its own, and a node enters with the cells that fewest nodes have, so many that
  linked nodes share ``SPARE_SMALL`` + 1 of them: this pigeonhole never misses, and common lines do not gather nodes.
* Nodes meet by an equi join on (band, cell, value). Cells that at most ``FEW`` nodes share give all their pairs; in
  larger ones each node meets the first. A large cell whose nodes are in one group by then is done, and a node with no more than
  ``SPARE`` others has met each partner in a smaller cell. What is left are dense groups of copies that differ in more than a
  link allows; their blocks, which go by size, are compared on the whole sets, each pair of blocks whose sizes allow a link in a task
  that yields only links between different groups.
* Bit sketches (one bit per shingle, XORed) give a lower bound of the symmetric difference and discard most false pairs; the
  rest is verified on the whole sets. Groups come from ``groups.components``.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tellback.llm import util
from tellback.llm.groups import components

SHINGLE = 5
#: A link: PART * intersection >= WHOLE_PART * union, here 0.75.
SIMILAR, OF = 75, 100
SMALL = 64
#: Largest size that can link with one below SMALL.
SMALL_TOP = (SMALL - 1) * OF // SIMILAR
SHARED = 45
SPARE, SPARE_SMALL = 8, 2
FEW = 32
#: Nodes of a block, and shingles of all its nodes.
BLOCK, BLOCK_SHINGLES = 512, 1 << 18
#: Bits of the filter in front of the exact join with candidates.
SIEVE_BITS = 24


def most_apart(both: int | np.ndarray):
    """Largest symmetric difference of two linked sets with ``both`` members in all."""
    return both * (OF - SIMILAR) // (OF + SIMILAR)


@functools.cache
def cells(band: int) -> int:
    """Number of cells for sizes from 2**band to 2**(band + 1)."""
    low, high = 1 << band, (2 << band) - 1

    def shared(both: int, k: int) -> float:
        apart = most_apart(both)
        return k * (1 - 1 / k) ** apart * (1 - (1 - 1 / k) ** ((both - apart) / 2))

    k = 8
    while min(shared(both, k) for both in (low + low * SIMILAR // OF, 2 * low, 2 * high)) < SHARED:
        k = math.ceil(k * 1.05)
    return k


def cell_keys(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Keys of all non-empty cells, and the index of the set of each. Sets that only link with small ones have none."""
    owner, band = [], []
    for k, s in enumerate(sets):
        own = len(s).bit_length() - 1
        if len(s) >= SMALL:
            owner.append(k)
            band.append(own)
        if len(s) * OF >= (2 << own) * SIMILAR and 2 << own >= SMALL:
            owner.append(k)
            band.append(own + 1)
    if not owner:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    values = np.concatenate([sets[k] for k in owner])
    entry = np.repeat(np.arange(len(owner)), [len(sets[k]) for k in owner])
    count = np.array([cells(b) for b in band], np.uint64)
    cell = (util.mix(values ^ np.uint64(0x5851F42D4C957F2D)) >> np.uint64(20)) % count[entry]
    place = (entry.astype(np.uint64) << np.uint64(36)) | cell
    order = np.argsort(place, kind="stable")
    place, values = place[order], values[order]
    first = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
    entry = (place[first] >> np.uint64(36)).astype(np.int64)
    tag = np.array(band, np.uint64)[entry] << np.uint64(48) | place[first] & np.uint64((1 << 36) - 1)
    keys = util.mix(np.bitwise_xor.reduceat(values, first) ^ util.mix(tag)) & ~np.uint64(1)  # even: large sets
    return keys.view(np.int64), np.array(owner)[entry]


def bit_sketch(values: np.ndarray) -> bytes:
    """One bit per shingle, XORed; at least two bits of room for each. Halves can be folded onto each other."""
    bits = max(64, 1 << (2 * len(values) - 1).bit_length()) if len(values) else 64
    at = (values & np.uint64(bits - 1)).astype(np.int64)
    return np.packbits(np.bincount(at, minlength=bits).astype(np.uint8) & 1).tobytes()


def folded(sketch: np.ndarray, size: int) -> np.ndarray:
    """A sketch of bytes brought to ``size`` bytes; sizes are powers of two."""
    while len(sketch) > size:
        sketch = sketch[: len(sketch) // 2] ^ sketch[len(sketch) // 2 :]
    return sketch


def may_link(n: int, a: bytes, m: int, b: bytes) -> bool:
    """Whether the sizes and the sketches allow a link."""
    if min(n, m) * OF < max(n, m) * SIMILAR:
        return False
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    size = min(len(x), len(y))
    return int(np.bitwise_count(folded(x, size) ^ folded(y, size)).sum()) <= most_apart(n + m)


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return OF * both >= SIMILAR * (len(a) + len(b) - both)


def node(values: np.ndarray) -> int:
    """Name of a set."""
    return int(util.mix(np.array([np.bitwise_xor.reduce(util.mix(values ^ np.uint64(0xA0761D6478BD642F)))], np.uint64) + np.uint64(len(values))).view(np.int64)[0])


def described(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, node (null for empty sets) and the shingles of small sets, a row for each row."""

    def run(batches):
        for batch in util.slices(batches, "text"):
            sets = util.shingle_sets(batch.column(1), SHINGLE)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([node(s) if len(s) else None for s in sets], pa.int64()),
                    pa.array([s.view(np.int64) if 0 < len(s) <= SMALL_TOP else None for s in sets], pa.list_(pa.int64())),
                ],
                names=["doc_id", "n_shingles", "node", "small"],
            )

    rows = docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_shingles long, node long, small array<long>")


def _large_keys(docs: DataFrame, text: str) -> DataFrame:
    def run(batches):
        seen: set[int] = set()  # nodes of this task
        for batch in util.slices(batches, "text"):
            sets, names = [], []
            for s in util.shingle_sets(batch.column(0), SHINGLE):
                if len(s) * OF >= SMALL * SIMILAR and (name := node(s)) not in seen:
                    seen.add(name)
                    sets.append(s)
                    names.append(name)
            keys, owner = cell_keys(sets)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.array(names, np.int64)[owner])], names=["key", "node"])

    return docs.select(F.col(text).alias("text")).mapInArrow(run, "key long, node long")


def _small_keys(rows: DataFrame) -> DataFrame:
    """The rarest shingles of each small set, SPARE_SMALL + 1 more than a linked set can lack. Sets of one or two link with no other."""
    single = rows.where(F.size("small") > 2).groupBy("node").agg(F.max("small").alias("small")).select("node", F.explode("small").alias("key"))
    counts = single.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    rare = single.join(counts, "key", "left").groupBy("node").agg(F.sort_array(F.collect_list(F.struct(F.coalesce("n", F.lit(1)).alias("n"), "key"))).alias("all"))
    picked = F.slice("all", 1, F.floor(F.size("all") * (OF - SIMILAR) / OF).cast("int") + 1 + SPARE_SMALL)
    return rare.select("node", F.explode(F.filter(picked, lambda x: x["n"] > 1)).alias("x")).select(F.xxhash64("x.key", F.lit("small")).bitwiseOR(F.lit(1)).alias("key"), "node")


def _meet(keys: DataFrame) -> DataFrame:
    """Rows (large false, a, b) of pairs that share a cell, and (large true, key, node) for cells of more than FEW nodes."""

    def run(batches):
        carry_key = carry = np.zeros(0, np.int64)
        wide: tuple[int, int] | None = None  # key and first node of a large cell that may go on

        def made(pairs: list, members: list):
            a, b = (np.concatenate([p[k] for p in pairs]) if pairs else np.zeros(0, np.int64) for k in (0, 1))
            a, b = np.minimum(a, b), np.maximum(a, b)
            order = np.lexsort((b, a))
            a, b = a[order], b[order]
            new = np.ones(len(a), bool)
            new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
            a, b = a[new], b[new]
            c, d = (np.concatenate([m[k] for m in members]) if members else np.zeros(0, np.int64) for k in (0, 1))
            flag = np.repeat([False, True], [len(a), len(c)])
            return pa.RecordBatch.from_arrays([pa.array(flag), pa.array(np.concatenate((a, c))), pa.array(np.concatenate((b, d)))], names=["large", "a", "b"])

        def work(key: np.ndarray, name: np.ndarray, last: bool):
            """Sorted rows without repeats; the last cell waits for more rows unless ``last``."""
            nonlocal wide, carry_key, carry
            pairs, members = [], []
            if wide is not None:
                stop = int(np.searchsorted(key, wide[0], side="right"))
                if stop:
                    fresh = name[:stop][name[:stop] != wide[1]]
                    pairs.append((np.full(len(fresh), wide[1]), fresh))
                    members.append((np.full(len(fresh), wide[0]), fresh))
                    key, name = key[stop:], name[stop:]
                if len(key):
                    wide = None
            if not len(key):
                carry_key, carry = key, name
                return made(pairs, members)
            first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
            size = np.diff(np.append(first, len(key)))
            end = len(key)
            if not last and size[-1] <= FEW:
                end = int(first[-1])
                first, size = first[:-1], size[:-1]
            elif not last:
                wide = int(key[-1]), int(name[first[-1]])
            carry_key, carry = key[end:], name[end:]
            key, name = key[:end], name[:end]
            of = np.repeat(size, size)
            for step in range(1, FEW):
                same = np.flatnonzero((key[step:] == key[:-step]) & (of[step:] <= FEW)) if len(key) > step else []
                if not len(same):
                    break
                pairs.append((name[same], name[same + step]))
            lead = np.repeat(name[first], size)
            big = of > FEW
            members.append((key[big], name[big]))
            big &= name != lead
            pairs.append((lead[big], name[big]))
            return made(pairs, members)

        before = (None, None)
        for batch in batches:
            key, name = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            if not len(key):
                continue
            new = np.ones(len(key), bool)
            new[1:] = (key[1:] != key[:-1]) | (name[1:] != name[:-1])
            new[0] = (int(key[0]), int(name[0])) != before
            before = int(key[-1]), int(name[-1])
            yield work(np.concatenate((carry_key, key[new])), np.concatenate((carry, name[new])), False)
        if len(carry):
            yield work(carry_key, carry, True)

    return keys.repartition("key").sortWithinPartitions("key", "node").mapInArrow(run, "large boolean, a long, b long")


def _sieve(values: DataFrame, name: str) -> Broadcast:
    """A filter of fixed size that lets all values of a long column through, and few others."""
    words = 1 << (SIEVE_BITS - 6)
    bits = values.groupBy(F.expr(f"shiftrightunsigned({name}, 6) & {words - 1}").alias("word")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast({name} & 63 as int))")).alias("bits")).toArrow()
    table = np.zeros(words, np.int64)
    table[bits["word"].to_numpy()] = bits["bits"].to_numpy()
    return values.sparkSession.sparkContext.broadcast(table.view(np.uint64))


def _in_sieve(table: np.ndarray, values: np.ndarray) -> np.ndarray:
    bits = values.view(np.uint64)
    return (table[bits >> np.uint64(6) & np.uint64(len(table) - 1)] >> (bits & np.uint64(63)) & np.uint64(1)).astype(bool)


def _contents(docs: DataFrame, text: str, wanted: DataFrame) -> DataFrame:
    """node, n, sketch and set of the nodes in ``wanted``. A filter of fixed size keeps most others out of the exact join."""
    shared = _sieve(wanted, "node")

    def run(batches):
        seen: set[int] = set()
        for batch in util.slices(batches, "text"):
            rows = []
            for s in util.shingle_sets(batch.column(0), SHINGLE):
                if not len(s) or (name := node(s)) in seen:
                    continue
                seen.add(name)
                if _in_sieve(shared.value, np.array([name]))[0]:
                    rows.append((name, len(s), bit_sketch(s), s.tobytes()))
            kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=["node", "n", "sketch", "set"])

    found = docs.select(F.col(text).alias("text")).mapInArrow(run, "node long, n long, sketch binary, set binary")
    return util.stored(found.join(wanted, "node", "left_semi").dropDuplicates(["node"]), "sets")


def _checked(pairs: DataFrame, contents: DataFrame, columns: list[str], kept) -> DataFrame:
    """Pairs (a, b) for which ``kept(row of a, row of b)`` holds; both rows have ``columns`` of ``contents``."""
    both = pairs
    for side in ("a", "b"):
        both = both.join(contents.select(F.col("node").alias(side), F.struct(*columns).alias(f"of_{side}")), side)

    def run(batches):
        for batch in util.slices(batches, "weight", 1 << 25):
            x, y = (batch.column(batch.schema.get_field_index(k)) for k in ("of_a", "of_b"))
            left, right = ([x.field(k) for k in range(len(columns))], [y.field(k) for k in range(len(columns))])
            keep = [kept([v[i].as_py() for v in left], [v[i].as_py() for v in right]) for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.select("a", "b", "of_a", "of_b", F.col(f"of_a.{columns[-1]}").alias("weight")).mapInArrow(run, "a long, b long")


def _near(pairs: DataFrame, contents: DataFrame) -> DataFrame:
    return _checked(pairs, contents, ["n", "sketch"], lambda x, y: may_link(x[0], x[1], y[0], y[1]))


def _verified(pairs: DataFrame, contents: DataFrame) -> DataFrame:
    return _checked(pairs, contents, ["set"], lambda x, y: linked(np.frombuffer(x[0], np.uint64), np.frombuffer(y[0], np.uint64)))


def _apart(pairs: DataFrame, groups: DataFrame) -> DataFrame:
    """Pairs whose nodes are in different groups so far."""
    for side in ("a", "b"):
        pairs = pairs.join(groups.select(F.col("node").alias(side), F.col("root").alias(f"root_{side}")), side, "left").withColumn(f"root_{side}", F.coalesce(f"root_{side}", side))
    return pairs.where("root_a != root_b").select("a", "b")


def _open_cells(held: DataFrame) -> DataFrame:
    """Keys of cells whose nodes are in different groups. The rows (node, root, keys) of a batch are added up by key before they are dealt."""

    def run(batches):
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            keys, count = _flat(rows["keys"])
            root = np.repeat(rows["root"].to_numpy(), count)
            order = np.lexsort((root, keys))
            keys, root = keys[order], root[order]
            first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
            last = np.append(first[1:], len(keys)) - 1 if len(keys) else first
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (keys[first], root[first], root[last])], names=["key", "low", "high"])

    found = held.mapInArrow(run, "key long, low long, high long")
    return found.groupBy("key").agg(F.min("low").alias("low"), F.max("high").alias("high")).where("low != high").select("key")


def _flat(lists: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All values of the lists one after the other, and how many each has."""
    whole = lists.combine_chunks()
    return whole.flatten().to_numpy(zero_copy_only=False), pc.list_value_length(whole).to_numpy(zero_copy_only=False)


def _busy(held: DataFrame, cells: DataFrame) -> DataFrame:
    """Nodes with more than the spare number of ``cells``, and these. A filter of fixed size may leave others too, which only adds comparisons."""
    shared = _sieve(cells, "key")

    def run(batches):
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            keys, count = _flat(rows["keys"])
            at = np.repeat(np.arange(len(count)), count)
            keep = _in_sieve(shared.value, keys)
            keys, at = keys[keep], at[keep]
            small = np.bincount(at, weights=keys & 1, minlength=len(count))
            large = np.bincount(at, minlength=len(count)) - small
            busy = (small > SPARE_SMALL) | (large > SPARE)
            count = (small + large)[busy].astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(count))), pa.int32()), pa.array(keys[busy[at]], pa.int64()))
            yield pa.RecordBatch.from_arrays([*(pa.array(rows[x].to_numpy()[busy]) for x in ("node", "root")), lists], names=["node", "root", "keys"])

    return held.mapInArrow(run, "node long, root long, keys array<long>")


def _cell_links(held: DataFrame) -> DataFrame:
    """Pairs of cells that share nodes, enough of them to join all that do: for a batch each cell and the smallest one that it is joined with there."""

    def run(batches):
        for batch in batches:
            keys, count = _flat(pa.Table.from_batches([batch])["keys"])
            cell, at = np.unique(keys, return_inverse=True)
            begin = np.cumsum(count) - count
            least, before = np.arange(len(cell)), None
            while not np.array_equal(least, before):
                before = least.copy()
                np.minimum.at(least, at, np.repeat(np.minimum.reduceat(least[at], begin) if len(begin) else begin, count))
                least = least[least]
            joined = least != np.arange(len(cell))
            yield pa.RecordBatch.from_arrays([pa.array(cell[least[joined]]), pa.array(cell[joined])], names=["a", "b"])

    return held.mapInArrow(run, "a long, b long")


def _block_pairs(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The nodes (cluster, node, root, n) with a block, and the pairs (cluster, i, j) of blocks whose sizes allow a link.

    The blocks of a cluster go by size, so that a node only meets blocks of about its own size.
    """
    weight = F.greatest(F.lit(1 / BLOCK), F.col("n") / F.lit(BLOCK_SHINGLES))
    up = Window.partitionBy("cluster").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    # rows of the window are sizes, of which a cluster has few
    sizes = nodes.groupBy("cluster", "n").agg(F.count("*").alias("many")).withColumn("before", F.coalesce(F.sum(F.col("many") * weight).over(up), F.lit(0.0)))
    place = F.col("before") + weight * F.pmod(F.xxhash64("node", F.lit("block")), F.col("many"))
    blocks = util.stored(nodes.join(sizes, ["cluster", "n"]).select("cluster", "node", "root", "n", F.floor(place).cast("int").alias("block")), "blocks")
    ranges = util.stored(blocks.groupBy("cluster", "block").agg(F.min("n").alias("low"), F.max("n").alias("high")), "ranges")
    other = ranges.select("cluster", F.col("block").alias("j"), F.col("low").alias("low_j"))
    may = (F.col("i") == F.col("j")) | (F.col("i") < F.col("j")) & (F.col("high") * OF >= F.col("low_j") * SIMILAR)
    return blocks, ranges.select("cluster", F.col("block").alias("i"), "high").join(other, "cluster").where(may).select("cluster", "i", "j")


def _in_blocks(members: DataFrame, groups: DataFrame, contents: DataFrame) -> DataFrame:
    """Links between groups within large cells (key, node), enough of them to join what belongs together."""
    # one row for a node and all its cells, which its text bounds: no join or row for each (cell, node) from here on
    held = members.groupBy("node").agg(F.collect_list("key").alias("keys")).join(groups, "node", "left").select("node", F.coalesce("root", "node").alias("root"), "keys")
    held = util.stored(held, "held")
    for _ in range(3):  # each time fewer nodes make more cells be done
        held = util.stored(_busy(held, _open_cells(held)), "open")
    # cells that share nodes make one cluster, so that no pair is looked at twice
    cluster = components(_cell_links(held)).select(F.col("node").alias("key"), F.col("root").alias("cluster"))
    nodes = held.select("node", "root", F.array_min("keys").alias("key")).join(cluster, "key", "left").select("node", "root", F.coalesce("cluster", "key").alias("cluster"))
    blocks, pairs = _block_pairs(nodes.join(contents.select("node", "n"), "node"))
    tasks = pairs.select("cluster", "i", "j", F.explode(F.array_distinct(F.array("i", "j"))).alias("block"))
    tasks = tasks.groupBy("cluster", "block").agg(F.collect_list(F.struct("i", "j")).alias("tasks"))
    dealt = (
        blocks.join(tasks, ["cluster", "block"])
        .join(contents.select("node", "set"), "node")
        .withColumn("task", F.explode("tasks"))
        .select("cluster", "task.i", "task.j", "block", "node", "root", "set")
    )

    def run(table: pa.Table) -> pa.Table:
        a, b = forest(table["block"].to_numpy(), table["node"].to_numpy(), table["root"].to_numpy(), [np.frombuffer(x, np.uint64) for x in table["set"].to_pylist()])
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return dealt.groupBy("cluster", "i", "j").applyInArrow(run, "a long, b long")


def forest(block: np.ndarray, name: np.ndarray, root: np.ndarray, sets: list[np.ndarray]) -> tuple[list[int], list[int]]:
    """Links between the nodes of two blocks (or within one) that join different groups; each joins two groups at most once.

    A list of nodes per shingle gives the intersections of a node with all others in one count.
    """
    _, group = np.unique(root, return_inverse=True)
    size = np.array([len(s) for s in sets])
    order = np.argsort(np.concatenate(sets), kind="stable")
    owner = np.repeat(np.arange(len(sets)), size)[order]
    _, shingle = np.unique(np.concatenate(sets), return_inverse=True)
    begin = np.concatenate(([0], np.cumsum(np.bincount(shingle))))
    ends = np.cumsum(size)
    both = block.min() != block.max()
    out: tuple[list[int], list[int]] = ([], [])
    for k in np.flatnonzero(block == block.min()):
        if (group == group[0]).all():
            break
        own = shingle[ends[k] - size[k] : ends[k]]
        count = begin[own + 1] - begin[own]
        at = np.repeat(begin[own] - (np.cumsum(count) - count), count) + np.arange(count.sum())
        shared = np.bincount(owner[at], minlength=len(sets))
        found = (OF * shared >= SIMILAR * (size + size[k] - shared)) & (group != group[k])
        if both:
            found &= block != block[k]
        for j in np.flatnonzero(found):
            if group[j] != group[k]:
                out[0].append(int(min(name[k], name[j])))
                out[1].append(int(max(name[k], name[j])))
                group[group == group[j]] = group[k]
    return out


def similar_groups(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest id reachable by links), a row for each row of ``docs``.

    Null, empty and blank texts have no shingles and link with nothing. Repeated rows are one node and come back as often as
    they stand there. Unknown ids never are a component id unless all of the group are unknown. Other columns are not looked at.
    """
    rows = util.stored(described(docs, id, text), "described")
    met = util.stored(_meet(_large_keys(docs, text).union(_small_keys(rows))), "cells")
    pairs = met.where("not large").select("a", "b").distinct()
    members = met.where("large").select(F.col("a").alias("key"), F.col("b").alias("node"))
    wanted = util.stored(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "wanted")
    contents = _contents(docs, text, wanted)
    near = util.stored(_near(pairs, contents), "near")
    # first one pair per node, then all that this leaves apart, then the large cells
    groups = components(_verified(near.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"), contents))
    for more in (lambda: _verified(_apart(near, groups), contents), lambda: _in_blocks(members, groups, contents)):
        groups = components(more().union(groups.select(F.col("root").alias("a"), F.col("node").alias("b"))))
    roots = groups.union(groups.select(F.col("root").alias("node"), "root").distinct())
    nodes = rows.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("low"), F.count("*").alias("size")).join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    nodes = util.stored(nodes, "nodes")
    # stored, so that the join below shuffles both sides for itself and a large group can be split
    lowest = util.stored(nodes.groupBy("root").agg(F.min("low").alias("component_id"), F.sum("size").alias("rows")).where("rows > 1"), "lowest")
    named = nodes.join(lowest, "root").select("node", "component_id")
    return rows.join(named, "node", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
