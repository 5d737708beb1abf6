"""Near-duplicate embeddings by cross-polytope hashing: links at a cosine, and the groups they form.

A vector is turned by three rounds of random signs and fast Hadamard transforms; the axis nearest to it, with its sign, is its hash. A bucket of a table is the
combination of the hashes of ``parts`` such rotations. A vector enters the buckets of its ``PROBES`` most likely combinations, those that lose least length
against the nearest axes, so that neighbours on two sides of a boundary meet. The number of parts follows the number of vectors, so that buckets of unrelated
vectors stay small; the number of tables follows from the measured chance that a pair at the threshold shares a bucket, so that a pair is
missed with a chance of ``MISS`` at most (nearer ones with far less).

* Equal vectors are one node with a weight, whatever their number.
* Pairs that share a bucket are compared by 128 random signs first; the most that may differ lies 6.5 standard deviations above what a pair at the threshold
  differs in. What passes is verified on the vectors in double precision.
* Buckets of at most ``FEW`` nodes give their pairs. In larger ones each node meets the first. A large bucket whose nodes are in more than one group then is
  searched for near pairs between groups (semi-joins, so that a node comes out once however many partners it has), which are compared in blocks.
* Links are counted group by group: nodes in blocks, each pair of blocks in a task of its own that yields one number per node. A group's pairs are
  never rows.
"""

from __future__ import annotations

import functools
import itertools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tellback.llm import util
from tellback.llm.groups import components

SIMILAR = 0.9
#: Chance to miss a pair that is exactly at the threshold.
MISS = 1e-3
PROBES = 4
#: Axes of a rotation that probes choose from.
AXES = 3
#: Vectors are padded with zeros to a power of two, at least this.
LEAST_WIDTH = 64
#: Unrelated vectors that may stand in a bucket on average.
CROWD = 16
FEW = 64
BLOCK = 1024
#: Groups up to this size share tasks.
BUNDLED = 256
SKETCH = 128


def hadamard(x: np.ndarray) -> np.ndarray:
    """Walsh-Hadamard transform of the rows, keeping their length. The width is a power of two."""
    rows, width = x.shape
    half = 1
    while half < width:
        x = x.reshape(rows, -1, 2, half)
        x = np.stack((x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]), axis=2)
        half *= 2
    return x.reshape(rows, width) / np.float32(width**0.5)


def padded(width: int) -> int:
    return max(LEAST_WIDTH, 1 << (width - 1).bit_length()) if width else LEAST_WIDTH


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows brought to length 1 (in double precision, safe for very large and very small components)."""
    vectors = vectors / np.abs(vectors).max(1, keepdims=True)
    return vectors / np.sqrt((vectors**2).sum(1, keepdims=True))


@functools.lru_cache(256)
def _signs(width: int, number: int) -> np.ndarray:
    """Signs of the three rounds of a rotation."""
    return np.random.default_rng((11, width, number)).choice(np.array([-1, 1], np.float32), (3, padded(width)))


def turned(units: np.ndarray, number: int) -> np.ndarray:
    width = units.shape[1]
    x = np.zeros((len(units), padded(width)), np.float32)
    x[:, :width] = units
    for signs in _signs(width, number):
        x = hadamard(x * signs)
    return x


def buckets(units: np.ndarray, table: int, parts: int, probes: int = PROBES) -> np.ndarray:
    """Keys of the most likely buckets of a table, likeliest first: a row of ``probes`` per vector."""
    n, width = units.shape
    axes = min(AXES, padded(width))
    code, loss = np.zeros((parts, n, axes), np.uint64), np.zeros((parts, n, axes), np.float32)
    for part in range(parts):
        y = turned(units, table * parts + part)
        size = np.abs(y)
        best = np.argpartition(-size, axes - 1, axis=1)[:, :axes]
        held = np.take_along_axis(size, best, 1)
        order = np.lexsort((best, -held), axis=1)
        best, held = np.take_along_axis(best, order, 1), np.take_along_axis(held, order, 1)
        code[part] = 2 * best + (np.take_along_axis(y, best, 1) < 0)
        loss[part] = (held[:, :1] - held) ** 2
    choices = list(itertools.product(range(axes), repeat=parts))
    total = np.stack([sum(loss[p][:, c] for p, c in enumerate(choice)) for choice in choices], axis=1)
    picked = np.argsort(total, axis=1, kind="stable")[:, :probes]
    names = np.zeros((n, len(choices)), np.uint64)
    for p in range(parts):
        names = names * np.uint64(2 * padded(width)) + np.stack([code[p][:, choice[p]] for choice in choices], axis=1)
    start = util.mix(np.array([width * 1_000_003 + table], np.uint64))
    return util.mix(util.mix(np.take_along_axis(names, picked, 1)) + start).view(np.int64)


def sketches(units: np.ndarray) -> np.ndarray:
    """128 signs of random directions as two 64-bit integers per vector."""
    width = units.shape[1]
    rounds = -(-SKETCH // padded(width))
    bits = np.concatenate([turned(units, -1 - r & 0xFFFF) > 0 for r in range(rounds)], axis=1)[:, :SKETCH]
    return np.packbits(bits, axis=1).view(np.int64).reshape(len(units), 2)


def most_signs(similar: float) -> int:
    """Signs in which a pair at the threshold differs at most."""
    share = math.acos(similar) / math.pi
    return math.floor(SKETCH * share + 6.5 * math.sqrt(SKETCH * share * (1 - share))) + 1


@functools.lru_cache(64)
def tables(width: int, parts: int, similar: float, miss: float = MISS) -> int:
    """Tables that it takes to miss a pair at the threshold with a chance of ``miss``, from the share of random pairs that meet in a table."""
    random = np.random.default_rng(5)
    a = unit(random.standard_normal((1000, width)) + 1e-9)
    b = random.standard_normal((1000, width))
    b -= (a * b).sum(1, keepdims=True) * a
    b = similar * a + math.sqrt(1 - similar**2) * (unit(b) if width > 1 else 0)
    met = [(buckets(a, t, parts)[:, :, None] == buckets(b, t, parts)[:, None, :]).any((1, 2)).mean() for t in range(3)]
    share = min(max(float(np.mean(met)), 1e-3), 1 - 1e-9)
    return max(2, math.ceil(math.log(miss) / math.log(1 - share)))


def parts_for(n: int, width: int) -> int:
    """Parts of a hash so that a bucket has CROWD unrelated vectors at most on average."""
    parts = 1
    while n * PROBES > CROWD * (2 * padded(width)) ** parts:
        parts += 1
    return parts


def _lists(values: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """Places and matrix of the vectors of each width."""
    sizes = np.diff(values.offsets.to_numpy()) if len(values) else np.zeros(0, np.int64)
    flat = values.flatten().to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes)
    out = []
    for width in np.unique(sizes):
        at = np.flatnonzero(sizes == width)
        out.append((at, flat[(ends[at] - width)[:, None] + np.arange(width)]))
    return out


def _placed(nodes: DataFrame, parts: int, similar: float) -> DataFrame:
    """key, node and sketch (s0, s1) for each bucket that a node enters."""

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 2048):
                part = batch.slice(start, 2048)
                names = part.column(0).to_numpy()
                for at, vectors in _lists(part.column(1)):
                    units = unit(vectors)
                    signs = sketches(units)
                    for table in range(tables(vectors.shape[1], parts, similar)):
                        keys = buckets(units, table, parts)
                        own = np.repeat(at, keys.shape[1])
                        of = np.repeat(np.arange(len(at)), keys.shape[1])
                        yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(names[own]), pa.array(signs[of, 0]), pa.array(signs[of, 1])], names=["key", "node", "s0", "s1"])

    return nodes.select("node", "v").mapInArrow(run, "key long, node long, s0 long, s1 long")


def _close(a: str, b: str, most: int) -> Column:
    apart = [F.bit_count(F.col(f"{a}{s}").bitwiseXOR(F.col(f"{b}{s}"))) for s in ("s0", "s1")]
    return apart[0] + apart[1] <= most


def _verified(pairs: DataFrame, nodes: DataFrame, similar: float) -> DataFrame:
    """Pairs (a, b) with a cosine of at least ``similar``."""
    both = pairs
    for side in ("a", "b"):
        both = both.join(nodes.select(F.col("node").alias(side), F.col("v").alias(f"v{side}")), side)

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 4096):
                part = batch.slice(start, 4096)
                keep = np.zeros(part.num_rows, bool)
                right = part.column(3)
                for at, left in _lists(part.column(2)):
                    other = right.take(pa.array(at))
                    same = np.flatnonzero(np.diff(other.offsets.to_numpy()) == left.shape[1])
                    for here, vectors in _lists(other.take(pa.array(same))):
                        keep[at[same[here]]] = (unit(left[same[here]]) * unit(vectors)).sum(1) >= similar
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1)], names=["a", "b"]).filter(pa.array(keep))

    return both.select("a", "b", "va", "vb").mapInArrow(run, "a long, b long")


def _dealt(members: DataFrame, nodes: DataFrame) -> DataFrame:
    """Members (cluster, node, root, weight) of each cluster in blocks, each pair of blocks (i, j) with the vectors of both. Small clusters share a task."""
    sizes = members.groupBy("cluster").agg(F.count("*").alias("of"))
    small = F.col("of") <= BUNDLED
    total = sizes.agg(F.sum(F.when(small, F.col("of")))).first()[0] or 0
    bundles = max(1, -(-total // (4 * BLOCK)))
    sized = members.join(sizes, "cluster").withColumns(
        {
            "blocks": F.when(small, 1).otherwise(F.ceil(F.col("of") / BLOCK)).cast("int"),
            "task": F.when(small, F.pmod(F.xxhash64("cluster"), F.lit(bundles))).otherwise(F.col("cluster")),
        }
    )
    sized = sized.withColumn("block", F.pmod(F.xxhash64("node", F.lit("block")), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    with_vectors = sized.join(nodes.select("node", "v"), "node").withColumn("other", other)
    return with_vectors.select(small.alias("small"), "task", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "cluster", "block", "node", "root", "weight", "v")


def _compared(table: pa.Table):
    """For each cluster of a task: its rows, those of the first and the other block, and the cosines of the first with all others."""
    cluster, block = table["cluster"].to_numpy(), table["block"].to_numpy()
    values = table["v"].combine_chunks()
    order = np.argsort(cluster, kind="stable")
    cuts = np.flatnonzero(np.diff(cluster[order])) + 1
    for rows in np.split(order, cuts) if len(order) else []:
        both = block[rows].min() != block[rows].max()
        for at, vectors in _lists(values.take(pa.array(rows))):
            here, units = rows[at], unit(vectors)
            left = np.flatnonzero(block[here] == block[rows].min())
            right = np.flatnonzero(block[here] != block[rows].min()) if both else left
            yield here[left], here[right], units[left], units[right], both


def _counted(members: DataFrame, nodes: DataFrame, similar: float) -> DataFrame:
    """node and links: the weights of all other members of its cluster within the threshold."""

    def run(table: pa.Table) -> pa.Table:
        weight, links = table["weight"].to_numpy(), np.zeros(table.num_rows, np.int64)
        for left, right, a, b, both in _compared(table):
            for start in range(0, len(left), 256):
                near = a[start : start + 256] @ b.T >= similar
                if not both:  # not with itself
                    near[np.arange(len(near)), start + np.arange(len(near))] = False
                links[left[start : start + 256]] += near @ weight[right]
                if both:
                    links[right] += weight[left[start : start + 256]] @ near
        return pa.table({"node": table["node"], "links": pa.array(links)})

    dealt = _dealt(members, nodes)
    return dealt.groupBy("small", "task", "i", "j").applyInArrow(run, "node long, links long").groupBy("node").agg(F.sum("links").alias("links"))


def _joined(members: DataFrame, nodes: DataFrame, similar: float) -> DataFrame:
    """Links (a, b) between the groups (root) of each cluster; two groups are joined at most once in a pair of blocks."""

    def run(table: pa.Table) -> pa.Table:
        name, out = table["node"].to_numpy(), ([], [])
        _, group = np.unique(table["root"].to_numpy(), return_inverse=True)
        for left, right, a, b, _ in _compared(table):
            for k, x in zip(left, a):
                for j in right[(b @ x >= similar) & (group[right] != group[k])]:
                    if group[j] != group[k]:
                        out[0].append(name[k])
                        out[1].append(name[j])
                        group[group == group[j]] = group[k]
        return pa.table({"a": pa.array(out[0], pa.int64()), "b": pa.array(out[1], pa.int64())})

    return _dealt(members, nodes).groupBy("small", "task", "i", "j").applyInArrow(run, "a long, b long")


def _wanted(rows: DataFrame, groups: DataFrame, most: int) -> DataFrame:
    """Members (cluster, node, root) of large buckets that have a near one of another group in their bucket.

    In a bucket all but its most frequent group are looked at against everything; the pairs of that group are not.
    """
    rooted = util.stored(rows.join(groups, "node", "left").select("key", "node", F.coalesce("root", "node").alias("root"), "s0", "s1"), "rooted")
    spread = rooted.groupBy("key", "root").agg(F.count("*").alias("n")).groupBy("key").agg(F.max_by("root", "n").alias("usual"), F.count("*").alias("groups")).where("groups > 1")
    left = rooted.join(spread.select("key", "usual"), "key").select("key", "node", "root", "s0", "s1", (F.col("root") != F.col("usual")).alias("stray"))
    left = util.stored(left, "open")
    seen = left.select(*[F.col(c).alias(f"o{c}") for c in ("key", "root", "s0", "s1", "stray")])
    meets = (F.col("key") == F.col("okey")) & (F.col("root") != F.col("oroot")) & _close("", "o", most)
    strays = left.where("stray").join(seen, meets, "left_semi")
    usual = left.where("not stray").join(seen.where("ostray"), meets, "left_semi")
    return strays.union(usual).select(F.col("key").alias("cluster"), "node", "root", F.lit(1).cast("long").alias("weight"))


def near_duplicates(vectors: DataFrame, similar: float = SIMILAR, id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """id, n_links (other rows with a cosine of at least ``similar``), component_id (smallest id reachable by links) and kept, a row for each row.

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing; vectors of different lengths do not link with each other. Rows
    that repeat a vector link with each other, those with one id, too. Null ids are counted, but are a component's id only if it has no other. ``kept`` is whether
    the id is the component's; a row without id is kept if its component has none. Other columns are not looked at.
    """
    v = F.transform(F.col(vector).cast("array<double>"), lambda x: x + F.lit(0.0))  # no negative zeros
    odd = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.select(F.col(id).cast("long").alias("id"), v.alias("v"))
    fine = F.coalesce(~odd & F.exists("v", lambda x: x != 0), F.lit(False))
    rows = rows.withColumn("v", F.when(fine, F.col("v")))
    named = rows.withColumns({"h1": F.when(F.col("v").isNotNull(), F.xxhash64("v")), "h2": F.when(F.col("v").isNotNull(), F.xxhash64(F.lit("second"), "v"))})
    known = named.where("v is not null").groupBy("h1", "h2").agg(F.count("*").alias("weight"), F.min("id").alias("low"), F.any_value("v").alias("v"))
    nodes = util.stored(known.withColumn("node", F.monotonically_increasing_id()), "nodes")
    top = nodes.groupBy(F.size("v").alias("width")).count().agg(F.sum("count").alias("n"), F.max_by("width", "count").alias("width")).first()
    parts = parts_for(top["n"] or 0, top["width"] or 0)
    most = most_signs(similar)

    keys = util.stored(_placed(nodes, parts, similar).distinct(), "buckets")
    sizes = util.stored(keys.groupBy("key").agg(F.count("*").alias("of"), F.min(F.struct("node", "s0", "s1")).alias("first")).where("of > 1"), "sizes")
    shared = util.stored(keys.join(sizes, "key"), "shared")
    few = shared.where(F.col("of") <= FEW).select("key", "node", "s0", "s1")
    other = few.select(*[F.col(c).alias(f"o{c}") for c in few.columns])
    pairs = few.join(other, (F.col("key") == F.col("okey")) & (F.col("node") < F.col("onode")) & _close("", "o", most)).select(F.col("node").alias("a"), F.col("onode").alias("b"))
    many = shared.where(F.col("of") > FEW).select("key", "node", "s0", "s1", F.col("first.node").alias("fnode"), F.col("first.s0").alias("fs0"), F.col("first.s1").alias("fs1"))
    stars = many.where((F.col("node") != F.col("fnode")) & _close("", "f", most)).select(F.col("fnode").alias("a"), F.col("node").alias("b"))
    groups = components(_verified(util.stored(pairs.union(stars).distinct(), "pairs"), nodes, similar))
    late = _joined(util.stored(_wanted(many.select("key", "node", "s0", "s1"), groups, most).distinct(), "wanted"), nodes, similar)
    groups = components(late.union(groups.select(F.col("root").alias("a"), F.col("node").alias("b"))))

    rooted = groups.union(groups.select(F.col("root").alias("node"), "root").distinct())
    members = util.stored(rooted.join(nodes.select("node", "weight", "low"), "node"), "members")
    lowest = util.stored(members.groupBy("root").agg(F.min("low").alias("component_id")), "lowest")
    links = _counted(members.select(F.col("root").alias("cluster"), "node", "root", "weight"), nodes, similar)
    judged = members.join(lowest, "root").join(links, "node").select("node", "links", "component_id")
    found = nodes.select("node", "h1", "h2", "weight", "low").join(judged, "node", "left")
    found = util.stored(found.select("h1", "h2", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component_id", "low").alias("component_id")), "found")
    out = named.select("id", "h1", "h2").join(found, ["h1", "h2"], "left")
    component = F.coalesce("component_id", "id")
    return out.select(F.col("id").alias(id), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))


def oracle() -> str:
    """All pairs in DuckDB, and the smallest id reachable."""
    return """WITH RECURSIVE rows AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, embedding::DOUBLE[] AS v FROM embeddings),
  fine AS MATERIALIZED (SELECT * FROM rows WHERE v IS NOT NULL AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
  near AS MATERIALIZED (SELECT a.r, b.r AS o FROM fine a JOIN fine b ON a.r <> b.r AND len(a.v) = len(b.v) AND list_cosine_similarity(a.v, b.v) >= 0.9),
  reach AS (SELECT r, r AS o FROM rows UNION SELECT reach.r, near.o FROM reach JOIN near ON near.r = reach.o)
SELECT vec_id, n_links, component_id, vec_id IS NOT DISTINCT FROM component_id AS kept FROM (
  SELECT x.vec_id, (SELECT count(*) FROM near n WHERE n.r = x.r) AS n_links, coalesce((SELECT min(y.vec_id) FROM reach JOIN rows y ON y.r = reach.o WHERE reach.r = x.r), x.vec_id) AS component_id FROM rows x) t"""
