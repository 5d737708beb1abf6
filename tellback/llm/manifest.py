"""Merkle manifest of a dataset: a tree per group, a tree over the groups' roots, a proof for each row.

A leaf is the SHA-256 of a row's fields. A parent's children are spread into columns by conditional aggregates (``max(when(slot = k, hash))``);
concatenating the columns of a run gives the hash of its parent, leaving out the own column gives the siblings. One aggregate spreads as many
children as several levels of the tree have, whose hashes are then made of columns alone, so ``fanout`` 2 takes one shuffle for four levels.

The way down starts at the root with an empty proof; each parent row hands its slots the siblings and its own proof. Only parents
are joined, a sixteenth of the rows at most; rows themselves are shuffled twice, once to be numbered and once to meet their siblings, as hashes.
Numbers within a group come from a range partition (``sources.numbering``), so a group with a third of all rows is no task of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tellback.llm import util
from tellback.sources.numbering import numbered

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Columns of one pivot at most (unless the fanout alone is larger).
COLUMNS = 16
PATH = "array<struct<before:string,after:string>>"


def encoded(value: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def leaf(fields, **changed: Column) -> Column:
    return digest(*[encoded(changed.get(f, F.col(f))) for f in fields])


def _levels(fanout: int) -> int:
    """Levels of the tree that one pivot spans."""
    n = 1
    while fanout ** (n + 1) <= COLUMNS:
        n += 1
    return n


def _depth(size: Column, fanout: int) -> Column:
    """Levels above the leaves of a tree: as often as ``fanout`` has to be multiplied to reach ``size``."""
    powers = [fanout**k for k in range(63) if fanout**k < 1 << 62]
    return sum((F.when(size > p, 1).otherwise(0) for p in powers), F.lit(0))


def _spread(nodes: DataFrame, fanout: int) -> DataFrame:
    """A row per parent (grp, pos, depth) with its children in columns c0, c1, ... (null where there is none)."""
    width = fanout ** _levels(fanout)
    slot = F.pmod(F.col("pos"), F.lit(width))
    parent = F.floor(F.col("pos") / width).cast("long") if width & width - 1 else F.shiftright("pos", width.bit_length() - 1)
    child = F.struct("hash", "item")
    return nodes.groupBy("grp", parent.alias("pos")).agg(F.max("depth").alias("depth"), *[F.max(F.when(slot == k, child)).alias(f"c{k}") for k in range(width)])


def _hashed(parents: DataFrame, done: int, fanout: int) -> DataFrame:
    """The hashes of all levels that a parent row spans as arrays l0 (its children), l1, ... and its own hash, with ``done`` levels below.

    A tree that has ended (``depth``) only hands its root on.
    """
    width, out = fanout ** _levels(fanout), parents
    names = [f"c{k}.hash" for k in range(width)]
    out = out.withColumn("l0", F.array(*names))
    for level in range(1, _levels(fanout) + 1):
        made = []
        for first in range(0, len(names), fanout):
            run = names[first : first + fanout]
            node = F.when(F.col(run[0]).isNotNull(), digest(*[F.coalesce(F.col(c), F.lit("")) for c in run]))
            kept = F.col(run[0]) if first == 0 else F.lit(None).cast("string")
            made.append(F.when(F.col("depth") >= done + level, node).otherwise(kept))
        names = [f"h{level}_{k}" for k in range(len(made))]
        out = out.withColumns(dict(zip(names, made))).withColumn(f"l{level}", F.array(*names))
    return out.withColumn("hash", F.col(names[0]))


def _up(nodes: DataFrame, fanout: int) -> tuple[list[DataFrame], DataFrame]:
    """Tables of parent rows from the leaves up, and the root (grp, hash) of each tree."""
    tables, done = [], 0
    while True:
        tables.append(util.stored(_spread(nodes, fanout), "slots"))
        made = _hashed(tables[-1], done, fanout)
        done += _levels(fanout)
        if (tables[-1].agg(F.max("depth")).first()[0] or 0) <= done:
            return tables, made.select("grp", "hash")
        nodes = made.select("grp", "pos", "depth", "hash", F.lit(None).cast("boolean").alias("item"))


def _down(tables: list[DataFrame], seeds: DataFrame, fanout: int, *carried: str) -> DataFrame:
    """item, hash, path and the ``carried`` columns of ``seeds`` for every leaf. ``seeds`` has grp, path and those for each tree."""
    levels = _levels(fanout)
    now = seeds.withColumn("pos", F.lit(0).cast("long"))
    for k in reversed(range(len(tables))):
        rows = _hashed(tables[k], k * levels, fanout).drop("hash").withColumnRenamed("pos", "at").withColumnRenamed("grp", "_grp")
        rows = rows.join(now.withColumnRenamed("pos", "at").withColumnRenamed("grp", "_grp"), ["_grp", "at"])
        width = fanout**levels
        rows = rows.withColumn("children", F.array(*[f"c{j}" for j in range(width)]))
        arrays = [f"l{a}" for a in range(levels)]
        rows = rows.select("_grp", "at", "depth", "path", *arrays, *carried, F.posexplode("children").alias("slot", "child")).where("child is not null")
        own = []
        for a in range(levels):
            place = F.floor(F.col("slot") / fanout**a).cast("int")
            first = place - place % fanout
            before = F.array_join(F.slice(f"l{a}", first + 1, place - first), "")
            after = F.array_join(F.slice(f"l{a}", place + 2, first + fanout - 1 - place), "")
            entry = F.array(F.struct(before.alias("before"), after.alias("after")))
            own.append(F.when(F.col("depth") > k * levels + a, entry).otherwise(F.array().cast(PATH)))
        now = rows.select(F.col("_grp").alias("grp"), (F.col("at") * width + F.col("slot")).alias("pos"), F.concat(*own, "path").alias("path"), "child.item", "child.hash", *carried)
        now = now if k == 0 else now.drop("item", "hash")
    return now


def manifest(rows: DataFrame, fields=FIELDS, id: str = "doc_id", group: str = "lang", fanout: int = 2, shown: Column | None = None) -> DataFrame:
    """id, leaf, shown, subroot, root and path of every row.

    ``path`` has the siblings before and after the row's node on each level, from its leaf to the root of all. Leaves of a group ascend by id, groups by their
    value; nulls come first in both. Rows with one id are in order of their leaves; whole repeats are leaves of their own, and which of them has which place is open, as they
    are equal. ``shown`` is a leaf hash presented for checking (the leaf itself where null). A run's last nodes may be fewer than ``fanout``, even one, which is
    hashed alone; a group of one row has its leaf as root. Without rows there is no root. Other columns are not looked at.
    """
    if fanout < 2:
        raise ValueError("fanout must be 2 or more")
    key = F.concat(F.when(F.col(group).isNull(), "0").otherwise("1"), F.coalesce(F.col(group).cast("string"), F.lit("")))
    own = leaf(fields)
    leaves = rows.select(key.alias("grp"), F.col(id).alias("id"), own.alias("hash"), (F.lit(None).cast("string") if shown is None else shown).alias("shown"))
    placed = numbered(leaves, ["grp"], F.col("id"), F.col("hash"), name="nth", size="size")
    node = [(F.col("nth") - 1).alias("pos"), _depth(F.col("size"), fanout).alias("depth"), "hash"]
    tables, tops = _up(placed.select("grp", *node, F.struct("id", "shown").alias("item")), fanout)
    groups = numbered(tops.select(F.lit("").alias("grp"), F.col("grp").alias("of"), "hash"), ["grp"], F.col("of"), name="nth", size="size")
    over, root = _up(groups.select("grp", *node, F.struct(F.col("of")).alias("item")), fanout)
    seeds = _down(over, root.select("grp", F.col("hash").alias("root"), F.array().cast(PATH).alias("path")), fanout, "root")
    seeds = seeds.select(F.col("item.of").alias("grp"), F.col("hash").alias("subroot"), "root", "path")
    found = _down(tables, seeds, fanout, "subroot", "root")
    return found.select(F.col("item.id").alias(id), F.col("hash").alias("leaf"), F.coalesce("item.shown", "hash").alias("shown"), "subroot", "root", "path")


def proof_digest(path: Column) -> Column:
    """One hash of all siblings, level by level."""
    return F.sha2(F.array_join(F.transform(path, lambda x: F.concat(x["before"], x["after"])), ""), 256)


def folded(start: Column, path: Column) -> Column:
    """The root that a leaf and its siblings lead to."""
    return F.aggregate(path, start, lambda own, x: F.sha2(F.concat(x["before"], own, x["after"]), 256))


def verified_manifest(docs: DataFrame) -> DataFrame:
    """The manifest of ``documents`` and a check of every row, of which those whose id's crc32 is divisible by 7 show one character more than they have.

    Null ids are not changed, nor are null counts.
    """
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    shown = F.when(hit & F.col("n_chars").isNotNull(), leaf(FIELDS, n_chars=F.col("n_chars").cast("decimal(20,0)") + 1))
    found = manifest(docs, shown=shown).withColumn("folded_root", folded(F.col("shown"), F.col("path")))
    return found.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


_HASH = "sha256({})"
_FIELD = "CASE WHEN {0} IS NULL THEN '-' ELSE CAST(octet_length(encode(CAST({0} AS VARCHAR))) AS VARCHAR) || ':' || CAST({0} AS VARCHAR) END"


def oracle() -> str:
    """The same in DuckDB: trees by recursion over levels, proofs by joins with every level's nodes."""
    field = lambda f, v=None: _FIELD.format(v or f)
    own = "sha256(" + " || ".join(field(f) for f in FIELDS) + ")"
    other = "sha256(" + " || ".join(field(f, "(n_chars + 1)" if f == "n_chars" else None) for f in FIELDS) + ")"
    # bytes of the id, each followed by eight shifts, folded into the checksum
    crc = """xor(list_reduce([4294967295] || flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1])),
      lambda a, v: CASE WHEN v >= 0 THEN xor(a, v) WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END), 4294967295)"""
    return f"""WITH RECURSIVE lf AS MATERIALIZED (SELECT coalesce('1' || lang, '0') AS g, doc_id, {own} AS leaf,
    CASE WHEN n_chars IS NOT NULL AND {crc} % 7 = 0 THEN {other} END AS changed FROM documents),
  placed AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM lf),
  up AS (SELECT 0 AS level, g, pos, leaf AS h, count(*) OVER (PARTITION BY g) AS n FROM placed
    UNION ALL SELECT level, g, pos, h, count(*) OVER (PARTITION BY g) FROM (
      SELECT min(level) + 1 AS level, g, pos // 2 AS pos, sha256(string_agg(h, '' ORDER BY pos)) AS h FROM up WHERE n > 1 GROUP BY g, pos // 2) t),
  tree AS MATERIALIZED (SELECT * FROM up),
  subs AS MATERIALIZED (SELECT g, h, row_number() OVER (ORDER BY g) - 1 AS pos, max(level) OVER () AS high FROM tree WHERE n = 1),
  top AS (SELECT 0 AS level, pos, h, count(*) OVER () AS n FROM subs
    UNION ALL SELECT level, pos, h, count(*) OVER () FROM (
      SELECT min(level) + 1 AS level, pos // 2 AS pos, sha256(string_agg(h, '' ORDER BY pos)) AS h FROM top WHERE n > 1 GROUP BY pos // 2) t),
  crown AS MATERIALIZED (SELECT * FROM top),
  hops AS (SELECT p.g, p.pos, t.level, t.pos AS own, CASE WHEN s.pos < t.pos THEN 'b' WHEN s.pos > t.pos THEN 'a' ELSE '-' END AS side, coalesce(s.h, '') AS h
      FROM placed p JOIN tree t ON t.g = p.g AND t.pos = p.pos >> t.level AND t.n > 1 LEFT JOIN tree s ON s.g = t.g AND s.level = t.level AND s.pos = xor(t.pos, 1)
    UNION ALL SELECT p.g, p.pos, 1000 + t.level, t.pos, CASE WHEN s.pos < t.pos THEN 'b' WHEN s.pos > t.pos THEN 'a' ELSE '-' END, coalesce(s.h, '')
      FROM placed p JOIN subs u ON u.g = p.g JOIN crown t ON t.pos = u.pos >> t.level AND t.n > 1 LEFT JOIN crown s ON s.level = t.level AND s.pos = xor(t.pos, 1)),
  proofs AS (SELECT g, pos, list(side || h ORDER BY level) AS steps, string_agg(h, '' ORDER BY level) AS together FROM hops GROUP BY g, pos),
  judged AS (SELECT p.doc_id, p.leaf, u.h AS subroot, (SELECT h FROM crown WHERE n = 1) AS root, sha256(coalesce(x.together, '')) AS proof_sha256,
    list_reduce([coalesce(p.changed, p.leaf)] || coalesce(x.steps, []::VARCHAR[]), lambda o, s: sha256(CASE s[1] WHEN 'b' THEN s[2:] || o WHEN 'a' THEN o || s[2:] ELSE o END)) AS folded_root
    FROM placed p JOIN subs u ON u.g = p.g LEFT JOIN proofs x ON x.g = p.g AND x.pos = p.pos)
SELECT *, folded_root = root AS verified FROM judged"""
