"""The Merkle manifest against trees built one node at a time."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from tellback.llm import manifest as M

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def tree(hashes, fanout):
    """(root, for each leaf the list of (before, after) on its way up)."""
    paths, owner, now = [[] for _ in hashes], [[k] for k in range(len(hashes))], list(hashes)
    while len(now) > 1:
        up, over = [], []
        for a in range(0, len(now), fanout):
            run = now[a : a + fanout]
            for k in range(len(run)):
                for x in owner[a + k]:
                    paths[x].append(("".join(run[:k]), "".join(run[k + 1 :])))
            up.append(h(*run))
            over.append([x for part in owner[a : a + fanout] for x in part])
        now, owner = up, over
    return now[0], paths


def brute(rows, fanout=2):
    groups = {}
    for row in rows:
        groups.setdefault(row[2], []).append(row)
    keys = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    made = {}
    for g in keys:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        made[g] = tree([leaf(r) for r in groups[g]], fanout)
    root, over = tree([made[g][0] for g in keys], fanout)
    out = []
    for g, up in zip(keys, over):
        for row, path in zip(groups[g], made[g][1]):
            out.append((row[0], leaf(row), made[g][0], root, tuple(path + up)))
    return sorted(out, key=repr)


def cases():
    rnd = random.Random(3)
    rows = [(k, rnd.choice([None, "web", "büch"]), "en", rnd.choice([None, 3]), rnd.choice([None, "", "ä text", "x" * 50_000])) for k in rnd.sample(range(10**6), 37)]
    rows += [(7, "s", None, 1, "t")] * 3 + [(None, None, None, None, None), (None, "s", "en", 4, "u"), (8, "s", "de", 1, "t"), (-5, "s", "", 2, "-"), (11, "s", "zz", 9, "1:t")]
    rows += [(100 + k, "s", "fr", k, "t") for k in range(17)] + [(100, "s", "fr", 99, "other text of one id")]
    return rows


@pytest.mark.parametrize("fanout", [2, 3, 5, 20])
def test_trees_and_proofs(spark, fanout):
    rows = cases()
    docs = spark.createDataFrame(rows, SCHEMA).withColumns({"grp": F.lit(1), "pos": F.lit("x"), "hash": F.lit("y"), "_row": F.lit(2)}).repartition(5)
    got = [(r.doc_id, r.leaf, r.subroot, r.root, tuple((x.before, x.after) for x in r.path)) for r in M.manifest(docs, fanout=fanout).collect()]
    assert sorted(got, key=repr) == brute(rows, fanout)


def test_tampered_rows_are_found(spark):
    rows = cases()
    got = M.verified_manifest(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    assert sorted((r.doc_id, r.leaf, r.subroot, r.root, r.proof_sha256) for r in got if r.doc_id is not None) == sorted(
        (i, a, b, c, h(*[x + y for x, y in p])) for i, a, b, c, p in brute(rows) if i is not None
    )
    changed = {r[0] for r in rows if r[0] is not None and r[3] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0}
    assert changed and {r.doc_id for r in got if not r.verified} == changed
    assert all((r.folded_root == r.root) == r.verified for r in got) and all(r.verified for r in got if r.doc_id is None)


def test_one_row_and_no_row(spark):
    one = M.verified_manifest(spark.createDataFrame([(1, "s", "en", 2, "ab")], SCHEMA)).first()
    assert one.leaf == one.subroot == one.root == leaf((1, "s", "en", 2, "ab")) and one.proof_sha256 == h() and one.verified
    assert M.verified_manifest(spark.createDataFrame([], SCHEMA)).collect() == []


def test_a_fanout_of_one_is_refused(spark):
    with pytest.raises(ValueError):
        M.manifest(spark.createDataFrame([], SCHEMA), fanout=1)
