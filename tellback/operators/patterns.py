"""Which of many phrases a text holds, by one automaton over all phrases of a key."""

from __future__ import annotations

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from tellback.sources.sinks import store

#: Texts that one task looks at with one automaton.
TEXTS = 4096


def automaton(phrases: set[str]):
    """All of the phrases but the empty one; None if there is no other."""
    out = ahocorasick.Automaton()
    for p in phrases - {""}:
        out.add_word(p, p)
    if not len(out):
        return None
    out.make_automaton()
    return out


def held(machine, text: str | None) -> set[str]:
    """The phrases that stand in a text, in one pass over it, however many there are."""
    return {p for _, p in machine.iter(text)} if machine is not None and text else set()


def held_phrases(texts: DataFrame, phrases: DataFrame, key: str, text: str, lists: dict[str, str]) -> DataFrame:
    """All rows of ``texts`` with, for each of ``lists`` (new column: list column of ``phrases``), the phrases of its key that its text holds, in lower case on both sides.

    ``phrases`` has a row per key. Texts of a key are dealt in slices of about ``TEXTS``, each of which gets the key's phrases once and makes one automaton, so a text costs one pass whatever the
    number of phrases, and a key with a third of all texts is many tasks. The order of a list is kept; null phrases are never held, the empty one is held by every text that is not null. A
    key without phrases gives empty lists, a null text, too.
    """
    kept = store(texts, "texts")
    slices = store(kept.groupBy(key).agg(F.ceil(F.count(F.lit(1)) / TEXTS).alias("_slices")), "slices")
    dealt = kept.join(slices, kept[key].eqNullSafe(slices[key])).drop(slices[key])
    dealt = dealt.withColumns({"_slice": F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.col("_slices")), "_low": F.lower(F.col(text))}).drop("_slices")
    low = {f"_low_{c}": F.transform(c, F.lower) for c in lists.values()}
    sent = phrases.join(slices.where(F.col(key).isNotNull()), key).withColumns(low).withColumn("_slice", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_slices") - 1)))
    sent = sent.select(key, "_slice", *lists.values(), *low)
    schema = StructType([*texts.schema.fields, *[StructField(c, ArrayType(StringType())) for c in lists]])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        known = {c: ((right[c][0].as_py() or [], right[f"_low_{c}"][0].as_py() or []) if right.num_rows else ([], [])) for c in lists.values()}
        machine = automaton({p for _, lows in known.values() for p in lows if p is not None})
        found: dict[str, list] = {name: [] for name in lists}
        for said in left["_low"].to_pylist():
            inside = held(machine, said) | ({""} if said is not None else set())
            for name, c in lists.items():
                found[name].append([p for p, low in zip(*known[c]) if low in inside])
        out = left.drop_columns(["_slice", "_low"])
        for name in lists:
            out = out.append_column(name, pa.array(found[name], pa.list_(pa.string())))
        return out

    return dealt.groupBy(key, "_slice").cogroup(sent.groupBy(key, "_slice")).applyInArrow(run, schema)
