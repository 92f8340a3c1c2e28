"""Audiences of any ids as bitmaps: dense numbers for ids, and whole batches of rules evaluated bucket by bucket."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.rules import atoms_of, matches, rule_frame
from .groups import stored

#: Ids of a bucket, and bytes of its bitmap.
BITS, BYTES = 32_768, 4096


def numbered_ids(ids: DataFrame, id_col: str = "user_id") -> DataFrame:
    """``(id, number)``: the distinct ids numbered from 1 on without gaps; a null id has none.

    Ids are numbered within the partitions they lie in and partitions are laid end to end by their counts; nothing is sorted.
    The written table is the dictionary: numbers hold as long as it does.
    """
    own = ids.select(F.col(id_col).alias("id")).where("id is not null").distinct()
    own = stored(own.withColumn("part", F.spark_partition_id()).withColumn("i", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))), "ids")
    before = F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1))  # a row for each partition
    starts = own.groupBy("part").agg(F.count("*").alias("n")).select("part", F.coalesce(before, F.lit(0).cast("long")).alias("before"))
    return stored(own.join(F.broadcast(starts), "part").select("id", (F.col("before") + F.col("i") + 1).alias("number")), "numbers")


def _maps(numbers: DataFrame, label: Column) -> DataFrame:
    return numbers.groupBy(label.alias("label"), F.bitmap_bucket_number("number").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("number")).alias("bitmap"))


def audience_maps(members: DataFrame, numbers: DataFrame, by: str = "rule", id_col: str = "user_id") -> DataFrame:
    """``(label, bucket, bitmap)`` of the audiences in ``members``, by partial aggregation; ids without a number are in none."""
    known = members.select(F.col(by).alias("label"), F.col(id_col).alias("id")).join(numbers, "id")
    return _maps(known, F.col("label"))


class _Bucket:
    """Rules over the bitmaps of one bucket; a part that rules share is evaluated once, and what is empty goes no further."""

    def __init__(self, maps: dict[str, np.ndarray], every: np.ndarray):
        self.maps, self.every, self.known = maps, every, {}
        self.none = np.zeros(BYTES // 8, np.uint64)

    def value(self, rule: dict) -> np.ndarray:
        key = repr(rule)
        if key not in self.known:
            self.known[key] = self._value(rule)
        return self.known[key]

    def _value(self, rule: dict) -> np.ndarray:
        if "all" in rule:
            out = self.every
            for r in rule["all"]:
                out = out & self.value(r)
                if not out.any():
                    break
            return out
        if "any" in rule:
            out = self.none
            for r in rule["any"]:
                out = out | self.value(r)
            return out
        if "not" in rule:
            return self.every & ~self.value(rule["not"])
        return self.maps.get(rule["has"], self.none)


def rules_on_maps(maps: DataFrame, numbers: DataFrame, rules: dict[str, dict]) -> DataFrame:
    """``(rule, bucket, bitmap, users)`` of rules over ``maps``: ``{"has": label}``, ``{"all": [...]}``, ``{"any": [...]}``, ``{"not": ...}``.

    ``not`` is against all numbered ids.  A bucket's bitmaps, 4 kB for each label that rules name, meet in one row; buckets in which
    nobody meets a rule have no row of it.
    """
    labels = sorted({a["has"] for r in rules.values() for a in atoms_of(r)})
    chosen = maps.where(F.col("label").isin(labels)).unionByName(_maps(numbers, F.lit(None).cast("string")))
    rows = chosen.groupBy("bucket").agg(F.collect_list(F.struct("label", "bitmap")).alias("maps"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for bucket, listed in zip(b.column(0), b.column(1)):
                own = {m["label"].as_py(): np.frombuffer(m["bitmap"].as_py(), np.uint64) for m in listed}
                here = _Bucket(own, own.pop(None, np.zeros(BYTES // 8, np.uint64)))
                out = [(name, x) for name, r in rules.items() if (x := here.value(r)).any()]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([n for n, _ in out], pa.string()),
                        pa.array([bucket.as_py()] * len(out), pa.int64()),
                        pa.array([x.tobytes() for _, x in out], pa.binary()),
                        pa.array([int(np.bitwise_count(x).sum()) for _, x in out], pa.int64()),
                    ],
                    names=["rule", "bucket", "bitmap", "users"],
                )

    return rows.mapInArrow(run, "rule string, bucket long, bitmap binary, users long")


def members_of(maps: DataFrame, numbers: DataFrame, by: str = "rule") -> DataFrame:
    """``(by, id)``: the ids that bitmaps stand for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for label, bucket, bits in zip(*(c.to_pylist() for c in b.columns)):
                at = np.flatnonzero(np.unpackbits(np.frombuffer(bits, np.uint8), bitorder="little")) + (bucket - 1) * BITS + 1
                yield pa.RecordBatch.from_arrays([pa.array([label] * len(at), pa.string()), pa.array(at, pa.int64())], names=[by, "number"])

    return maps.select(by, "bucket", "bitmap").mapInArrow(run, f"{by} string, number long").join(numbers, "number").select(by, "id")


def bitmap_rules(profile: DataFrame, rules: dict[str, dict], raw: DataFrame, run_date: Column | None = None, id_col: str = "user_id") -> tuple[DataFrame, DataFrame]:
    """The bitmaps ``(rule, bucket, bitmap, users)`` of rules as in ``rule_frame``, and the numbers of their ids.

    Every distinct atom of all rules is measured once, in one pass, and made a bitmap; rules are made of those.
    """
    atoms = {repr(a): a for r in rules.values() for a in atoms_of(r)}
    names = {key: f"atom_{i}" for i, key in enumerate(atoms)}

    def renamed(rule: dict) -> dict:
        if "not" in rule:
            return {"not": renamed(rule["not"])}
        for many in ("all", "any"):
            if many in rule:
                return {many: [renamed(r) for r in rule[many]]}
        return {"has": names[repr(rule)]}

    flags = stored(rule_frame(profile, {names[k]: a for k, a in atoms.items()}, raw, run_date=run_date).select(id_col, *names.values()), "atoms")
    numbers = numbered_ids(flags, id_col)
    maps = audience_maps(matches(flags, list(names.values()), id_col), numbers, "rule", id_col)
    return rules_on_maps(maps, numbers, {n: renamed(r) for n, r in rules.items()}), numbers
