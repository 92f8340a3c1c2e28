"""Audience rules held as data, compiled to one aggregation pass and boolean columns.

A rule is a nested dict: ``{"all": [...]}``, ``{"any": [...]}``, ``{"not": rule}`` or an atom:

* ``{"raw": type, "stat": s, "op": o, "value": v, "where": [(attr, op, value)], "attr": a}`` over raw events,
  s one of exists, count, days, dur_max, distinct (of ``attr``), contains (``value`` in the attributes' text);
  ``raw`` may be a list of types;
* ``{"event": name, "stat": exists | count | days_since, "op": o, "value": v}`` over derived events;
* ``{"profile": field, "op": o, "value": v}``;
* ``{"before": (a, b)}``: all of a before the first b; ``{"same": (a, attr, b, attr)}``: a shared attribute value.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPS = {
    "=": lambda a, b: a == b,
    "==": lambda a, b: a == b,
    "!=": lambda a, b: a != b,
    ">": lambda a, b: a > b,
    ">=": lambda a, b: a >= b,
    "<": lambda a, b: a < b,
    "<=": lambda a, b: a <= b,
    "in": lambda a, b: a.isin(list(b)),
    "not in": lambda a, b: ~a.isin(list(b)),
    "contains": lambda a, b: a.contains(b),
    "equals": lambda a, b: a == b,
    "startswith": lambda a, b: a.startswith(b),
    "is null": lambda a, b: a.isNull(),
    "not null": lambda a, b: a.isNotNull(),
    "==true": lambda a, b: a == F.lit(True),
}

#: The prediction target never enters a rule.
TARGET = "lead_submit"


def condition(field: Column | str, op: str, value=None) -> Column:
    """One comparison of the condition vocabulary."""
    if op not in OPS:
        raise ValueError(f"unknown operator {op!r}; known: {sorted(OPS)}")
    column = F.col(field) if isinstance(field, str) else field
    if op not in ("in", "not in", "is null", "not null") and value is not None and not isinstance(value, Column):
        value = F.lit(value)
    return OPS[op](column, value)


def conditions(specs: list[tuple], joined: str = "and") -> Column:
    """A list of (field, op, value) as one predicate; an empty list holds always."""
    columns = [condition(*s) for s in specs]
    if not columns:
        return F.lit(True)
    return reduce((lambda a, b: a & b) if joined == "and" else (lambda a, b: a | b), columns)


def names_users(specs: list[tuple], id_fields: tuple[str, ...] = ("user_id", "c_custkey")) -> bool:
    """Whether a condition list singles out users by id, which would fit the sample and nothing else."""
    return any(s[0] in id_fields for s in specs)


def without_users(conditions: DataFrame, id_fields: tuple[str, ...] = ("user_id", "c_custkey")) -> DataFrame:
    """``(rule, n_conditions)`` of the rules in ``conditions(rule, field, ...)`` that name no user: ``names_users`` for a table of rules."""
    named = F.lower(F.trim("field")).isin(*id_fields)
    return conditions.groupBy("rule").agg(F.count("*").alias("n_conditions"), F.max(F.coalesce(named, F.lit(False))).alias("_named")).where("not _named").drop("_named")


def attribute(name: str, attrs: Column | str = "attrs") -> Column:
    return F.get_json_object(attrs if isinstance(attrs, Column) else F.col(attrs), f"$.{name}")


def _key(atom: dict) -> str:
    return json.dumps(atom, sort_keys=True, ensure_ascii=False, default=str)


def atoms_of(rule: dict) -> list[dict]:
    for k in ("all", "any"):
        if k in rule:
            return [a for r in rule[k] for a in atoms_of(r)]
    return atoms_of(rule["not"]) if "not" in rule else [rule]


def _of_types(types) -> Column:
    types = [types] if isinstance(types, str) else list(types)
    return F.col("event_type").isin(types) & (F.col("event_type") != TARGET)


def _matches(atom: dict) -> Column:
    cond = _of_types(atom["raw"])
    for a, op, v in atom.get("where", []):
        cond = cond & condition(attribute(a), op, v)
    return cond


def _measure(atom: dict) -> list[Column]:
    """What an atom needs of the raw events, as aggregates."""
    if "before" in atom:
        a, b = atom["before"]
        return [F.max(F.when(_of_types(a), F.col("event_time"))), F.min(F.when(_of_types(b), F.col("event_time")))]
    if "same" in atom:
        a, x, b, y = atom["same"]
        return [F.collect_set(F.when(_of_types(a), attribute(x))), F.collect_set(F.when(_of_types(b), attribute(y)))]
    cond, stat = _matches(atom), atom.get("stat", "exists")
    if stat in ("exists", "count"):
        return [F.count_if(cond)]
    if stat == "contains":
        return [F.count_if(cond & F.col("attrs").contains(atom["value"]))]
    if stat == "days":
        return [F.size(F.collect_set(F.when(cond, F.to_date("event_time"))))]
    if stat == "dur_max":
        return [F.max(F.when(cond, F.col("dwell")))]
    if stat == "distinct":
        return [F.size(F.collect_set(F.when(cond, attribute(atom["attr"]))))]
    raise ValueError(f"unknown statistic {stat!r}")


def _derived_measure(atom: dict) -> Column:
    cond = F.col("derived_event_type") == atom["event"]
    return F.max(F.when(cond, F.to_date("event_time"))) if atom.get("stat") == "days_since" else F.count_if(cond)


def _holds(atom: dict, columns: list[str], run_date: Column) -> Column:
    c = [F.col(f"`{x}`") for x in columns]
    if "before" in atom:
        return F.coalesce(c[0] < c[1], F.lit(False))
    if "same" in atom:
        return F.coalesce(F.arrays_overlap(c[0], c[1]), F.lit(False))
    stat = atom.get("stat", "exists")
    if stat in ("exists", "contains"):
        return F.coalesce(c[0] > 0, F.lit(False))
    if stat == "days_since":
        return F.coalesce(condition(F.datediff(run_date, c[0]), atom["op"], atom["value"]), F.lit(False))
    measured = c[0] if stat == "dur_max" else F.coalesce(c[0], F.lit(0))
    # A user without any such event has no group in the source and so never matches.
    some = F.lit(True) if stat == "dur_max" else measured > 0
    return F.coalesce(some & condition(measured, atom["op"], atom["value"]), F.lit(False))


def rule_frame(
    profile: DataFrame,
    rules: dict[str, dict],
    raw: DataFrame | None = None,
    derived: DataFrame | None = None,
    run_date: Column | None = None,
) -> DataFrame:
    """``profile`` with one boolean column for each rule.

    All distinct atoms of all rules are measured in one pass over each event table (``raw``: user_id,
    event_type, event_time, dwell, attrs as JSON text; ``derived``: user_id, derived_event_type, event_time) and
    joined to the profile once.  Every user of the profile is in the result, so a negated rule is the complement
    among all users.
    """
    run_date = F.current_date() if run_date is None else run_date
    atoms = {_key(a): a for r in rules.values() for a in atoms_of(r)}
    where: dict[str, Column] = {}
    out, n = profile, 0
    for table, wanted in ((raw, "raw"), (derived, "derived")):
        aggregates, used = [], {}
        for key, atom in atoms.items():
            kind = "derived" if "event" in atom else "profile" if "profile" in atom else "raw"
            if kind != wanted:
                continue
            measures = [_derived_measure(atom)] if kind == "derived" else _measure(atom)
            names = [f"_m{n + i}" for i in range(len(measures))]
            n += len(measures)
            aggregates += [m.alias(x) for m, x in zip(measures, names)]
            used[key] = names
        if aggregates:
            if table is None:
                raise ValueError(f"rules need the {wanted} events")
            out = out.join(table.groupBy("user_id").agg(*aggregates), "user_id", "left")
            where |= {k: _holds(atoms[k], names, run_date) for k, names in used.items()}
    for key, atom in atoms.items():
        if "profile" in atom:
            where[key] = F.coalesce(condition(atom["profile"], atom["op"], atom["value"]), F.lit(False))

    def build(rule: dict) -> Column:
        if "all" in rule:
            return reduce(lambda a, b: a & b, map(build, rule["all"]))
        if "any" in rule:
            return reduce(lambda a, b: a | b, map(build, rule["any"]))
        return ~build(rule["not"]) if "not" in rule else where[_key(rule)]

    keep = [F.col(f"`{c}`") for c in profile.columns]
    return out.select(*keep, *[build(r).alias(name) for name, r in rules.items()])


def matches(frame: DataFrame, names: list[str], id_col: str = "user_id") -> DataFrame:
    """Rule columns as rows ``(user_id, rule)``, one for each rule that holds."""
    hits = F.array_compact(F.array(*[F.when(F.col(f"`{n}`"), F.lit(n)) for n in names]))
    return frame.select(id_col, F.explode(hits).alias("rule"))


# ── audiences as bitmaps ───────────────────────────────────────────────────


def bitmaps(members: DataFrame, by: str, id_col: str = "user_id") -> DataFrame:
    """``(by, bucket, bitmap)``: an audience's ids as bitmaps of 32,768 each."""
    return members.groupBy(by, F.bitmap_bucket_number(id_col).alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(F.col(id_col))).alias("bitmap")
    )


def bitmap_sizes(maps: DataFrame, by: str) -> DataFrame:
    return maps.groupBy(by).agg(F.sum(F.bitmap_count("bitmap")).alias("users"))


def combined(maps: DataFrame, by: str, names: list[str], how: str = "or") -> DataFrame:
    """The union or intersection of several audiences, bucket by bucket; a bucket that one lacks is empty in it."""
    chosen = maps.where(F.col(by).isin(names))
    merge = F.bitmap_or_agg("bitmap") if how == "or" else F.bitmap_and_agg("bitmap")
    merged = chosen.groupBy("bucket").agg(merge.alias("bitmap"), F.count_distinct(by).alias("n"))
    return merged.where(F.lit(how == "or") | (F.col("n") == len(set(names)))).select("bucket", "bitmap")
