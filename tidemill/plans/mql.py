"""Filter documents and aggregation pipelines, compiled to column expressions and DataFrame steps.

Filters: equality, $gt $gte $lt $lte $ne $in $exists $regex/$options $type, $and, $or. Dotted keys are paths. A missing
field is a null column value; a filter that is null for a row leaves it out, and there is no negation, so comparisons stay
bare and reach the scan. Pipelines: $match $group $sort $limit $project $unwind, with accumulators $sum and $push and
the expressions $year $month $dayOfMonth $hour $week (with timezone), $concatArrays, $ifNull.
"""

from __future__ import annotations

from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dates

COMPARE = {"$gt": "__gt__", "$gte": "__ge__", "$lt": "__lt__", "$lte": "__le__"}
TYPES = {"string": "string", "int": "int", "long": "bigint", "double": "double", "bool": "boolean", "array": "array", "date": "timestamp"}


def _all(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def condition(name: str, wanted: Any, df: DataFrame | None = None) -> Column:
    field = F.col(name)
    if not (isinstance(wanted, dict) and wanted and all(str(k).startswith("$") for k in wanted)):
        return field.isNull() if wanted is None else field == F.lit(wanted)
    out = []
    for op, value in wanted.items():
        if op in COMPARE:
            out.append(getattr(field, COMPARE[op])(F.lit(value)))
        elif op == "$ne":
            out.append(field.isNotNull() if value is None else (field != F.lit(value)) | field.isNull())
        elif op == "$in":
            known = [v for v in value if v is not None]
            inside = field.isin(known) if known else F.lit(False)
            out.append(inside | field.isNull() if None in value else inside)
        elif op == "$exists":
            out.append(field.isNotNull() if value else field.isNull())
        elif op == "$regex":
            flags = wanted.get("$options", "")
            out.append(F.rlike(field, F.lit(f"(?{flags}){value}" if flags else value)))
        elif op == "$type":
            out.append(field.isNotNull() & (F.typeof(field).startswith(TYPES.get(value, value))))
        elif op != "$options":
            raise ValueError(f"unknown operator {op}")
    return _all(out)


def compile_filter(spec: dict[str, Any] | None) -> Column:
    """An empty or missing filter matches everything."""
    out = []
    for key, value in (spec or {}).items():
        if key == "$and":
            out.append(_all([compile_filter(x) for x in value]))
        elif key == "$or":
            out.append(reduce(lambda a, b: a | b, [compile_filter(x) for x in value], F.lit(False)))
        elif key.startswith("$"):
            raise ValueError(f"unknown operator {key}")
        else:
            out.append(condition(key, value))
    return _all(out)


def combine(conditions: dict[str, Any], operator: str = "and") -> dict[str, Any]:
    """Named conditions as one filter document: nothing for none, the condition itself for one."""
    if operator not in ("and", "or", "$and", "$or"):
        raise ValueError(f"operator must be and or or, not {operator}")
    parts = [{k: v} for k, v in conditions.items() if k]
    return {} if not parts else parts[0] if len(parts) == 1 else {"$" + operator.lstrip("$"): parts}


def shell_text(collection: str, spec: dict[str, Any]) -> str:
    """A filter as the text of a shell query, for logs."""
    import datetime
    import json

    def plain(value: Any) -> Any:
        if isinstance(value, (datetime.datetime, datetime.date)):
            return f"ISODate({value.isoformat()})"
        raise TypeError(type(value).__name__)

    return f"db.{collection}.find({json.dumps(spec, ensure_ascii=False, default=plain)})"


def expression(spec: Any) -> Column:
    """A value expression of $group or $project."""
    if isinstance(spec, str) and spec.startswith("$"):
        return F.col(spec[1:])
    if not isinstance(spec, dict):
        return F.lit(spec)
    if len(spec) != 1 or not next(iter(spec)).startswith("$"):
        return F.struct(*[expression(v).alias(k) for k, v in spec.items()])
    op, value = next(iter(spec.items()))
    parts = {"$year": F.year, "$month": F.month, "$dayOfMonth": F.dayofmonth, "$hour": F.hour, "$week": dates.sunday_week}
    if op in parts:
        zone = value.get("timezone", "UTC") if isinstance(value, dict) else "UTC"
        source = expression(value["date"] if isinstance(value, dict) else value)
        return parts[op](dates.to_local(source, zone) if zone != "UTC" else source)
    if op == "$ifNull":
        return F.coalesce(*map(expression, value))
    if op == "$concatArrays":
        return F.concat(*map(expression, value))
    raise ValueError(f"unknown expression {op}")


def _group(df: DataFrame, spec: dict[str, Any]) -> DataFrame:
    key = spec["_id"]
    keys = {"_id": F.lit(None)} if key is None else {k: expression(v) for k, v in key.items()} if isinstance(key, dict) and not next(iter(key)).startswith("$") else {"_id": expression(key)}
    sums = []
    for name, use in spec.items():
        if name == "_id":
            continue
        op, value = next(iter(use.items()))
        if op == "$sum":
            sums.append((F.count(F.lit(1)) * value if isinstance(value, int) else F.sum(expression(value))).alias(name))
        elif op == "$push":
            sums.append(F.collect_list(expression(value)).alias(name))
        else:
            raise ValueError(f"unknown accumulator {op}")
    return df.groupBy(*[c.alias(k) for k, c in keys.items()]).agg(*sums)


def aggregate(df: DataFrame, pipeline: list[dict[str, Any]]) -> DataFrame:
    """Keys of a compound _id become columns of their own."""
    for stage in pipeline:
        (op, spec), = stage.items()
        if op == "$match":
            df = df.where(compile_filter(spec))
        elif op == "$group":
            df = _group(df, spec)
        elif op == "$sort":
            df = df.orderBy(*[F.col(k.removeprefix("_id.")).asc() if d > 0 else F.col(k.removeprefix("_id.")).desc() for k, d in spec.items()])
        elif op == "$limit":
            df = df.limit(spec)
        elif op == "$project":
            shown = {k: v for k, v in spec.items() if v not in (0, False)}
            df = df.select(*[F.col(k) if v in (1, True) and not isinstance(v, (dict, str)) else expression(v).alias(k) for k, v in shown.items()]) if shown else df.drop(*spec)
        elif op == "$unwind":
            name = (spec if isinstance(spec, str) else spec["path"]).lstrip("$")
            df = df.withColumn(name, F.explode(name))
        else:
            raise ValueError(f"unknown stage {op}")
    return df
