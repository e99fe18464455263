"""Lists, maps and JSON."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def concat_lists(*lists: Column) -> Column:
    """All elements; a null list has none."""
    empty = F.array().cast("array<string>")
    return F.concat(*[F.coalesce(x, empty) for x in lists])


def rare(entities: Column, stop: list[str]) -> Column:
    """Distinct non-blank entities that are not stopped."""
    found = F.filter(F.array_distinct(entities), lambda x: x.isNotNull() & (F.trim(x) != ""))
    return F.array_except(found, F.array(*map(F.lit, stop))) if stop else found


def lookup(m: Column, key: str, default) -> Column:
    return F.coalesce(F.try_element_at(m, F.lit(key)), F.lit(default))


def without_keys(m: Column, keys: list[str]) -> Column:
    return F.map_filter(m, lambda k, _: ~k.isin(keys))


def json_path(text: Column, path: str) -> Column:
    """The scalar at a path of a JSON text; missing or malformed is null."""
    return F.get_json_object(text, path)


def json_ladder(text: Column, path: str) -> Column:
    """The scalar at a path: of the text itself, else of what stands in a code fence, else of what stands between the
    first { and the last }."""
    fenced = F.regexp_extract(text, r"(?s)```(?:json)?\s*(.*?)```", 1)
    braces = F.regexp_extract(text, r"(?s)(\{.*\})", 1)
    return F.coalesce(*[F.get_json_object(F.when(F.try_parse_json(t).isNotNull(), t), path) for t in (text, fenced, braces)])


def repaired_value(text: str | None) -> tuple[str | None, bool]:
    """JSON in order as it stands, or after simple repairs, and whether repairs were needed. Null if nothing helps."""
    if text is None:
        return None, False
    try:
        return json.dumps(json.loads(text), ensure_ascii=False), False
    except ValueError:
        pass
    body = text[text.find("{") :] if "{" in text else text
    body = body[: body.rfind("}") + 1] if "}" in body else body
    body = re.sub(r"//[^\n]*", "", body)
    body = re.sub(r"'((?:[^'\\]|\\.)*)'", lambda m: json.dumps(m[1]), body) if '"' not in body else body
    body = re.sub(r"([{,]\s*)([A-Za-z_]\w*)\s*:", r'\1"\2":', body)
    body = re.sub(r"\bTrue\b", "true", re.sub(r"\bFalse\b", "false", re.sub(r"\bNone\b", "null", body)))
    body = re.sub(r",\s*([}\]])", r"\1", body)
    for end in ("", "}", "]}", '"}', '"]}'):
        try:
            return json.dumps(json.loads(body + end), ensure_ascii=False), True
        except ValueError:
            continue
    return None, True


def repair_json(text: Column) -> Column:
    """struct(json, repaired)."""

    @F.pandas_udf("json string, repaired boolean")
    def run(values: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([repaired_value(v) for v in values], columns=["json", "repaired"])

    return run(text)


def metadata_block(pairs: dict[str, Column]) -> Column:
    """Lines of "name: value", without the null ones."""
    return F.concat_ws("\n", *[F.when(v.isNotNull(), F.concat(F.lit(f"{k}: "), v.cast("string"))) for k, v in pairs.items()])


def turn_text(role: Column, text: Column) -> Column:
    """One turn of a transcript."""
    name = F.when(role == "assistant", "reply").otherwise(role)
    return F.concat(F.lit("["), name, F.lit("] "), F.coalesce(text, F.lit("<None>")))


def prompt(template: str, values: dict[str, Column]) -> Column:
    """A template with its {NAME} placeholders filled; null is the empty text."""
    out = F.lit(template)
    for name, value in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(value.cast("string"), F.lit("")))
    return out


def table_row(*cells: Column) -> Column:
    """One row of a Markdown table."""
    return F.concat(F.lit("| "), F.concat_ws(" | ", *[F.replace(F.coalesce(c.cast("string"), F.lit("")), F.lit("|"), F.lit("\\|")) for c in cells]), F.lit(" |"))


def table_head(*names: str) -> str:
    return "| " + " | ".join(names) + " |\n| " + " | ".join("---" for _ in names) + " |"
