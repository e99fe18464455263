"""Scores of records, as column expressions. Fixed values come from the data model and can be replaced."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import contains_any, count_markers, join_nonblank


@dataclass(frozen=True)
class ScoreConfig:
    """Weights of the rating dimensions, multipliers of the classes, word lists."""

    weights: dict = field(
        default_factory=lambda: {"影响深度": 3.0, "新颖性与异常性": 2.5, "演化与连锁潜力": 2.0, "影响广度": 1.5, "可行动性": 1.5, "舆情及认知影响": 0.5}
    )
    multipliers: dict = field(
        default_factory=lambda: {"政治与安全": 1.15, "经济与金融": 1.05, "科技与网络": 1.00, "社会与环境": 0.95, "无情报价值": 0.00}
    )
    worthless: str = "无情报价值"
    novelty: str = "新颖性与异常性"
    action: str = "可行动性"
    evolution: str = "演化与连锁潜力"
    recap: tuple = (
        "回顾", "复盘", "盘点", "总结", "综述", "周报", "月报", "年报", "年度", "季度", "一周", "本周", "上周", "要闻", "汇总", "合集",
        "时间线", "梳理", "十大", "观察", "回看", "进展汇编",
    )
    stale: tuple = (
        "新增事实有限", "无新增事实", "旧闻", "重复报道", "相似消息已覆盖", "总结类", "回顾类", "汇编类", "复述", "背景梳理",
    )
    markers: tuple = ("；", "。此外", "同时", "另一方面", "其一", "其二", "第一", "第二", "第三")


def clamp(value: Column) -> Column:
    """0 to 10; what is no number is 0."""
    return F.least(F.lit(10.0), F.greatest(F.lit(0.0), F.nanvl(F.coalesce(value.try_cast("double"), F.lit(0.0)), F.lit(0.0))))


def rate(rates: Column, key: str) -> Column:
    return clamp(F.try_element_at(rates, F.lit(key)))


def intelligence_score(
    rates: Column, taxonomy: Column, headline: Column, text: Column, similarity: Column | None = None, config: ScoreConfig | None = None, digits: int = 1
) -> Column:
    """Weighted rating out of ten, scaled by class, lowered for recaps, stale or repeated news and lists of events, capped
    where nothing can be done or nothing is new. headline is the joined title, brief, reason and tips."""
    c = config or ScoreConfig()
    known, keys = _known(rates, taxonomy, headline, text, similarity, c)
    # what is named often is evaluated once: the optimizer doesn't merge an expression into a function of an element
    once = F.array(F.struct(*[v.alias(k) for k, v in known.items()]))
    clamped = lambda x: F.struct(*[x[k].alias(k) for k in known if k != "rates"], *[rate(x["rates"], key).alias(f"r{i}") for i, key in enumerate(keys)])
    return F.element_at(F.transform(F.transform(once, clamped), lambda x: _lowered(x, keys, c, digits)), 1)


def with_intelligence_score(
    df: DataFrame,
    name: str,
    rates: Column,
    taxonomy: Column,
    headline: Column,
    text: Column,
    similarity: Column | None = None,
    config: ScoreConfig | None = None,
    digits: int = 1,
) -> DataFrame:
    """df with the column `name`, the intelligence_score of the same arguments. For whole tables: what is named often is a
    column of a projection before, so everything is compiled code, where the expression above is interpreted."""
    c = config or ScoreConfig()
    known, keys = _known(rates, taxonomy, headline, text, similarity, c)
    taken, prefix = [x.lower() for x in df.columns], "_score_"
    while any(x.startswith(prefix) for x in taken):
        prefix = f"_{prefix}"
    kept = [F.col(f"`{x}`") for x in df.columns if x.lower() != name.lower()]
    rows = df.select("*", *[v.alias(prefix + k) for k, v in known.items()])
    clamped = [rate(F.col(f"{prefix}rates"), key).alias(f"{prefix}r{i}") for i, key in enumerate(keys)]
    rows = rows.select(*kept, *[prefix + k for k in known if k != "rates"], *clamped)
    at = {k: F.col(prefix + k) for k in known} | {f"r{i}": F.col(f"{prefix}r{i}") for i in range(len(keys))}
    return rows.select(*kept, _lowered(at, keys, c, digits).alias(name))


def _known(rates: Column, taxonomy: Column, headline: Column, text: Column, similarity: Column | None, c: ScoreConfig) -> tuple[dict[str, Column], list[str]]:
    """What the score is made from, by name, and the rated dimensions."""
    known = {"tax": taxonomy, "similar": F.coalesce(similarity, F.lit(0.0)) if similarity is not None else F.lit(0.0)}
    known |= {"recap": contains_any(headline, list(c.recap)), "stale": contains_any(headline, list(c.stale)), "marks": count_markers(text, list(c.markers))}
    known["rates"] = rates
    return known, [*c.weights, *(k for k in (c.novelty, c.action, c.evolution) if k not in c.weights)]


def _lowered(x: Column | dict[str, Column], keys: list[str], c: ScoreConfig, digits: int) -> Column:
    at = {key: x[f"r{i}"] for i, key in enumerate(keys)}
    score = F.lit(0.0)
    for key, weight in c.weights.items():
        score += at[key] * weight
    score = score / (sum(c.weights.values()) * 10) * 10
    factor = F.lit(1.0)
    for name, value in c.multipliers.items():
        factor = F.when(x["tax"] == name, value).otherwise(factor)
    score = score * factor
    novelty, action, evolution = at[c.novelty], at[c.action], at[c.evolution]
    lowered = [
        (x["recap"], 0.35, 3.0),
        (x["stale"], 0.5, 3.0),
        ((x["similar"] >= 0.86) & (novelty <= 3), 0.35, 2.5),
        ((x["similar"] >= 0.92) & (novelty <= 2), 0.25, 2.0),
        ((x["marks"] >= 5) & (novelty <= 4), 0.55, 3.5),
        ((action <= 2) & (novelty <= 3), 1.0, 3.0),
        ((novelty <= 2) & (action <= 2) & (evolution <= 3), 1.0, 2.0),
    ]
    for when, times, most in lowered:  # each step names the score once, so the expression grows with the steps only
        hit = F.coalesce(when, F.lit(False))
        score = F.least(score * F.when(hit, times).otherwise(1.0), F.when(hit, most).otherwise(F.lit(float("inf"))))
    score = F.round(F.least(F.lit(10.0), F.greatest(F.lit(0.0), score)), digits)
    return F.when(F.coalesce(x["tax"] == c.worthless, F.lit(False)), 0.0).otherwise(score)


def headline(title: Column, brief: Column, reason: Column, tips: Column) -> Column:
    return join_nonblank(" ", title, brief, reason, tips)


def argmax(rates: Column, without: list[str]) -> Column:
    """struct(score, key) of the highest rating outside `without`; equal ratings: the first key."""
    kept = F.map_filter(rates, lambda k, v: ~k.isin(without) if without else F.lit(True))
    entries = F.transform(F.map_entries(kept), lambda e: F.struct(e["value"].alias("score"), e["key"].alias("key")))
    return F.aggregate(
        entries,
        F.lit(None).cast("struct<score:double,key:string>"),
        lambda a, e: F.when(
            a.isNull() | (e["score"] > a["score"]) | ((e["score"] == a["score"]) & (e["key"] < a["key"])),
            F.struct(e["score"].cast("double").alias("score"), e["key"].alias("key")),
        ).otherwise(a),
    )


def hybrid(similarity: Column, shared: Column, days: Column) -> Column:
    """Edge score: similarity, number of shared entities, distance in days."""
    return 0.6 * similarity + 0.4 * F.least(shared * 0.5, F.lit(1.0)) - 0.008 * F.abs(days)


def hybrid_reason(similarity: Column, shared: Column, days: Column) -> Column:
    penalty = 0.008 * F.abs(days)
    return F.concat_ws(
        " | ",
        F.format_string("VecSim: %.2f", similarity),
        F.when(F.size(shared) > 0, F.concat(F.lit("Shared Entities: "), F.concat_ws(", ", F.slice(F.sort_array(shared), 1, 3)))),
        F.when(penalty > 0, F.format_string("Time Penalty: -%.2f (%.1f days)", penalty, F.abs(days))),
    )


def reduced(rates: Column) -> tuple[Column, Column]:
    """Ratings lowered by one, not below zero, and whether the record is to be dropped: nothing is left above zero."""
    less = F.transform_values(rates, lambda _, v: F.greatest(F.lit(0.0), v.cast("double") - 1))
    top = F.coalesce(F.array_max(F.map_values(rates)), F.lit(0.0))
    return less, top <= 1


def usage(used: Column, limit: Column, recommend_below: float = 80.0) -> tuple[Column, Column, Column]:
    """Percentage used (0 without a limit), available, recommended."""
    percent = F.when(limit > 0, used / limit * 100).otherwise(0.0)
    return percent, (limit <= 0) | (used < limit), percent < recommend_below
