"""Request plans: normalising what was read, filling defaults, checking arguments; providers as ports."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.functions.interpret import BOROUGHS, NEIGHBORHOODS, SOFT
from larkspur.operators.errors import Refused
from larkspur.operators.filters import PlaceFilter


@dataclass(frozen=True)
class Plan:
    """A filter, soft conditions as (words, topic), and warnings about what was changed."""

    wanted: PlaceFilter = PlaceFilter()
    soft: tuple[tuple[str, str], ...] = ()
    warnings: tuple[str, ...] = field(default=())


def normalise(plan: Plan) -> Plan:
    """A borough that is a neighbourhood becomes an address filter, a cuisine that is a soft topic a soft condition, ratings are clamped; each with a warning."""
    wanted, soft, warnings = plan.wanted, list(plan.soft), list(plan.warnings)
    area = (wanted.borough or "").strip().lower()
    if area in BOROUGHS:
        wanted = replace(wanted, borough=BOROUGHS[area])
    elif area in NEIGHBORHOODS or area in {n.lower() for n in NEIGHBORHOODS.values()}:
        name = NEIGHBORHOODS.get(area) or next(n for n in NEIGHBORHOODS.values() if n.lower() == area)
        wanted = replace(wanted, borough=None, neighborhood=wanted.neighborhood or name)
        warnings.append(f"{area} is a neighbourhood")
    elif area:
        wanted = replace(wanted, borough=None)
        warnings.append(f"{area} is no borough")
    kept = []
    for cuisine in wanted.cuisines:
        if cuisine.lower() in SOFT:
            soft.append((cuisine, SOFT[cuisine.lower()]))
            warnings.append(f"{cuisine} is a soft condition")
        else:
            kept.append(cuisine)
    wanted = replace(wanted, cuisines=tuple(kept))
    if wanted.min_rating is not None and not 0 <= wanted.min_rating <= 5:
        wanted = replace(wanted, min_rating=min(5.0, max(0.0, wanted.min_rating)))
        warnings.append("rating clamped")
    return Plan(wanted, union_soft(soft, ()), tuple(dict.fromkeys(warnings)))


def union_soft(first, second) -> tuple[tuple[str, str], ...]:
    """Both lists in order, without repeats of words in any case under the same topic."""
    out: dict[tuple[str, str], tuple[str, str]] = {}
    for words, topic in (*first, *second):
        out.setdefault((words.lower(), topic), (words, topic))
    return tuple(out.values())


def fill(given: PlaceFilter, planned: PlaceFilter) -> tuple[PlaceFilter, list[str]]:
    """Given values win, the plan fills gaps; and the names of what was filled."""
    empty, filled, out = PlaceFilter(), [], given
    for name in given.__dataclass_fields__:
        if getattr(given, name) == getattr(empty, name) and getattr(planned, name) != getattr(empty, name):
            out = replace(out, **{name: getattr(planned, name)})
            filled.append(name)
    return out, filled


KINDS = {"string": str, "integer": int, "number": (int, float), "boolean": bool, "array": list, "object": dict}


def check_arguments(schema: dict, arguments: dict) -> None:
    """Required names, no unknown ones, and the type and choices of each."""
    known = schema.get("properties", {})
    if missing := [n for n in schema.get("required", ()) if n not in arguments]:
        raise Refused(f"missing: {', '.join(missing)}")
    if unknown := [n for n in arguments if n not in known]:
        raise Refused(f"unknown: {', '.join(sorted(unknown))}")
    for name, value in arguments.items():
        rule = known[name]
        kind = KINDS[rule["type"]]
        if not isinstance(value, kind) or (isinstance(value, bool) and rule["type"] in ("integer", "number")):
            raise Refused(f"{name} isn't of type {rule['type']}")
        if "enum" in rule and value not in rule["enum"]:
            raise Refused(f"{name} isn't one of its choices")


def fake_vector(text: str, size: int) -> list[float]:
    """A deterministic unit vector of a text: FNV-1a of its bytes, then a sine per component."""
    code = 0xCBF29CE484222325
    for byte in text.encode():
        code = ((code ^ byte) * 0x100000001B3) & (1 << 64) - 1
    raw = [math.sin(code % 1_000_003 + i + 1) for i in range(size)]
    norm = math.sqrt(sum(x * x for x in raw))
    return [x / norm for x in raw]


def embed(df: DataFrame, text: str, size: int, provider: Callable[[list[str]], list[list[float]]] | None = None) -> DataFrame:
    """Add ``embedding`` from a provider of batches; the deterministic stand-in by default."""
    make = provider or (lambda texts: [fake_vector(t, size) for t in texts])

    @F.pandas_udf("array<float>")
    def vectors(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(make(batch.fillna("").tolist()))

    return df.withColumn("embedding", vectors(F.col(text)))


def compact_label(seconds: Column) -> Column:
    """'12s', '3m04s', '2h05m'; '?' for what is negative or no number."""
    s = F.floor(seconds)
    hours, minutes = F.floor(s / 3600), F.floor(s % 3600 / 60)
    known = F.when(hours > 0, F.format_string("%dh%02dm", hours, minutes)).when(minutes > 0, F.format_string("%dm%02ds", minutes, s % 60)).otherwise(F.concat(s.cast("string"), F.lit("s")))
    return F.when((seconds < 0) | F.isnan(seconds.cast("double")), "?").otherwise(known)


def size_label(n: Column, largest: str = "TiB") -> Column:
    """Bytes as 512B, or with one decimal in KiB, MiB, GiB or TiB, none above the largest."""
    from larkspur.functions.text import one_decimal

    out = F.concat(n.cast("string"), F.lit("B"))
    units = ("KiB", "MiB", "GiB", "TiB")
    for power, unit in enumerate(units[: units.index(largest) + 1], start=1):
        out = F.when(n >= 1024**power, F.concat(one_decimal(n / float(1024**power)), F.lit(unit))).otherwise(out)
    return out


def count_label(n: Column) -> Column:
    """A count with a comma between thousands."""
    return F.format_number(n, 0)


def hash_label(text: Column, length: int = 12) -> Column:
    """The first characters of a hash and an ellipsis; a shorter text as it is."""
    return F.when(F.length(text) <= length, text).otherwise(F.concat(F.left(text, F.lit(length)), F.lit("…")))


def time_label(at: Column) -> Column:
    """A UTC time as 2024-01-05 18:00:00Z; '-' where there is none."""
    return F.coalesce(F.concat(F.date_format(at, "yyyy-MM-dd HH:mm:ss"), F.lit("Z")), F.lit("-"))


def elapsed_label(ms: Column) -> Column:
    """'250ms', '1.5s', '2m 5s'."""
    from larkspur.functions.text import one_decimal

    minutes = F.format_string("%dm %ds", F.floor(ms / 60000), F.floor(ms % 60000 / 1000 + 0.5).cast("long"))
    return F.when(ms < 1000, F.concat(ms.cast("string"), F.lit("ms"))).when(ms < 60000, F.concat(one_decimal(ms / 1000), F.lit("s"))).otherwise(minutes)
