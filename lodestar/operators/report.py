"""A short text from the few rows of a finished run; the rows are those of the search's limit."""

from __future__ import annotations

import textwrap

from pyspark.sql import DataFrame

_ORDER = {"alta": 0, "media": 1, "baixa": 2}


def ordered(recommendations: DataFrame, entity: str) -> list[tuple[str, str]]:
    """Entities by their best priority, those without any last, then by name."""
    from pyspark.sql import functions as F

    rank = F.when(F.col("priority") == "alta", 0).when(F.col("priority") == "media", 1).when(F.col("priority") == "baixa", 2).otherwise(3)
    best = recommendations.groupBy(entity).agg(F.min(rank).alias("rank")).orderBy("rank", entity)
    names = {v: k for k, v in _ORDER.items()} | {3: "none"}
    return [(r[entity], names[r["rank"]]) for r in best.collect()]


def banner(found: int, discriminates: bool) -> str | None:
    """What stands above a report that has no rows, or whose request does not tell entities apart."""
    if not found:
        return "nothing in the data answers this request"
    return None if discriminates else "the request names no filter: what follows is in order of names, not of fit"


def render(request: str, strategy: str, rows: list[dict], discriminates: bool = True) -> str:
    """``rows``: ``name``, ``class``, ``quadrant``, ``priority``, ``evidence`` (quotes), and if there, ``confidence``,
    ``excluded`` (reasons) and ``unverified``. Excluded entities come last, with their reasons."""
    lines = [request.upper(), "=" * 64, *textwrap.wrap(strategy, 64)]
    if said := banner(len(rows), discriminates):
        lines += ["", said]
    for r in sorted(rows, key=lambda r: bool(r.get("excluded"))):
        head = f"{r['name']}: {r['class']}, {r['quadrant']}, priority {r['priority']}"
        lines += ["", head + (f", confidence {r['confidence']}" if r.get("confidence") else "")]
        lines += [f'  "{q[:150]}"' for q in r["evidence"][:2]]
        lines += [f"  {label}: {'; '.join(r[k])}" for k, label in (("excluded", "not eligible"), ("unverified", "to be checked")) if r.get(k)]
    return "\n".join(lines)
