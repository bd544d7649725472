"""Sections of reports as declared fields, the advice in them as one table, and the rules by which advice is chosen."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from heapq import nlargest, nsmallest
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import replay


def r6(x) -> float:
    return round(float(x or 0.0), 6) + 0.0


def share(part: float, whole: float) -> float | None:
    return round(part / whole, 4) if whole else None


def same(x):
    return x


#: A field of a report: its key, how its value is made, and the columns of a row of totals that it is made of.
Field = tuple

#: What a replay says of its batches.
BATCHES: tuple[Field, ...] = (
    ("batches", same, "batches"), ("outputs_evicted", same, "items"), ("tokens", round, "tokens"), ("share_batches_that_pay", share, "pay_batches", "batches"), ("share_tokens_in_paying_batches", share, "pay_tokens", "tokens"),
    ("saved_read_usd", r6, "saved"), ("rewrite_usd", r6, "rewrite"), ("refetch_usd", r6, "refetch"), ("refetch_cost_if_all_come_back_usd", r6, "unit"), ("of_which_extra_round_trips_usd", r6, "trips"), ("net_usd", r6, "net"),
    ("net_usd_if_only_paying_batches", r6, "net_paying"), ("breakeven_refetch_rate", replay.breakeven_rate, "net", "refetch", "unit"),
)
#: What a cap on outputs would save.
CAPPED: tuple[Field, ...] = (("outputs", same, "capped"), ("excess_tokens", round, "over"), ("excess_usd", r6, "saving"))


def over(limit: int) -> tuple[Field, ...]:
    """What outputs above a limit cost."""
    return tuple((f"{name}_over_{limit // 1000}k", how, f"{column}_{limit}") for name, how, column in (("outputs", same, "n"), ("tokens", round, "tokens"), ("usd", r6, "usd")))


def told(totals: dict, fields: Iterable[Field], **first) -> dict:
    """A section: what is given first, then the fields of a row of totals."""
    return first | {key: how(*map(totals.get, columns)) for key, how, *columns in fields}


# ---- choosing


class Advice(NamedTuple):
    kind: str
    audit: str
    net: float
    sound: bool
    body: dict


def advice(audits: dict) -> Iterator[Advice]:
    """The fixes and tricks of all audits. A fix is sound if it clears break-even for sure, a trick if there was something to evaluate."""
    for audit, section in ((k, v) for k, v in audits.items() if isinstance(v, dict)):
        if fix := section.get("fix"):
            yield Advice("fix", audit, fix["net_usd"], fix["clears_breakeven"] and not fix["upper_bound"], fix)
        if trick := section.get("trick"):
            yield Advice("trick", audit, trick["net_usd"], trick["evaluated"], trick)


def top_fixes(audits: dict, n: int = 3) -> list[dict]:
    """The sound fixes that gain most, each with the audit that it comes from."""
    gains = (a for a in advice(audits) if a.kind == "fix" and a.sound and a.net > 0)
    return [a.body | {"audit": a.audit} for a in nlargest(n, gains, key=lambda a: a.net)]


def costly_trick(audits: dict) -> dict | None:
    """The evaluated trick that loses most."""
    losses = (a for a in advice(audits) if a.kind == "trick" and a.sound and a.net < 0)
    return next((a.body for a in nsmallest(1, losses, key=lambda a: a.net)), None)


def best(rows: DataFrame, n: int = 3) -> DataFrame:
    """The same choice of fixes from a table (id, net, sound) of any size: Spark keeps n rows of each task."""
    return rows.where("sound and net > 0").orderBy(F.desc("net"), "id").limit(n).select("id", "net")


def worst(rows: DataFrame) -> DataFrame:
    """The same choice of a trick, as one row; nulls if none loses."""
    return rows.where("sound and net < 0").agg(F.min_by("id", F.struct("net", "id")).alias("id"), F.min("net").alias("net"))


def dominant(spend: dict[str, float]) -> str | None:
    """The model that most was spent on, if anything was."""
    return next((m for m, x in nlargest(1, spend.items(), key=lambda mx: mx[1]) if x > 0), None)


def dominant_of(model: Column, spent: Column) -> Column:
    """The same as an aggregate over rows of one model each; of equal ones the first by name."""
    least = F.min(F.when(spent > 0, F.struct((-spent).alias("less"), model.alias("model"))))
    return F.struct(least["model"].alias("model"), (-least["less"]).alias("cost"))
