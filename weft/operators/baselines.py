"""Baseline scorers by name, and one run over all of them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.functions import similarity as sim

#: Scorers of pairs with a_* and c_* columns, by task and name.  An auxiliary one isn't a fair competitor.
SCORERS: dict[str, dict[str, Callable[[], Column]]] = {"AND": {}, "AIN": {}}
AUXILIARY = frozenset({"same_id"})


def scorer(task: str, name: str):
    """Registers a function that gives a score Column."""

    def add(function):
        SCORERS[task][name] = function
        return function

    return add


def _sides(*names: str) -> list[Column]:
    return [F.col(f"{s}_{n}") for n in names for s in "ac"]


@scorer("AND", "deterministic")
def _deterministic_and() -> Column:
    return sim.deterministic_and(*_sides("author_norm", "record_affil_prefix"))


@scorer("AND", "fuzzy")
def _fuzzy_and() -> Column:
    return sim.fuzzy_and(*_sides("author_norm", "record_affil_prefix", "year_int"))


@scorer("AND", "context")
def _context_and() -> Column:
    return sim.and_context_score("a_", "c_")


@scorer("AND", "same_id")
def _same_id() -> Column:
    return sim.equal_filled(*_sides("author_id"))


@scorer("AIN", "deterministic")
def _deterministic_ain() -> Column:
    return sim.equal_filled(*_sides("affil_norm"))


@scorer("AIN", "fuzzy")
def _fuzzy_ain() -> Column:
    return sim.fuzzy_ain(*_sides("affil_norm", "affil_acronyms"))


@scorer("AIN", "context")
def _context_ain() -> Column:
    return sim.ain_context_score("a_", "c_")


def run(sides: DataFrame, task: str, names: list[str] | None = None) -> DataFrame:
    """(anchor_id, candidate_id, system, score, auxiliary): every pair by every scorer, or by those named.

    One pass: the scores of a pair are one array, exploded.  An unknown name is an error."""
    chosen = names or sorted(SCORERS[task])
    if unknown := [n for n in chosen if n not in SCORERS[task]]:
        raise ValueError(f"no such scorer for {task}: {unknown}")
    scored = sides.select("anchor_id", "candidate_id", *(SCORERS[task][n]().alias(f"s{i}") for i, n in enumerate(chosen)))
    cells = F.array(*(F.struct(F.lit(n).alias("system"), F.col(f"s{i}").alias("score"), F.lit(n in AUXILIARY).alias("auxiliary")) for i, n in enumerate(chosen)))
    return scored.select("anchor_id", "candidate_id", F.explode(cells).alias("x")).select("anchor_id", "candidate_id", "x.*")
