"""Run and evaluation settings: YAML files over documented defaults, checked when loaded."""

from __future__ import annotations

import dataclasses
import hashlib
from dataclasses import dataclass, field
from pathlib import Path


@dataclass(frozen=True)
class MatchSettings:
    """Settings of the match pipeline."""

    top_k: int = 50
    year_window: int = 5
    block_cap: int = 50
    truncation_author_count: int = 100
    t_match: float = 0.85
    t_nonmatch: float = 0.85
    m_signals: int = 2
    precision_floor: float = 0.98
    seed: int = 42

    def __post_init__(self):
        _check(self.top_k > 0 and self.block_cap > 0 and self.year_window >= 0 and self.m_signals >= 0, "counts must be positive")
        _check(all(0.0 <= x <= 1.0 for x in (self.t_match, self.t_nonmatch, self.precision_floor)), "thresholds must lie within 0 and 1")


@dataclass(frozen=True)
class EvalSettings:
    """Settings of the evaluation."""

    precision_floor: float = 0.90
    f_beta: float = 1.0
    grid_start: float = 0.0
    grid_stop: float = 1.0
    grid_step: float = 0.01
    n_bootstrap: int = 1000
    alpha: float = 0.05
    price_in: float = 3.0
    price_out: float = 15.0
    seed: int = 42
    tasks: tuple[str, ...] = ("and", "ain")
    sweep_t_match: tuple[float, ...] = field(default=(0.5, 0.6, 0.7, 0.8, 0.85, 0.9, 0.95, 0.99))
    sweep_m_signals: tuple[int, ...] = field(default=(0, 1, 2, 3))

    def __post_init__(self):
        _check(0.0 <= self.precision_floor <= 1.0 and 0.0 < self.alpha < 1.0, "floor and alpha must lie within 0 and 1")
        _check(self.grid_step > 0 and self.grid_start < self.grid_stop and self.n_bootstrap > 0, "the grid and the resamples must be positive")
        _check(bool(self.tasks) and set(self.tasks) <= {"and", "ain"}, "tasks are 'and' and 'ain'")


def _check(ok: bool, message: str) -> None:
    if not ok:
        raise ValueError(message)


def load(kind: type, path: str, section: str | None = None):
    """(settings, SHA-256 of the file).  Unknown keys are an error; missing ones keep their defaults."""
    import yaml

    raw = Path(path).read_bytes()
    data = yaml.safe_load(raw) or {}
    if section is not None:
        data = data.get(section) or {}
    _check(isinstance(data, dict), "a settings file holds a mapping")
    known = {f.name for f in dataclasses.fields(kind)}
    if unknown := sorted(set(data) - known):
        raise ValueError(f"unknown settings: {unknown}")
    values = {k: tuple(v) if isinstance(v, list) else v for k, v in data.items()}
    return kind(**values), hashlib.sha256(raw).hexdigest()


def evaluation_split(test_predictions: str | None, n_test_scores: int) -> str:
    """'test' if predictions or scores of it exist, else 'dev'."""
    return "test" if (test_predictions and Path(test_predictions).exists()) or n_test_scores > 0 else "dev"
