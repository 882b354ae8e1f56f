"""Experiment configuration: defaults, merged with an experiment's own values; unknown keys raise."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from typing import Any

DEFAULTS: dict[str, dict[str, Any]] = {
    "grid": {"kind": "geo", "step": 0.4},
    "obs": {"window_s": 21600, "pad": 0.0, "varmax": 100.0, "subsampling": None, "closed_both": False},
    "obsop": {"k": 4, "reach_km": 150.0},
    "basis": {"longest_km": 4000.0, "shortest_km": 2000.0, "ratio": 2.0, "n_theta": 2, "decay_days": 5.0},
    "model": {"kind": "qg"},
    "inversion": {"sigma_obs": 0.1, "sigma_back": 0.3, "max_iter": 60, "rtol": 1e-4},
    "diag": {"bin": 5.0, "min_obs": 10, "gap_s": 30.0, "npt": 16},
}


class Config(dict):
    """A nested dict whose keys are attributes; a missing key raises."""

    def __getattr__(self, key: str) -> Any:
        try:
            return self[key]
        except KeyError as e:
            raise AttributeError(key) from e


def merge(own: Mapping[str, Mapping[str, Any]], defaults: Mapping[str, Mapping[str, Any]] = DEFAULTS) -> Config:
    """Defaults overlaid with ``own``; a section or key that has no default is an error, not silently dropped."""
    for section, values in own.items():
        if section not in defaults:
            raise KeyError(f"unknown section {section}")
        if unknown := set(values) - set(defaults[section]):
            raise KeyError(f"unknown keys in {section}: {sorted(unknown)}")
    return Config({s: Config({**d, **own.get(s, {})}) for s, d in defaults.items()})


class Factory:
    """Callables by name: models, bases, operators or diagnostics plug in by registering themselves."""

    def __init__(self) -> None:
        self._by_name: dict[str, Callable] = {}

    def register(self, name: str) -> Callable:
        def add(f: Callable) -> Callable:
            if name in self._by_name:
                raise KeyError(f"{name} is registered already")
            self._by_name[name] = f
            return f

        return add

    def __call__(self, name: str) -> Callable:
        if name not in self._by_name:
            raise KeyError(f"no {name}; there are {sorted(self._by_name)}")
        return self._by_name[name]

    def several(self, names: list[str], combine: Callable) -> Callable:
        """One callable that applies each of ``names`` to the same arguments and combines the results."""
        parts = [self(n) for n in names]
        return lambda *args, **kw: combine([p(*args, **kw) for p in parts])
