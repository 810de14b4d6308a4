"""Stage and report registries, per-client settings, and hooks for user code."""

from __future__ import annotations

import importlib
import json
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

StageFunction = Callable[..., DataFrame]

# The stages of a document's way, in order; the marked ones cannot be skipped.
STAGES = [
    "splitting", "deduplication", "classification", "extraction", "variant_discovery",
    "signature", "address", "validation", "governance",
    "linking", "matching", "posting", "filing", "notifying",
]
NOT_SKIPPABLE = {"classification", "extraction"}

_stage_functions: dict[str, StageFunction] = {}
_reports: dict[str, StageFunction] = {}


def stage(name: str) -> Callable[[StageFunction], StageFunction]:
    """Decorator: make a DataFrame function the default of a stage."""
    def keep(fn: StageFunction) -> StageFunction:
        _stage_functions[name] = fn
        return fn
    return keep


def report(name: str) -> Callable[[StageFunction], StageFunction]:
    def keep(fn: StageFunction) -> StageFunction:
        _reports[name] = fn
        return fn
    return keep


def stage_function(name: str, override: str | None = None) -> StageFunction:
    """The function of a stage; `override` is the dotted path of another one."""
    if override:
        module, attr = override.rsplit(".", 1)
        return getattr(importlib.import_module(module), attr)
    if name not in _stage_functions:
        raise KeyError(f"no function registered for stage {name!r}; known: {sorted(_stage_functions)}")
    return _stage_functions[name]


def report_function(name: str) -> StageFunction:
    return _reports[name]


def list_reports() -> list[str]:
    return sorted(_reports)


def list_stages() -> list[dict]:
    out = []
    for name in STAGES:
        fn = _stage_functions.get(name)
        out.append({"key": name, "skippable": name not in NOT_SKIPPABLE,
                    "function": f"{fn.__module__}.{fn.__qualname__}" if fn else None})
    return out


@dataclass(frozen=True)
class ClientSettings:
    """Disabled stages, function overrides and parameters of one client."""
    disabled: frozenset[str] = frozenset()
    overrides: dict[str, str] = field(default_factory=dict)
    params: dict[str, dict] = field(default_factory=dict)

    @classmethod
    def from_json(cls, disabled: str | None, overrides: str | None, params: str | None) -> ClientSettings:
        """Broken or missing JSON counts as empty."""
        def read(text, empty):
            try:
                return json.loads(text) if text else empty
            except ValueError:
                return empty
        return cls(frozenset(read(disabled, [])), read(overrides, {}), read(params, {}))

    def run(self, name: str, *frames: DataFrame, **extra) -> DataFrame:
        """Call a stage with this client's function and parameters."""
        fn = stage_function(name, self.overrides.get(name))
        return fn(*frames, **{**self.params.get(name, {}), **extra})


def skipped_stages(skip: Column, match_mode: Column, treatment: Column, disabled: Column | None = None) -> Column:
    """Sorted stages not run for a document.

    Its own list and the client's; MATCHING with match mode SKIP; MATCHING and POSTING for
    treatment STORE; MATCHING whenever LINKING is off.
    """
    none = F.array().cast("array<string>")
    base = F.array_union(F.coalesce(skip, none), F.coalesce(disabled, none) if disabled is not None else none)
    base = F.when(match_mode == "SKIP", F.array_union(base, F.array(F.lit("MATCHING")))).otherwise(base)
    base = F.when(treatment == "STORE", F.array_union(base, F.array(F.lit("MATCHING"), F.lit("POSTING")))).otherwise(base)
    base = F.when(F.array_contains(base, "LINKING"), F.array_union(base, F.array(F.lit("MATCHING")))).otherwise(base)
    return F.array_sort(base)


def apply_scorer(rows: DataFrame, column: str, scorer: Callable, out: str = "score", kind: str = "double") -> DataFrame:
    """A user's vectorised scorer (pandas Series -> Series) over one column, in Arrow batches."""
    return rows.withColumn(out, F.pandas_udf(scorer, kind)(F.col(column)))


def apply_extractor(docs: DataFrame, extractor: Callable, schema: str) -> DataFrame:
    """A user's extractor (iterator of pandas frames -> iterator of pandas frames) over all documents."""
    return docs.mapInPandas(extractor, schema)
