"""Settings: defaults, overridden by a file's values, overridden by arguments."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, fields, replace
from typing import get_type_hints

from strandflow.operators.overlap import check_parameters


@dataclass(frozen=True)
class Settings:
    """Sizes are in bases. None leaves a value to its default rule (half and three quarters of the chunk)."""

    subsequence_length: int = 21384
    overlap_offset: int | None = None
    overlap_core_length: int | None = None
    window_size: int = 100
    edge_threshold: float = 0.1
    peak_threshold: float = 0.8
    min_coding_length: int = 60
    species: str = ""

    def __post_init__(self):
        check_parameters(self.subsequence_length, self.overlap_offset, self.overlap_core_length)


def settings(file: Mapping | None = None, arguments: Mapping | None = None) -> Settings:
    """An error for a name that is no setting, or a value of another type. Arguments that are None are not given."""
    kinds = get_type_hints(Settings)
    given = {k: v for k, v in (arguments or {}).items() if v is not None}
    for source in (file or {}, given):
        unknown = set(source) - {f.name for f in fields(Settings)}
        if unknown:
            raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
        for name, value in source.items():
            if isinstance(value, bool) or not isinstance(value, (kinds[name], int) if kinds[name] is float else kinds[name]):
                raise TypeError(f"{name}: {value!r}")
    return replace(Settings(), **{**(file or {}), **given})
