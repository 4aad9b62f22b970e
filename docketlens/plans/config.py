"""Run parameters, from an INI file or as arguments."""

from __future__ import annotations

from configparser import ConfigParser
from dataclasses import dataclass, fields
from datetime import date


@dataclass(frozen=True)
class Config:
    """Paths and bounds of a run; the bounds are applied, and "today" is one of them."""

    entries: str = ""
    parties: str = ""
    counsels: str = ""
    entities: str = ""
    mentions: str = ""
    out: str = ""
    commission_start: date = date(1700, 1, 1)
    commission_end: date = date(9999, 1, 1)
    dormant_bound: date = date(1995, 1, 1)
    today: date = date(2100, 1, 1)
    least_similarity: int = 93

    @classmethod
    def read(cls, text: str) -> Config:
        """From INI text, whatever its sections are called; unknown keys are errors."""
        parser = ConfigParser()
        parser.read_string(text)
        found = {k: v for section in parser.sections() for k, v in parser[section].items()}
        kinds = {f.name: type(f.default) for f in fields(cls)}
        if unknown := set(found) - set(kinds):
            raise ValueError(f"unknown settings: {sorted(unknown)}")
        return cls(**{k: date.fromisoformat(v) if kinds[k] is date else kinds[k](v) for k, v in found.items()})
