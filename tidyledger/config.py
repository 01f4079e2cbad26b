"""Limits and run configuration. Every limit is off unless it is asked for; ``published`` has the fixed values."""

from __future__ import annotations

from dataclasses import dataclass, field

CLEANING_VERSION = "1.0"
STANDARDIZATION_VERSION = "1.0"
MATCHING_VERSION = "1.0"
EXPORT_VERSION = "1.0"
EXPORT_FORMAT_VERSION = 1


@dataclass(frozen=True)
class ScanLimits:
    """Input limits; above one a scan is refused. ``None`` is no limit."""

    max_file_size_bytes: int | None = None
    max_rows: int | None = None
    max_columns: int | None = None
    max_cell_length: int | None = None

    @classmethod
    def published(cls) -> ScanLimits:
        return cls(25 * 1024 * 1024, 100_000, 500, 100_000)


@dataclass(frozen=True)
class ProfileLimits:
    max_distinct_values: int = 100
    max_sample_values: int = 10


@dataclass(frozen=True)
class AuditLimits:
    """How many audit rows a run keeps; totals are always taken before the cut. ``None`` keeps all."""

    max_changes: int | None = None
    max_decisions: int | None = None
    max_exclusions: int | None = None

    @classmethod
    def published(cls) -> AuditLimits:
        return cls(10_000, 10_000, 10_000)


@dataclass(frozen=True)
class StandardizeConfig:
    """Context that settles otherwise ambiguous values; unset means such values stay untouched."""

    default_country: str | None = None
    default_currency: str | None = None
    date_output_format: str | None = None
    boolean_output_form: tuple[str, str] | None = None
    numeric_locale: str | None = None


@dataclass(frozen=True)
class LookupTables:
    """Tenant lookups: per field type, and field-independent (``general``). Keys are lower-case."""

    scoped: dict[str, dict[str, str]] = field(default_factory=dict)
    general: dict[str, str] = field(default_factory=dict)


@dataclass(frozen=True)
class MatchField:
    column_name: str
    comparison: str = "normalized_exact"  # or "exact"
    weight: float = 1.0


@dataclass(frozen=True)
class MatchRules:
    duplicate_threshold: float
    review_threshold: float
    fields: tuple[MatchField, ...]


@dataclass(frozen=True)
class MatchLimits:
    """Blocks above the size are left unmatched and listed with a sample. ``None`` matches blocks of any size."""

    max_block_size: int | None = None
    max_skipped_sample: int = 20

    @classmethod
    def published(cls) -> MatchLimits:
        return cls(1_000)
