"""Run configuration with validation."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

MODES = ("patient", "document", "document_complete")
SAVED = ("parquet", "csv", "xlsx")
LEVELS = ("none", "document", "cumulative", "final", "doc2patient")


class ConfigError(ValueError):
    """A configuration that can't be run."""


@dataclass(frozen=True)
class AnalysisConfig:
    batch_root: str
    reference_path: str
    output_dir: str
    id_column: str = "patient_id"
    model_mapping: dict[str, str] = field(default_factory=dict)
    runner_metadata: dict[str, dict[str, Any]] = field(default_factory=dict)
    truth_mode: str = "patient"
    validation_level: str = "none"
    bootstrap_iterations: int = 1000
    random_seed: int = 42
    document_flag_columns: dict[str, str] = field(default_factory=dict)
    enable_temperature_analysis: bool = False

    def __post_init__(self) -> None:
        if self.truth_mode not in MODES:
            raise ConfigError(f"truth_mode must be one of {', '.join(MODES)}")
        if self.validation_level not in LEVELS:
            raise ConfigError(f"validation_level must be one of {', '.join(LEVELS)}")
        if self.bootstrap_iterations < 1:
            raise ConfigError("bootstrap_iterations must be positive")

    def variant(self, level: str, mode: str) -> AnalysisConfig:
        from dataclasses import replace

        return replace(self, validation_level=level, truth_mode=mode, output_dir=f"{self.output_dir.rstrip('/')}_{level}_{mode}")


def _document(path: str) -> dict[str, Any]:
    try:
        found = json.loads(Path(path).read_text())
    except (OSError, ValueError) as e:
        raise ConfigError(f"can't read {path}: {e}") from e
    if not isinstance(found, dict):
        raise ConfigError(f"{path} holds no object")
    return found


def load_analysis(path: str) -> AnalysisConfig:
    """Paths are relative to the file."""
    raw = _document(path)
    for key in ("batch_root", "reference_path", "output_dir"):
        if not raw.get(key):
            raise ConfigError(f"missing: {key}")
        if "://" not in raw[key]:
            raw[key] = str((Path(path).parent / raw[key]).resolve())
    if "bootstrap_iterations" in raw and not isinstance(raw["bootstrap_iterations"], int):
        raise ConfigError("bootstrap_iterations must be a whole number")
    unknown = set(raw) - set(AnalysisConfig.__dataclass_fields__)
    if unknown:
        raise ConfigError(f"unknown: {', '.join(sorted(unknown))}")
    return AnalysisConfig(**raw)


@dataclass(frozen=True)
class Runner:
    display_name: str
    url: str
    enabled: bool = True


@dataclass(frozen=True)
class ClientConfig:
    sources: dict[str, dict[str, str]]
    runners: dict[str, Runner]
    prompt_templates: dict[str, str]
    report_sequences: dict[str, list[str]]
    output_dir: str
    batch_size: int = 5
    max_cases: int | None = None
    max_parallel_runners: int = 4
    token_limit: int = 4000
    timeout_seconds: float | None = 300
    max_retries: int = 3
    retry_delay_seconds: float = 0.5
    calls_at_once: int = 8
    calls_per_second: float | None = None
    batches_per_commit: int = 1000
    tokenizer: str | None = None
    band_days: int = 2
    window_days: int | None = None
    save_format: str = "parquet"

    def __post_init__(self) -> None:
        if self.batch_size < 1 or self.token_limit < 1:
            raise ConfigError("batch_size and token_limit must be positive")
        if min(self.max_retries, self.calls_at_once, self.batches_per_commit) < 1 or self.retry_delay_seconds < 0:
            raise ConfigError("max_retries, calls_at_once and batches_per_commit must be positive, retry_delay_seconds not negative")
        if self.save_format not in SAVED:
            raise ConfigError(f"save_format must be one of {', '.join(SAVED)}")
        if self.band_days < 0:
            raise ConfigError("band_days must not be negative")
        if self.calls_per_second is not None and self.calls_per_second <= 0:
            raise ConfigError("calls_per_second must be positive")
        if not 1 <= self.max_parallel_runners <= 4:
            raise ConfigError("max_parallel_runners must be 1 to 4")
        for name in ("primary", "secondary", "context_notes"):
            missing = {"path", "id_column", "date_column", "text_column"} - set(self.sources.get(name, {}))
            if missing:
                raise ConfigError(f"source {name} lacks {', '.join(sorted(missing))}")
        if not any(r.enabled for r in self.runners.values()):
            raise ConfigError("no runner is enabled")
        if not self.prompt_templates or not self.report_sequences:
            raise ConfigError("templates and sequences must not be empty")

    def active(self) -> dict[str, Runner]:
        """Enabled runners, at most ``max_parallel_runners``."""
        return dict([(k, r) for k, r in self.runners.items() if r.enabled][: self.max_parallel_runners])


# Sections and names of a configuration in sections, and what they are called here.
SECTIONS = ("general", "data_sources", "matching", "prompt_templates", "report_sequences")
GENERAL = ("batch_size", "version", "output_dir", "max_parallel_runners")
SOURCES = {"primary_reports": "primary", "secondary_reports": "secondary", "context_notes": "context_notes", "clinic_letters": "context_notes"}
LABELS = {"primary": ("label",), "secondary": ("label",), "context_notes": ("preceding_label", "following_label")}
RENAMED = {"predict_timeout_seconds": "timeout_seconds", "tokenizer_file": "tokenizer"}


def _needs(have: object, wanted: tuple[str, ...], what: str) -> None:
    missing = [k for k in wanted if not isinstance(have, dict) or k not in have]
    if missing:
        raise ConfigError(f"{what} lacks {', '.join(missing)}")


def _local(root: Path, path: str) -> str:
    """Relative to the configuration's folder; addresses of other stores stay."""
    return path if "://" in path else str((root / path).resolve())


def from_sections(raw: dict[str, Any], root: Path) -> ClientConfig:
    """A configuration in sections: paths relative to the file, templates as files of their own, a version as a folder."""
    _needs(raw, SECTIONS, "the configuration")
    general, matching = raw["general"], raw["matching"]
    _needs(general, GENERAL, "general")
    sources = {}
    for name, known in SOURCES.items():
        if name in raw["data_sources"] and known not in sources:
            own = raw["data_sources"][name]
            _needs(own, ("path", "patient_id_column", "date_column", "text_column", *LABELS[known]), name)
            sources[known] = {"path": _local(root, own["path"]), "id_column": own["patient_id_column"], "date_column": own["date_column"], "text_column": own["text_column"], "date_format": own.get("date_format")}
    _needs(sources, tuple(LABELS), "data_sources")
    endpoints = raw.get("runner_endpoints") or {k: {"enabled": True, "display_name": k, "url": u} for k, u in general.get("api_endpoints", {}).items()}
    enabled = {k: r for k, r in endpoints.items() if r.get("enabled", False)}
    if not enabled:
        raise ConfigError("no runner is enabled")
    if len(enabled) > int(general["max_parallel_runners"]):
        raise ConfigError("more runners are enabled than max_parallel_runners")
    for k, r in enabled.items():
        _needs(r, ("display_name", "url"), f"runner {k}")
    templates = {}
    for name, path in raw["prompt_templates"].items():
        try:
            templates[name] = (root / path).read_text(encoding="utf-8")
        except OSError as e:
            raise ConfigError(f"no template {name} at {path}") from e
    plain = {RENAMED.get(k, k): v for k, v in general.items() if RENAMED.get(k, k) in ClientConfig.__dataclass_fields__}
    plain |= {"output_dir": f"{_local(root, general['output_dir'])}/{general['version']}", "save_format": str(general.get("save_format", "xlsx")).lower(), "band_days": int(matching.get("max_days_between_primary_and_secondary", 2))}
    if plain.get("tokenizer"):
        plain["tokenizer"] = _local(root, plain["tokenizer"])
    runners = {k: Runner(r.get("display_name", k), r.get("url", ""), bool(r.get("enabled", False))) for k, r in endpoints.items()}
    return ClientConfig(sources, runners, templates, raw["report_sequences"], **plain)


def load_client(path: str) -> ClientConfig:
    """Either as the fields of :class:`ClientConfig` or in sections; older names of runners and notes are understood."""
    raw = _document(path)
    if "general" in raw:
        return from_sections(raw, Path(path).resolve().parent)
    runners = raw.pop("runners", None) or {k: {"display_name": k, "url": u} for k, u in raw.pop("api_endpoints", {}).items()}
    for k, r in runners.items():
        if not r.get("display_name") or not r.get("url"):
            raise ConfigError(f"runner {k} needs display_name and url")
    sources = raw.get("sources", {})
    if "clinic_letters" in sources:
        sources["context_notes"] = sources.pop("clinic_letters")
    try:
        return ClientConfig(**raw | {"sources": sources, "runners": {k: Runner(r["display_name"], r["url"], r.get("enabled", True)) for k, r in runners.items()}})
    except TypeError as e:
        raise ConfigError(str(e)) from e
