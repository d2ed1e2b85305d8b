"""Settings of the three stages and layered configuration."""

from __future__ import annotations

import os
from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field, fields


@dataclass
class AccessStage:
    """Obtaining and chunking documents; knows no research question."""

    output_folder: str = "outputs"
    checkpoint_folder: str = "checkpoints"
    pdf_folder: str = "pdfs"
    min_chunk_words: int = 40
    max_chunk_words: int = 500
    min_chunk_chars: int = 80


@dataclass
class AssessStage:
    """Question-agnostic quality of what was accessed."""

    access: AccessStage = field(default_factory=AccessStage)


@dataclass
class AddressStage:
    """Answering a research question about the corpus."""

    access: AccessStage = field(default_factory=AccessStage)
    n_concern_clusters: int = 75
    n_benefit_clusters: int = 75
    random_seed: int = 42
    tech_col: str = "technology_meta"
    ai_tech_label: str = "AI"
    cross_cutting_threshold: float = 0.5
    soft_membership_threshold: float = 0.3
    validation_sample_n: int = 250


def layered(*layers: Mapping[str, object]) -> dict[str, object]:
    """Settings of all layers, later ones winning; variables in texts are expanded, nested mappings merged."""
    out: dict[str, object] = {}
    for layer in layers:
        for k, v in layer.items():
            if isinstance(v, Mapping):
                have = out.get(k)
                out[k] = layered(have if isinstance(have, Mapping) else {}, v)
            else:
                out[k] = os.path.expandvars(v) if isinstance(v, str) else v
    return out


def load_layers(paths: Iterable[str]) -> dict[str, object]:
    """Layers read from JSON (or YAML where a parser is installed); missing files are skipped."""
    import json

    found = []
    for path in paths:
        if not os.path.exists(path):
            continue
        with open(path, encoding="utf-8") as f:
            text = f.read()
        if path.endswith((".yml", ".yaml")):
            try:
                import yaml
            except ImportError as e:
                raise RuntimeError("YAML settings need a YAML parser") from e
            found.append(yaml.safe_load(text) or {})
        else:
            found.append(json.loads(text or "{}"))
    return layered(*found)


def stage(cls, settings: Mapping[str, object]):
    """A stage from the settings that it knows."""
    names = {f.name for f in fields(cls)}
    return cls(**{k: v for k, v in settings.items() if k in names})
