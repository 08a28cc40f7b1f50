"""Run settings: defaults, an INI file, or keyword arguments; never changed once made."""

from __future__ import annotations

import configparser
from dataclasses import dataclass, field, fields, replace


@dataclass(frozen=True)
class Config:
    percents: tuple[float, ...] = (2.5, 5.0, 7.5, 10.0, 12.5, 15.0, 17.5, 20.0)
    num_clusters: int | None = None
    min_cluster_size: int = 0
    key_similarity: float = 0.9
    token_cutoff: float = 0.8
    merge_keys: bool = True
    #: metric -> (goal, weight)
    metrics: dict[str, tuple[str, float]] = field(
        default_factory=lambda: {"mean_duration_std": ("min", 1.0), "min_max_tpc": ("min", 1.0), "wcss": ("min", 1.0), "bcss": ("max", 1.0), "ch_index": ("max", 1.0), "db_index": ("min", 1.0), "silhouette": ("max", 1.0), "words_pairs": ("max", 1.0)}
    )

    def with_weights(self, **weights: float) -> Config:
        return replace(self, metrics={m: (goal, float(weights.get(m, w))) for m, (goal, w) in self.metrics.items()})


def values(text: str) -> list[str]:
    """A comma list, trimmed."""
    return [v.strip() for v in text.split(",") if v.strip()]


def from_ini(text: str, section: str = "run") -> Config:
    p = configparser.ConfigParser()
    p.read_string(text)
    got = dict(p[section]) if p.has_section(section) else {}
    out = {}
    for f in fields(Config):
        if f.name in got:
            raw = got[f.name]
            out[f.name] = tuple(map(float, values(raw))) if f.name == "percents" else raw.lower() in ("1", "true", "yes") if f.name == "merge_keys" else int(raw) if f.name in ("num_clusters", "min_cluster_size") else float(raw)
    weights = {k.removeprefix("weight_"): float(v) for k, v in got.items() if k.startswith("weight_")}
    return Config(**out).with_weights(**weights)
