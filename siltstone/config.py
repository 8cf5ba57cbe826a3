"""Settings of the engine, each with its default."""

from __future__ import annotations

from dataclasses import dataclass, fields
from pathlib import Path


@dataclass(frozen=True)
class Config:
    hll_p: int = 4
    cache_capacity: int = 2
    token_bucket_reset_interval: int = 10
    token_bucket_max_token_num: int = 10
    cms_epsilon: float = 0.1
    cms_delta: float = 0.1
    memtable_threshold: int = 4
    sl_max_level: int = 15
    sl_probability: float = 0.5
    wal_segment: int = 3
    wal_low_mark: int = 2
    false_positive_rate: float = 0.4
    max_levels: int = 5

    @staticmethod
    def load(path: str | Path | None = None) -> Config:
        """From a file of "name: value" lines; names it lacks, and a missing file, leave the defaults. Others are errors."""
        values = {}
        if path is not None and Path(path).exists():
            kinds = {f.name: f.type for f in fields(Config)}
            for line in Path(path).read_text().splitlines():
                line = line.split("#", 1)[0].strip()
                if line:
                    name, _, value = line.partition(":")
                    if name.strip() not in kinds:
                        raise ValueError(f"no such setting: {name.strip()}")
                    values[name.strip()] = (float if kinds[name.strip()] == "float" else int)(value)
        return Config(**values)


DEFAULT = Config()
