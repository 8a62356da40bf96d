"""Typed settings: argument over environment over default; a blank variable counts as unset."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields, replace


@dataclass(frozen=True)
class Settings:
    embed_model: str = "hash"
    embed_dim: int = 64
    embed_provider: str = "local"
    llm_provider: str = "none"
    llm_model: str = "none"
    vision_model: str = "none"
    prediction_error_threshold: float = 0.025
    auto_relate_propose_threshold: float = 0.82
    chunk_strategy: str = "mechanical"

    def __post_init__(self) -> None:
        if self.chunk_strategy not in ("mechanical", "semantic"):
            raise ValueError("chunk_strategy is mechanical or semantic")
        if self.embed_dim < 1 or not 0 <= self.auto_relate_propose_threshold <= 1:
            raise ValueError("dimensions are positive, thresholds lie between 0 and 1")

    def changed(self, **values) -> Settings:
        """Settings with other values; names and types are checked."""
        types = {f.name: type(f.default) for f in fields(Settings)}
        if unknown := values.keys() - types.keys():
            raise ValueError(f"no setting {sorted(unknown)}")
        return replace(self, **{k: types[k](v) for k, v in values.items()})


def resolved(prefix: str = "DOCLOOM_", **given) -> Settings:
    """Settings from arguments, then variables such as DOCLOOM_EMBED_DIM, then defaults."""
    values = {}
    for f in fields(Settings):
        if given.get(f.name) is not None:
            values[f.name] = given[f.name]
        elif (text := os.environ.get(prefix + f.name.upper(), "").strip()) != "":
            values[f.name] = type(f.default)(text)
    return Settings(**values)


def store_folder(given: str | None = None, default: str = "~/.docloom") -> str:
    """Folder of the tables: argument, then DOCLOOM_STORE, then the default."""
    return given or os.environ.get("DOCLOOM_STORE", "").strip() or os.path.expanduser(default)
