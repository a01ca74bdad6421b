"""Options of a run: a command line over a configuration over defaults."""

from __future__ import annotations

import argparse
from collections.abc import Sequence
from dataclasses import dataclass, fields, replace


def flag(text: str | bool) -> bool:
    """True for "true" in any case, false for anything else."""
    return str(text).lower() == "true"


@dataclass(frozen=True)
class Options:
    chip_size: int = 128
    batch_size: int = 8
    stride: int = 64
    tile_batch: int = 16
    chips_per_epoch: int = 200
    val_chips: int = 40
    epochs: int = 100
    hidden_dim: int = 16
    num_layers: int = 1
    kernel_size: int = 3
    static_channels: int | None = None
    use_location_encoder: bool = True
    ssim_weight: float = 2.0
    laplacian_weight: float = 1.0
    histogram_weight: float = 0.67
    histogram_warmup_epochs: int = 20
    checkpoint: str | None = None
    region: str | None = None
    seed: int = 42

    @staticmethod
    def parsed(arguments: Sequence[str], config: dict | None = None) -> Options:
        """What the command line names, else what ``config`` has (the region under ``inference.region_geojson``), else the
        defaults. A configuration that can't be read counts as none."""
        known = {f.name: f for f in fields(Options)}
        parser = argparse.ArgumentParser(argument_default=argparse.SUPPRESS, allow_abbrev=False)
        for name, f in known.items():
            kind = flag if f.type == "bool" else {"int": int, "float": float}.get(str(f.type).split(" ")[0], str)
            parser.add_argument(f"--{name}", type=kind)
        given = {k: v for k, v in config.items() if k in known} if isinstance(config, dict) else {}
        inference = config.get("inference") if isinstance(config, dict) else None
        if isinstance(inference, dict) and inference.get("region_geojson"):
            given["region"] = inference["region_geojson"]
        return replace(Options(), **given | vars(parser.parse_args(list(arguments))))
