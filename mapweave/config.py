"""Settings of a tile server or a catalogue run."""

from __future__ import annotations

import os
from dataclasses import dataclass


@dataclass(frozen=True)
class Config:
    """data_folder, a path or URI, has one folder for each style.

    default_style is the style of files in no named folder, band the one that is
    drawn, from 1. Tiles are square.
    """

    data_folder: str | None = "data"
    default_style: str = "default"
    tile_size_x: int = 256
    tile_size_y: int = 256
    band: int = 1
    port: int = 8000

    def __post_init__(self) -> None:
        if self.tile_size_x != self.tile_size_y or self.tile_size_x < 1:
            raise ValueError("tiles are square")
        if self.band < 1:
            raise ValueError("bands are counted from 1")

    def root(self) -> str:
        """The absolute data folder; ValueError without one."""
        if not self.data_folder:
            raise ValueError("No source provided in the configuration")
        return self.data_folder if "://" in self.data_folder else os.path.join(os.getcwd(), self.data_folder)
