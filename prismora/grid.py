"""The wavelength grid, its two segments and the overlap where they are blended."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

SEGMENTS = ("vnir", "swir")


@dataclass(frozen=True)
class Grid:
    """Whole nanometres start..end; a segment and the blended overlap are ranges of them, ends included."""

    start: int = 400
    end: int = 2500
    vnir: tuple[int, int] = (400, 1000)
    swir: tuple[int, int] = (800, 2500)
    blend: tuple[int, int] = (800, 1000)

    @property
    def wavelengths(self) -> np.ndarray:
        return np.arange(self.start, self.end + 1)

    @property
    def width(self) -> int:
        return self.end - self.start + 1

    def range_of(self, segment: str) -> tuple[int, int]:
        return self.vnir if segment == "vnir" else self.swir

    def part(self, segment: str) -> slice:
        """Places of the segment on the grid."""
        lo, hi = self.range_of(segment)
        return slice(lo - self.start, hi - self.start + 1)

    def width_of(self, segment: str) -> int:
        part = self.part(segment)
        return part.stop - part.start

    def as_dict(self) -> dict[str, object]:
        return {"start": self.start, "end": self.end, "vnir": list(self.vnir), "swir": list(self.swir), "blend": list(self.blend)}

    @staticmethod
    def from_dict(d: dict) -> Grid:
        return Grid(d["start"], d["end"], tuple(d["vnir"]), tuple(d["swir"]), tuple(d["blend"]))


CANONICAL = Grid()
