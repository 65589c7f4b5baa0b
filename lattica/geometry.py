"""Grid, resolution and cropping box of a volume."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Geometry:
    nz: int
    ny: int
    nx: int
    resolution: tuple[int, int, int] = (30, 15, 15)
    crop: tuple[tuple[int, int], tuple[int, int], tuple[int, int]] | None = None

    @property
    def box(self):
        """Half-open cropping box; the whole grid by default."""
        return self.crop or ((0, self.nz), (0, self.ny), (0, self.nx))

    @property
    def is_isotropic(self) -> bool:
        return len(set(self.resolution)) == 1

    def voxels_in(self, cubic_nm: int) -> int:
        rz, ry, rx = self.resolution
        return int(cubic_nm / (rz * ry * rx))

    def radius(self, nm: int) -> tuple[int, int, int]:
        return tuple(int(nm / r) for r in self.resolution)
