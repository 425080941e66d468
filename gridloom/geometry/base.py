"""Boxes, points and geometries without axes."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass


class OutsideDomainError(ValueError):
    """Points that lie outside a geometry."""

    def __init__(self, x: object, y: object = None, z: object = None, indices: object = None) -> None:
        super().__init__(f"outside the domain: x={x} y={y} z={z}")
        self.x, self.y, self.z, self.indices = x, y, z, indices


@dataclass(frozen=True)
class BoundingBox:
    left: float
    bottom: float
    right: float
    top: float

    def __post_init__(self) -> None:
        if self.left > self.right or self.bottom > self.top:
            raise ValueError(f"the sides of {self} are out of order")

    @classmethod
    def parse(cls, values: BoundingBox | Sequence[float]) -> BoundingBox:
        if isinstance(values, cls):
            return values
        if len(values) != 4:
            raise ValueError("a box has four values: left, bottom, right, top")
        return cls(*map(float, values))

    def overlaps(self, other: BoundingBox) -> bool:
        return self.left <= other.right and other.left <= self.right and self.bottom <= other.top and other.bottom <= self.top


@dataclass(frozen=True)
class Geometry0D:
    """No axes."""

    dims: tuple[str, ...] = ()

    def reduce(self, dims: Sequence[str]) -> Geometry0D:
        return self


@dataclass(frozen=True)
class Undefined:
    """Axes of which nothing but the names is known."""

    dims: tuple[str, ...] = ()

    def reduce(self, dims: Sequence[str]) -> Undefined | Geometry0D:
        left = tuple(d for d in self.dims if d not in dims)
        return Undefined(left) if left else Geometry0D()


@dataclass(frozen=True)
class Point2D:
    x: float
    y: float
    dims: tuple[str, ...] = ()

    @property
    def wkt(self) -> str:
        return f"POINT ({self.x} {self.y})"

    def reduce(self, dims: Sequence[str]) -> Point2D:
        return self


@dataclass(frozen=True)
class Point3D:
    x: float
    y: float
    z: float
    dims: tuple[str, ...] = ()

    @property
    def wkt(self) -> str:
        return f"POINT Z ({self.x} {self.y} {self.z})"

    def reduce(self, dims: Sequence[str]) -> Point3D:
        return self
