"""Geometries: small descriptions that live on the driver and become dimension tables when a plan needs them."""

from gridloom.geometry.base import BoundingBox, Geometry0D, OutsideDomainError, Point2D, Point3D, Undefined
from gridloom.geometry.grid import Grid1D, Grid2D, Grid3D
from gridloom.geometry.mesh import Mesh, TableMesh
from gridloom.geometry.spectrum import AreaSpectrum, LineSpectrum, PointSpectrum

__all__ = ["AreaSpectrum", "BoundingBox", "Geometry0D", "Grid1D", "Grid2D", "Grid3D", "LineSpectrum", "Mesh", "OutsideDomainError", "Point2D", "Point3D", "PointSpectrum", "TableMesh", "Undefined"]
