"""Item metadata: name, quantity, unit, value type; kept in the metadata of a column."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession


class ItemsError(Exception):
    """A selector names no item."""

    def __init__(self, wanted: object, known: Iterable[str]) -> None:
        super().__init__(f"no item {wanted!r}; there are: {', '.join(known)}")


class InvalidValueType(Exception):
    """An unknown value type."""


#: Value types by code (fixed values).
VALUE_TYPES = {0: "Instantaneous", 1: "Accumulated", 2: "StepAccumulated", 3: "MeanStepBackward", 4: "MeanStepForward"}

#: Quantities with their codes and the units that are known to fit, the default first (fixed values). More can be
#: added with :func:`register_quantity`.
QUANTITIES: dict[str, tuple[int, tuple[str, ...]]] = {
    "Water_Level": (100000, ("meter", "millimeter", "feet")),
    "Discharge": (100001, ("meter_pow_3_per_sec", "liter_per_sec")),
    "Wind_Velocity": (100002, ("meter_per_sec", "knot", "kilometer_per_hour")),
    "Wind_Direction": (100003, ("degree", "radian")),
    "Rainfall": (100004, ("millimeter", "meter")),
    "Evaporation": (100005, ("millimeter", "meter")),
    "Temperature": (100006, ("degree_Celsius", "degree_Fahrenheit", "degree_Kelvin")),
    "Concentration": (100007, ("mu_g_per_meter_pow_3", "milligram_per_liter")),
    "Density": (100017, ("kilogram_per_meter_pow_3",)),
    "Relative_humidity": (100023, ("percent",)),
    "Salinity": (100024, ("PSU",)),
    "Surface_Elevation": (100078, ("meter", "millimeter", "feet")),
    "Bathymetry": (100079, ("meter", "feet")),
    "Wave_direction": (100095, ("degree", "radian")),
    "Significant_wave_height": (100097, ("meter", "feet")),
    "Latitude_longitude": (100157, ("degree",)),
    "Geographical_coordinate": (100183, ("meter", "degree")),
    "Current_Speed": (100242, ("meter_per_sec", "knot")),
    "Current_Direction": (100243, ("degree", "radian")),
    "u_velocity_component": (100269, ("meter_per_sec", "knot")),
    "v_velocity_component": (100270, ("meter_per_sec", "knot")),
    "Wind_speed": (100274, ("meter_per_sec", "knot", "kilometer_per_hour")),
    "Mean_Wave_Direction": (100407, ("degree", "radian")),
    "Precipitation_Rate": (100431, ("millimeter_per_day", "millimeter_per_hour")),
    "Pressure": (100450, ("hectopascal", "pascal")),
    "Time": (110296, ("second", "hour", "day")),
    "Undefined": (999, ("undefined",)),
}
SHORT_UNITS = {"kilometer": "km", "centimeter": "cm", "millimeter": "mm", "meter": "m", "liter": "l", "kilogram": "kg", "milligram": "mg", "gram": "g", "second": "s", "sec": "s", "hertz": "Hz"}


def register_quantity(name: str, code: int, units: Iterable[str]) -> None:
    QUANTITIES[name] = (code, tuple(units))


def search_quantities(text: str = "") -> list[str]:
    """Quantities whose name contains ``text``, whatever the case."""
    return [q for q in QUANTITIES if text.lower().replace(" ", "_") in q.lower()]


def quantity_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(code, name, unit, i == 0) for name, (code, units) in QUANTITIES.items() for i, unit in enumerate(units)], "code int, quantity string, unit string, is_default boolean")


def short_unit(unit: str) -> str:
    """meter_pow_3_per_sec becomes m^3/s."""
    words, out = unit.split("_"), []
    while words:
        word = words.pop(0)
        if word == "per":
            out.append("/")
        elif word == "pow" and words:
            out.append("^" + words.pop(0))
        else:
            joint = "*" if out and out[-1] != "/" else ""
            out.append(joint + SHORT_UNITS.get(word, word))
    return "".join(out)


def value_type(kind: str | int) -> str:
    if isinstance(kind, str) and kind.lower() in (known := {v.lower(): v for v in VALUE_TYPES.values()}):
        return known[kind.lower()]
    if kind in VALUE_TYPES:
        return VALUE_TYPES[kind]
    raise InvalidValueType(f"{kind!r} is none of {', '.join(VALUE_TYPES.values())}")


@dataclass(frozen=True)
class Item:
    """An item of a frame. The unit has to be one of its quantity's."""

    name: str
    quantity: str = "Undefined"
    unit: str = ""
    value_type: str = field(default="Instantaneous")

    def __post_init__(self) -> None:
        if self.quantity not in QUANTITIES:
            raise ValueError(f"unknown quantity {self.quantity!r}")
        units = QUANTITIES[self.quantity][1]
        if not self.unit:
            object.__setattr__(self, "unit", units[0])
        elif self.unit not in units:
            raise ValueError(f"{self.unit!r} is no unit of {self.quantity}: {', '.join(units)}")
        object.__setattr__(self, "value_type", value_type(self.value_type))

    def renamed(self, name: str) -> Item:
        return replace(self, name=name)

    def metadata(self) -> dict[str, str]:
        return {"quantity": self.quantity, "unit": self.unit, "value_type": self.value_type}

    @property
    def short_unit(self) -> str:
        return short_unit(self.unit)

    @property
    def display_unit(self) -> str:
        return self.unit.replace("_", " ")


def unique_names(names: Iterable[str]) -> list[str]:
    """Repeated names get _2, _3 and so on."""
    seen: dict[str, int] = {}
    out = []
    for name in names:
        seen[name] = seen.get(name, 0) + 1
        out.append(name if seen[name] == 1 else f"{name}_{seen[name]}")
    return out


def safe_name(name: str) -> str:
    """An identifier made of a name."""
    import re

    made = re.sub(r"\W", "_", name)
    return f"_{made}" if made[:1].isdigit() else made
