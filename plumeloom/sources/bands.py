"""The imaging spectrometer's bands and which of them a gas absorbs in.

Centres and widths are parameters: every scene's file has them (emit.facts() reads them). Where no file
is at hand the nominal instrument stands in, a rule: N_BANDS bands at even steps.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The nominal instrument, in hundredths of a nm: as many of its bands lie in the ranges below as of the
#: real one, whose centres differ from it by some nm and come with its files.
N_BANDS, FIRST, STEP, WIDTH = 285, 38100, 745, 900
#: Fixed values, in nm.
NOT_GAS = {"methane": ((1640.0, 1690.0), (2100.0, 2440.0)), "co2": ((1400.0, 1470.0), (1550.0, 1650.0), (1900.0, 2150.0))}
STRONG = {"methane": (2100.0, 2440.0), "co2": (1930.0, 2130.0)}
#: Enhancement in ppm m up to which a pixel is background.
BACKGROUND = {"methane": 30.0, "co2": 3000.0}


def centres() -> tuple[float, ...]:
    """Of the nominal instrument, in nm."""
    return tuple((FIRST + STEP * k) / 100 for k in range(N_BANDS))


def catalogue(spark: SparkSession, given: Sequence[float] | None = None, widths: Sequence[float] | None = None) -> DataFrame:
    """band, name, centre and width (nm) of the given bands, or of the nominal instrument."""
    given = centres() if given is None else given
    widths = [WIDTH / 100] * len(given) if widths is None else widths
    return spark.createDataFrame([(k, f"radiance_{k}", float(c), float(w)) for k, (c, w) in enumerate(zip(given, widths, strict=True))], "band int, name string, centre double, width double")


def inside(centre: float, ranges: tuple[tuple[float, float], ...]) -> bool:
    return any(low <= centre <= high for low, high in ranges)


def chosen(gas: str, given: Sequence[float] | None = None) -> tuple[list[tuple[int, str, float]], list[int]]:
    """The bands (number, name, centre) in which a gas absorbs strongly, and the numbers of those outside it."""
    known = list(enumerate(centres() if given is None else given))
    strong = [(k, f"radiance_{k}", float(c)) for k, c in known if inside(c, (STRONG[_known(gas)],))]
    return strong, [k for k, c in known if not inside(c, NOT_GAS[gas])]


def _known(gas: str) -> str:
    if gas not in STRONG:
        raise ValueError(f"gas {gas} is not supported")
    return gas


def outside_gas(centre: Column, gas: str) -> Column:
    hit = F.lit(False)
    for low, high in NOT_GAS[_known(gas)]:
        hit = hit | centre.between(low, high)
    return ~hit


def strongly_absorbing(centre: Column, gas: str) -> Column:
    return centre.between(*STRONG[_known(gas)])
