"""Map projections and grids, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: WGS 84 and the UTM scale.
RADIUS, FLATTENING, SCALE, EASTING, SOUTH = 6378137.0, 1 / 298.257223563, 0.9996, 500000.0, 10000000.0
_N = FLATTENING / (2 - FLATTENING)
_A = RADIUS / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
_ALPHA = (_N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16, 13 * _N**2 / 48 - 3 * _N**3 / 5, 61 * _N**3 / 240)
_BETA = (_N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96, _N**2 / 48 + _N**3 / 15, 17 * _N**3 / 480)
_DELTA = (2 * _N - 2 * _N**2 / 3 - 2 * _N**3, 7 * _N**2 / 3 - 8 * _N**3 / 5, 56 * _N**3 / 15)
_ECC = (FLATTENING * (2 - FLATTENING)) ** 0.5


def epsg_of(spatial_ref: Column, lon: Column, lat: Column) -> Column:
    """The named system if it is a UTM one, else that of the place."""
    code = F.when(lat >= 0, 32600).otherwise(32700) + F.floor((lon + 180) / 6) + 1
    return F.when(F.startswith(spatial_ref, F.lit("EPSG:32")), spatial_ref).otherwise(F.concat(F.lit("EPSG:"), code.cast("string")))


def zone_of(epsg: Column) -> Column:
    """32631 -> 31N, 32760 -> 60S; other systems raise an error."""
    code = F.element_at(F.split(epsg, ":"), -1).cast("int")
    north = F.concat((code - 32600).cast("string"), F.lit("N"))
    south = F.concat((code - 32700).cast("string"), F.lit("S"))
    return F.when(code.between(32601, 32660), north).when(code.between(32701, 32760), south).otherwise(F.raise_error(F.concat(F.lit("not a UTM system: "), epsg)))


#: Latitude bands of 8 degrees from 80 south.
BANDS = "CDEFGHJKLMNPQRSTUVWXX"


def zone_at(lat: Column, lon: Column) -> Column:
    """The UTM zone's number, with the wider zones about Norway and Svalbard."""
    plain = F.pmod(F.floor((lon + 180) / 6), F.lit(60)).cast("int") + 1
    north = (lat >= 72) & (lat < 84) & (lon >= 0) & (lon < 42)
    svalbard = F.when(lon < 9, 31).when(lon < 21, 33).when(lon < 33, 35).otherwise(37)
    return F.when((lat >= 56) & (lat < 64) & (lon >= 3) & (lon < 12), 32).when(north, svalbard).otherwise(plain)


def grid_about(lat: Column, lon: Column, cell: float, width: int, height: int | None = None, down: bool = False) -> dict[str, Column]:
    """A grid of cells about a place: zone (number and latitude band), x0 and y0 (its lower left corner,
    snapped to cells), epsg, and its middle as x_mid and y_mid, in metres."""
    height = width if height is None else height
    number = zone_at(lat, lon)
    x, y = to_utm(lat, lon, number)
    letter = F.substr(F.lit(BANDS), F.least(F.lit(20), F.floor((lat + 80) / 8)).cast("int") + 1, F.lit(1))
    x0, y0 = snapped(x - cell * width / 2, cell, down), snapped(y - cell * height / 2, cell, down)
    epsg = F.concat(F.lit("EPSG:32"), F.when(lat >= 0, "6").otherwise("7"), F.lpad(number.cast("string"), 2, "0"))
    return {"zone": F.concat(number.cast("string"), letter), "x0": x0, "y0": y0, "epsg": epsg, "x_mid": x0 + cell * width / 2, "y_mid": y0 + cell * height / 2}


def grid_transform(x0: Column, y0: Column, height: Column, cell: float) -> Column:
    """(cell, 0, left, 0, -cell, top): the affine map from a grid's columns and rows to metres."""
    zero = F.lit(0.0)
    return F.array(F.lit(cell), zero, x0.cast("double"), zero, F.lit(-cell), (y0 + height * cell).cast("double"))


def is_north(zone: Column, strict: bool = False) -> Column:
    """strict: compare the letter with N as if it were a latitude band, so that S is north."""
    letter = F.right(zone, F.lit(1))
    return letter >= "N" if strict else letter == "N"


def snapped(value: Column, cell: float, down: bool = False) -> Column:
    return (F.floor(value / cell) if down else F.rint(value / cell)) * cell


def axis(origin: Column, step: Column, k: Column) -> Column:
    """Coordinate of the middle of pixel k."""
    return origin + (k + 0.5) * step


def to_latlon(x: Column, y: Column, zone: Column, north: Column) -> tuple[Column, Column]:
    """Latitude and longitude in degrees, by the Krueger series to the third order."""
    xi, eta = F.when(north, y).otherwise(y - SOUTH) / (SCALE * _A), (x - EASTING) / (SCALE * _A)
    xi1, eta1 = xi, eta
    for k, b in enumerate(_BETA, 1):
        xi1 = xi1 - b * F.sin(2 * k * xi) * F.cosh(2 * k * eta)
        eta1 = eta1 - b * F.cos(2 * k * xi) * F.sinh(2 * k * eta)
    chi = F.asin(F.sin(xi1) / F.cosh(eta1))
    lat = chi
    for k, d in enumerate(_DELTA, 1):
        lat = lat + d * F.sin(2 * k * chi)
    lon = zone * 6 - 183 + F.degrees(F.atan2(F.sinh(eta1), F.cos(xi1)))
    return F.degrees(lat), lon


def to_utm(lat: Column, lon: Column, zone: Column) -> tuple[Column, Column]:
    """Easting and northing in metres; the inverse of to_latlon()."""
    phi, lam = F.radians(lat), F.radians(lon - (zone * 6 - 183))
    t = F.sinh(F.atanh(F.sin(phi)) - _ECC * F.atanh(_ECC * F.sin(phi)))
    xi, eta = F.atan2(t, F.cos(lam)), F.atanh(F.sin(lam) / F.sqrt(1 + t * t))
    x, y = eta, xi
    for k, a in enumerate(_ALPHA, 1):
        y = y + a * F.sin(2 * k * xi) * F.cosh(2 * k * eta)
        x = x + a * F.cos(2 * k * xi) * F.sinh(2 * k * eta)
    return EASTING + SCALE * _A * x, F.when(lat < 0, SOUTH).otherwise(0.0) + SCALE * _A * y


def box_corners(x_min: Column, y_min: Column, width: Column, height: Column, cell: float) -> list[tuple[Column, Column]]:
    """Bottom left, bottom right, top right and top left of a grid, in metres."""
    right, top = x_min + width * cell, y_min + height * cell
    return [(x_min, y_min), (right, y_min), (right, top), (x_min, top)]


def corner_affine(corners: list[tuple[Column, Column]], col: Column, row: Column, width: Column, height: Column) -> tuple[Column, Column]:
    """Longitude and latitude of a pixel position by the affine map that fits the four corners
    (latitude, longitude) best; for a rectangle the least squares have this closed form."""
    out = []
    for part in (1, 0):
        bl, br, tr, tl = (c[part] for c in corners)
        middle = (bl + br + tr + tl) / 4
        out.append(middle + ((br + tr) - (bl + tl)) / 2 * (col / width - 0.5) + ((bl + br) - (tl + tr)) / 2 * (row / height - 0.5))
    return out[0], out[1]
