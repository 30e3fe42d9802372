"""Coordinate systems as parameters, and their transformations as columns."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from isobar.errors import DefinitionError
from isobar.model import Field

#: Fixed value: radius of the default sphere in metres.
RADIUS = 6370997.0
WRAPPED, UNWRAPPED, UNKNOWN = "wrapped", "unwrapped", "unknown"


@dataclass(frozen=True)
class Crs:
    """kind: spherical, wgs84, cartesian, tripole, rotated_pole, albers, lambert, stereographic, or another name with PROJ-like parameters."""

    kind: str = "spherical"
    params: dict[str, float] = field(default_factory=dict)

    @property
    def geographic(self) -> bool:
        return self.kind in ("spherical", "wgs84")

    def matches(self, other: Crs) -> bool:
        """Equal up to small differences of numbers."""
        return self.kind == other.kind and set(self.params) == set(other.params) and all(math.isclose(v, other.params[k], rel_tol=1e-6, abs_tol=1e-9) for k, v in self.params.items())

    @classmethod
    def from_cf(cls, attrs: dict) -> Crs:
        """From grid_mapping attributes."""
        name = attrs.get("grid_mapping_name", "latitude_longitude")
        if name not in CF:
            raise DefinitionError(f"grid mapping {name}")
        kind, names = CF[name]
        params: dict[str, float] = {}
        for ours, theirs in names.items():
            value = attrs.get(theirs)
            if value is None:
                continue
            for k, x in enumerate(value if isinstance(value, list | tuple) else [value]):
                params[ours + (str(k + 1) if isinstance(value, list | tuple) else "")] = float(x)
        return cls(kind, params)

    def to_cf(self) -> dict:
        for name, (kind, names) in CF.items():
            if kind == self.kind:
                out: dict = {"grid_mapping_name": name}
                for ours, theirs in names.items():
                    several = [self.params[f"{ours}{k}"] for k in (1, 2) if f"{ours}{k}" in self.params]
                    if several or ours in self.params:
                        out[theirs] = several or self.params[ours]
                return out
        raise DefinitionError(f"no grid mapping for {self.kind}")

    def to_proj4(self) -> str:
        name = {"spherical": "longlat", "wgs84": "longlat", "albers": "aea", "lambert": "lcc", "stereographic": "stere", "rotated_pole": "ob_tran", "cartesian": "geocent"}.get(self.kind, self.kind)
        datum = "+datum=WGS84" if self.kind == "wgs84" else f"+R={self.params.get('r', RADIUS):.0f}"
        return " ".join([f"+proj={name}", *(f"+{k}={v:g}" for k, v in sorted(self.params.items()) if k != "r"), datum, "+no_defs"])

    @classmethod
    def from_proj4(cls, text: str) -> Crs:
        pairs = dict(x.lstrip("+").partition("=")[::2] for x in text.split())
        kind = {"longlat": "wgs84" if pairs.get("datum") == "WGS84" else "spherical", "aea": "albers", "lcc": "lambert", "stere": "stereographic", "ob_tran": "rotated_pole", "geocent": "cartesian"}.get(pairs.get("proj", ""), pairs.get("proj", ""))
        params = {("r" if k == "R" else k): float(v) for k, v in pairs.items() if k not in ("proj", "datum", "no_defs", "units") and v}
        return cls(kind, {} if kind in ("spherical", "wgs84") and params == {"r": RADIUS} else {k: v for k, v in params.items() if k != "r" or v != RADIUS})


# CF names of grid mappings and of their parameters.
CF = {
    "latitude_longitude": ("spherical", {}),
    "albers_conical_equal_area": ("albers", {"lat_": "standard_parallel", "lon_0": "longitude_of_central_meridian", "lat_0": "latitude_of_projection_origin", "x_0": "false_easting", "y_0": "false_northing"}),
    "lambert_conformal_conic": ("lambert", {"lat_": "standard_parallel", "lon_0": "longitude_of_central_meridian", "lat_0": "latitude_of_projection_origin", "x_0": "false_easting", "y_0": "false_northing"}),
    "polar_stereographic": ("stereographic", {"lat_ts": "standard_parallel", "lat_0": "latitude_of_projection_origin", "lon_0": "straight_vertical_longitude_from_pole", "x_0": "false_easting", "y_0": "false_northing"}),
    "rotated_latitude_longitude": ("rotated_pole", {"pole_lat": "grid_north_pole_latitude", "pole_lon": "grid_north_pole_longitude"}),
    "oblique_mercator": ("oblique_mercator", {"alpha": "azimuth_of_central_line", "lat_0": "latitude_of_projection_origin", "lonc": "longitude_of_projection_origin", "k": "scale_factor_at_projection_origin", "x_0": "false_easting", "y_0": "false_northing"}),
}


def wrapped_state(f: Field) -> str:
    """unwrapped if any x is over 180, else wrapped if any is below 0, else unknown: one aggregate."""
    x = f.dims.column("x")
    high, low = f.df.agg(F.max(x), F.min(x)).first()
    return UNKNOWN if high is None else UNWRAPPED if high > 180 else WRAPPED if low < 0 else UNKNOWN


def wrap_x(x: Column) -> Column:
    return F.when(x > 180, x - 360).otherwise(x)


def unwrap_x(x: Column) -> Column:
    return F.when(x < 0, x + 360).otherwise(x)


def wrap(f: Field) -> Field:
    """Longitudes to -180..180. Bounds go along with their cell; cells that straddle 180 lie just beyond it."""
    x, pair = f.axis("x"), f.bounds("x")
    shift = F.when(x > 180, 360.0).otherwise(0.0)
    return f.with_df(f.df.withColumns({c: F.col(c) - shift for c in (f.dims.column("x"), *(pair or ()))}))


def unwrap(f: Field) -> Field:
    """Longitudes to 0..360, bounds along with their cell."""
    x, pair = f.axis("x"), f.bounds("x")
    shift = F.when(x < 0, 360.0).otherwise(0.0)
    return f.with_df(f.df.withColumns({c: F.col(c) + shift for c in (f.dims.column("x"), *(pair or ()))}))


def to_cartesian(x: Column, y: Column, z: Column | float = 1.0) -> tuple[Column, Column, Column]:
    lam, phi, r = F.radians(x), F.radians(y), z if isinstance(z, Column) else F.lit(z)
    return r * F.cos(phi) * F.cos(lam), r * F.cos(phi) * F.sin(lam), r * F.sin(phi)


def from_cartesian(x: Column, y: Column, z: Column) -> tuple[Column, Column, Column]:
    r = F.sqrt(x * x + y * y + z * z)
    return F.degrees(F.atan2(y, x)), F.degrees(F.asin(z / r)), r


def rotated_to_geographic(rlon: Column, rlat: Column, pole_lon: float, pole_lat: float) -> tuple[Column, Column]:
    """Longitude and latitude of points on a sphere whose north pole is at the given place."""
    p, lam, phi = math.radians(pole_lat), F.radians(rlon), F.radians(rlat)
    sin_lat = F.cos(phi) * F.cos(lam) * math.cos(p) + F.sin(phi) * math.sin(p)
    east = F.cos(phi) * F.sin(lam)
    lon = F.lit(pole_lon + 180.0) + F.degrees(F.atan2(east, F.cos(phi) * F.cos(lam) * math.sin(p) - F.sin(phi) * math.cos(p)))
    turned = F.pmod(lon + 180.0, F.lit(360.0)) - 180.0
    return turned, F.degrees(F.asin(F.greatest(F.least(sin_lat, F.lit(1.0)), F.lit(-1.0))))


def geographic_to_rotated(lon: Column, lat: Column, pole_lon: float, pole_lat: float) -> tuple[Column, Column]:
    p, lam, phi = math.radians(pole_lat), F.radians(lon - pole_lon), F.radians(lat)
    sin_lat = F.sin(phi) * math.sin(p) + F.cos(phi) * F.cos(lam) * math.cos(p)
    rlon = F.degrees(F.atan2(-F.cos(phi) * F.sin(lam), F.sin(phi) * math.cos(p) - F.cos(phi) * F.cos(lam) * math.sin(p)))
    return rlon, F.degrees(F.asin(F.greatest(F.least(sin_lat, F.lit(1.0)), F.lit(-1.0))))


def cone(crs: Crs) -> tuple[float, ...]:
    rad = lambda k, other: math.radians(crs.params.get(k, other))
    return crs.params.get("r", RADIUS), rad("lat_1", 29.5), rad("lat_2", math.degrees(rad("lat_1", 29.5))), rad("lat_0", 0.0), rad("lon_0", 0.0), crs.params.get("x_0", 0.0), crs.params.get("y_0", 0.0)


def project(crs: Crs, lon: Column, lat: Column) -> tuple[Column, Column]:
    """Plane coordinates of points on the sphere."""
    r, a, b, lat0, lon0, x0, y0 = cone(crs)
    lam, phi = F.radians(lon) - lon0, F.radians(lat)
    if crs.kind == "albers":
        n = (math.sin(a) + math.sin(b)) / 2
        c = math.cos(a) ** 2 + 2 * n * math.sin(a)
        rho, rho0 = r * F.sqrt(c - 2 * n * F.sin(phi)) / n, r * math.sqrt(c - 2 * n * math.sin(lat0)) / n
    elif crs.kind == "lambert":
        n = math.sin(a) if math.isclose(a, b) else math.log(math.cos(a) / math.cos(b)) / math.log(math.tan(math.pi / 4 + b / 2) / math.tan(math.pi / 4 + a / 2))
        k = math.cos(a) * math.tan(math.pi / 4 + a / 2) ** n / n
        rho, rho0 = r * k / F.pow(F.tan(math.pi / 4 + phi / 2), F.lit(n)), r * k / math.tan(math.pi / 4 + lat0 / 2) ** n
    elif crs.kind == "stereographic":
        sign = -1.0 if lat0 < 0 else 1.0
        ts = math.radians(crs.params.get("lat_ts", 90.0 * sign))
        rho = r * (1 + math.sin(abs(ts))) * F.tan(math.pi / 4 - sign * phi / 2)
        return rho * F.sin(lam) + x0, -sign * rho * F.cos(lam) + y0
    else:
        raise DefinitionError(f"no projection {crs.kind}")
    return rho * F.sin(n * lam) + x0, F.lit(rho0) - rho * F.cos(n * lam) + y0


def unproject(crs: Crs, x: Column, y: Column) -> tuple[Column, Column]:
    """Longitude and latitude of plane coordinates."""
    r, a, b, lat0, lon0, x0, y0 = cone(crs)
    x, y = x - x0, y - y0
    if crs.kind == "stereographic":
        sign = -1.0 if lat0 < 0 else 1.0
        ts = math.radians(crs.params.get("lat_ts", 90.0 * sign))
        rho = F.sqrt(x * x + y * y)
        lat = sign * (math.pi / 2 - 2 * F.atan(rho / (r * (1 + math.sin(abs(ts))))))
        return F.degrees(F.atan2(x, -sign * y) + lon0), F.degrees(lat)
    if crs.kind == "albers":
        n = (math.sin(a) + math.sin(b)) / 2
        c = math.cos(a) ** 2 + 2 * n * math.sin(a)
        rho0 = r * math.sqrt(c - 2 * n * math.sin(lat0)) / n
        rho = F.sqrt(x * x + (rho0 - y) * (rho0 - y))
        lat = F.asin((c - (rho * n / r) * (rho * n / r)) / (2 * n))
    elif crs.kind == "lambert":
        n = math.sin(a) if math.isclose(a, b) else math.log(math.cos(a) / math.cos(b)) / math.log(math.tan(math.pi / 4 + b / 2) / math.tan(math.pi / 4 + a / 2))
        k = math.cos(a) * math.tan(math.pi / 4 + a / 2) ** n / n
        rho0 = r * k / math.tan(math.pi / 4 + lat0 / 2) ** n
        rho = F.sqrt(x * x + (rho0 - y) * (rho0 - y))
        lat = 2 * F.atan(F.pow(r * k / rho, F.lit(1 / n))) - math.pi / 2
    else:
        raise DefinitionError(f"no projection {crs.kind}")
    return F.degrees(F.atan2(x, rho0 - y) / n + lon0), F.degrees(lat)


def point(source: Crs, target: Crs, x: Column, y: Column) -> tuple[Column, Column]:
    """A point's coordinates in another system."""
    p, q = source.params, target.params
    if source.kind == "rotated_pole":
        x, y = rotated_to_geographic(x, y, p["pole_lon"], p["pole_lat"])
    elif not source.geographic:
        x, y = unproject(source, x, y)
    if target.kind == "rotated_pole":
        x, y = geographic_to_rotated(x, y, q["pole_lon"], q["pole_lat"])
    elif not target.geographic:
        x, y = project(target, x, y)
    return x, y


def transform(f: Field, source: Crs, target: Crs) -> Field:
    """A field's x and y in another system. Bounds are no boxes there, and go."""
    if source.matches(target) or (source.geographic and target.geographic):
        return f
    x, y = point(source, target, f.axis("x"), f.axis("y"))
    f = f.with_df(f.df.withColumns({"__x": x, "__y": y}).withColumns({f.dims.column("x"): F.col("__x"), f.dims.column("y"): F.col("__y")}).drop("__x", "__y"))
    return f.drop_bounds("x", "y")
