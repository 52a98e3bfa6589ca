"""Scalar functions as Column expressions, so that they stay inside generated code."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from emberline.params import EARTH_RADIUS_METERS, SEC_PER_DAY, check_precision

#: The geohash alphabet.
ALPHABET = "0123456789bcdefghjkmnpqrstuvwxyz"


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def pair_key(a: Column | str, b: Column | str) -> tuple[Column, Column]:
    """The ends of an undirected pair, smaller first."""
    return F.least(col(a), col(b)), F.greatest(col(a), col(b))


def score_weight(val: Column | str, time: Column | str, ctime: Column | str, time_const: float = 1.0, eps: float = 1e-7) -> Column:
    """Log of the value, less the days that the score is older than the contact over time_const."""
    age = F.least((col(time) - col(ctime)) / F.lit(float(SEC_PER_DAY)), F.lit(0.0))
    return F.log(F.greatest(col(val), F.lit(eps))) + age / F.lit(float(time_const))


def haversine(lat1: Column | str, lon1: Column | str, lat2: Column | str, lon2: Column | str) -> Column:
    """Great-circle distance in metres of points in degrees."""
    a, b = F.radians(col(lat1)), F.radians(col(lat2))
    x = F.pow(F.sin((b - a) / 2), F.lit(2.0)) + F.cos(a) * F.cos(b) * F.pow(F.sin((F.radians(col(lon2)) - F.radians(col(lon1))) / 2), F.lit(2.0))
    return F.lit(2.0 * EARTH_RADIUS_METERS) * F.asin(F.least(F.sqrt(x), F.lit(1.0)))


def planar(x1: Column | str, y1: Column | str, x2: Column | str, y2: Column | str) -> Column:
    """Euclidean distance of angles in radians, in metres at the equator."""
    dx, dy = col(x1) - col(x2), col(y1) - col(y2)
    return F.lit(float(EARTH_RADIUS_METERS)) * F.sqrt(dx * dx + dy * dy)


def sdiv(a: Column | str, b: Column | str) -> Column:
    """a / b, 0 where b is 0."""
    return F.when(col(b) == 0, F.lit(0.0)).otherwise(F.try_divide(col(a).cast("double"), col(b).cast("double")))


def approx(x: Column | str, digits: int = 4) -> Column:
    """Rounded half to even; null stays null."""
    return F.bround(col(x), digits)


def whole(x: Column | str) -> Column:
    return (col(x) % 1) == 0


def expected_reach(init: Column | str, first: Column | str, tol: Column | str, transmission: Column | str, eps: float = 1e-7) -> Column:
    """Hops that a message of value init can go until it falls below tol * transmission of the value first; without decay
    it never does, so it goes on without end or not at all."""
    top, value = F.greatest(F.lit(eps), col(tol) * col(transmission) * col(first)), F.greatest(F.lit(eps), col(init))
    endless = F.when(value >= top, F.lit(float("inf"))).otherwise(F.lit(1.0))
    return F.when(col(transmission) >= 1, endless).otherwise(F.greatest(F.lit(1.0), 1 + F.try_divide(F.log(top / value), F.log(col(transmission)))))


def geometric_radius(n: Column | str) -> Column:
    return F.least(F.lit(1.0), F.pow(F.lit(0.25), F.log10(col(n).cast("double")) - 1))


def clip(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def epoch_seconds(ts: Column | str) -> Column:
    """Whole seconds of a timestamp without time zone, whatever the session's zone is."""
    t = col(ts).cast("timestamp_ntz")
    return F.datediff(t.cast("date"), F.lit("1970-01-01").cast("date")).cast("long") * SEC_PER_DAY + F.hour(t) * 3600 + F.minute(t) * 60 + F.second(t)


def uniform(seed: int, stream: str, *keys: Column | str) -> Column:
    """A number in [0, 1) that depends on the seed, the stream's name and the keys alone."""
    text = F.concat_ws(":", F.lit(f"{seed}:{stream}"), *[col(k).cast("string") for k in keys])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def normal(seed: int, stream: str, *keys: Column | str) -> Column:
    """A standard normal number by Box and Muller."""
    u, v = uniform(seed, f"{stream}.u", *keys), uniform(seed, f"{stream}.v", *keys)
    return F.sqrt(-2 * F.log(1 - u)) * F.cos(F.lit(2 * 3.141592653589793) * v)


def _bits(precision: int) -> tuple[int, int]:
    return (5 * precision + 1) // 2, 5 * precision // 2


def geohash_encode(lat: Column | str, lon: Column | str, precision: int = 12) -> Column:
    """Geohash of a point in degrees: both coordinates are quantised, and their bits interleaved."""
    check_precision(precision)
    n_lon, n_lat = _bits(precision)

    def cell(x: Column, span: float, bits: int) -> Column:
        q = F.floor((x + span / 2) / span * float(1 << bits)).cast("long")
        return F.least(F.greatest(q, F.lit(0).cast("long")), F.lit((1 << bits) - 1).cast("long"))

    x, y = cell(col(lon), 360.0, n_lon), cell(col(lat), 180.0, n_lat)
    chars = []
    for k in range(precision):
        value = None
        for j in range(5):
            bit = 5 * k + j
            q, at = (x, n_lon - 1 - bit // 2) if bit % 2 == 0 else (y, n_lat - 1 - bit // 2)
            term = F.shiftleft(F.shiftright(q, at).bitwiseAND(F.lit(1).cast("long")), 4 - j)
            value = term if value is None else value + term
        chars.append(F.substring(F.lit(ALPHABET), (value + 1).cast("int"), F.lit(1)))
    return F.concat(*chars)


def geohash_decode(code: Column | str, precision: int) -> tuple[Column, Column]:
    """(lat, lon) of the centre of a geohash of the given length, in degrees."""
    check_precision(precision)
    n_lon, n_lat = _bits(precision)
    x = y = F.lit(0).cast("long")
    for k in range(precision):
        value = (F.instr(F.lit(ALPHABET), F.substring(col(code), k + 1, 1)) - 1).cast("long")
        for j in range(5):
            bit = 5 * k + j
            one = F.shiftright(value, 4 - j).bitwiseAND(F.lit(1).cast("long"))
            if bit % 2 == 0:
                x = x + F.shiftleft(one, n_lon - 1 - bit // 2)
            else:
                y = y + F.shiftleft(one, n_lat - 1 - bit // 2)
    lat = (y.cast("double") + 0.5) * (180.0 / (1 << n_lat)) - 90.0
    lon = (x.cast("double") + 0.5) * (360.0 / (1 << n_lon)) - 180.0
    return lat, lon


def register(spark: SparkSession) -> None:
    """The scalar functions as temporary SQL functions."""
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION score_weight(val DOUBLE, time BIGINT, ctime BIGINT, time_const DOUBLE, eps DOUBLE) RETURNS DOUBLE RETURN ln(greatest(val, eps)) + least((time - ctime) / {SEC_PER_DAY}.0D, 0.0D) / time_const")
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION haversine(lat1 DOUBLE, lon1 DOUBLE, lat2 DOUBLE, lon2 DOUBLE) RETURNS DOUBLE RETURN 2.0D * {EARTH_RADIUS_METERS} * asin(least(1.0D, sqrt(pow(sin((radians(lat2) - radians(lat1)) / 2), 2) + cos(radians(lat1)) * cos(radians(lat2)) * pow(sin((radians(lon2) - radians(lon1)) / 2), 2))))")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION sdiv(a DOUBLE, b DOUBLE) RETURNS DOUBLE RETURN CASE WHEN b = 0 THEN 0.0D ELSE a / b END")
