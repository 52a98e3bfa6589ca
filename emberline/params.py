"""Validated parameters of the engine's operators."""

from __future__ import annotations

from dataclasses import asdict, dataclass

SEC_PER_DAY = 86_400
EARTH_RADIUS_METERS = 6_378_137


def is_whole(x: float) -> bool:
    return x % 1 == 0


def _require(ok: bool, what: str) -> None:
    if not ok:
        raise ValueError(what)


@dataclass(frozen=True)
class PropagationParams:
    """Risk propagation. Times are whole seconds.

    time_buffer: a score still travels over a contact that ended so long before it.
    time_const: days by which an older score loses a factor of e when scores are weighed.
    transmission: factor for each hop. tol: share of the sender's own first message below which
    nothing is sent. max_rounds, max_dur (seconds), early_stop (messages in a row that improve
    nothing, counted by superstep) end the loop before it settles.
    """

    time_buffer: int = 172_800
    time_const: float = 1.0
    transmission: float = 0.8
    tol: float = 0.1
    eps: float = 1e-7
    max_rounds: int | None = None
    max_dur: float | None = None
    early_stop: int | None = None

    def __post_init__(self) -> None:
        _require(is_whole(self.time_buffer) and self.time_buffer > 0, "time_buffer must be a whole number above 0")
        _require(self.time_const > 0, "time_const must be above 0")
        _require(0 < self.transmission <= 1, "transmission must be in (0, 1]")
        _require(self.tol >= 0, "tol must not be negative")
        _require(self.eps > 0, "eps must be above 0")
        _require(self.max_rounds is None or (is_whole(self.max_rounds) and self.max_rounds >= 1), "max_rounds must be a whole number of 1 or more")
        _require(self.max_dur is None or self.max_dur > 0, "max_dur must be above 0")
        _require(self.early_stop is None or (is_whole(self.early_stop) and self.early_stop > 0), "early_stop must be a whole number above 0")

    def as_dict(self) -> dict:
        return asdict(self)


@dataclass(frozen=True)
class SearchParams:
    """Contact search. radius and tol in metres, min_dur and bucket in seconds."""

    min_dur: int = 900
    radius: float = 1e-4
    tol: float = 200.0
    bucket: int = 43_200

    def __post_init__(self) -> None:
        _require(is_whole(self.min_dur) and self.min_dur >= 0, "min_dur must be a whole number of 0 or more")
        _require(self.radius > 0 and self.tol >= 0, "radius must be above 0 and tol not negative")
        _require(is_whole(self.bucket) and self.bucket > 0, "bucket must be a whole number above 0")


def check_precision(precision: int) -> None:
    _require(is_whole(precision) and 0 < precision < 13, "geohash precision must be from 1 to 12")
