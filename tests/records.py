"""Record classes and rows of the query tests: voyages of ships between ports."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime
from fractions import Fraction
from typing import Annotated

from quarry.schema import IdentitySkip, Shape, StorageInfo


@dataclass(frozen=True)
class Ship:
    name: str
    built: int


@dataclass(frozen=True)
class Voyage:
    ship: Ship | None
    ports: list[str]
    days: int
    freight: Fraction
    code: str


@dataclass(frozen=True)
class Inspection:
    voyage: Voyage
    by: str
    passed: bool
    __storage__ = StorageInfo(dedup="by_value")


@dataclass(frozen=True)
class Remark:
    body: str
    answer: str | None = None


@dataclass(frozen=True)
class Hull:
    frame: Annotated[tuple, Shape(2, 4)]
    name: str


@dataclass(frozen=True)
class Crate:
    weight: Fraction
    mark: str


@dataclass(frozen=True)
class Cargo:
    crates: list[Crate]
    bill: str
    sealed: datetime | None = None
    shares: tuple[Fraction, ...] = ()
    flags: list[str] | None = None
    memo: Annotated[str | None, IdentitySkip()] = None


@dataclass(frozen=True)
class Signal:
    text: str
    __storage__ = StorageInfo(dedup="none")


@dataclass(frozen=True)
class Reading:
    """Every kind of scalar, for identities."""

    at: float
    count: int
    ok: bool
    label: str
    raw: bytes
    when: datetime
    series: list[float]
    ship: Ship | None = None
    fleet: list[Ship] | None = None


AURORA, BOREAS, CIRRUS = Ship("Aurora", 1911), Ship("Boreas", 1950), Ship("Cirrus", 1987)
VOYAGES = [
    Voyage(AURORA, ["Oslo", "Kiel", "Riga"], 12, Fraction(5, 3), "V-11"),
    Voyage(AURORA, ["Kiel", "Turku"], 4, Fraction(-1, 2), "V-12"),
    Voyage(BOREAS, ["Riga"], 4, Fraction(0), "V-20"),
    Voyage(BOREAS, ["Oslo", "Riga", "Turku", "Kiel"], 30, Fraction(-7, 4), "V-21"),
    Voyage(None, ["Turku", "Oslo"], 9, Fraction(9, 8), "W-01"),
    Voyage(None, [], 1, Fraction(1, 10), "W-02"),
    Voyage(CIRRUS, ["Riga", "Oslo"], 4, Fraction(2), "W-1%"),
]
CODES = {v.code for v in VOYAGES}
INSPECTIONS = [Inspection(VOYAGES[0], "port", True), Inspection(VOYAGES[0], "crew", False), Inspection(VOYAGES[2], "port", False)]
REMARKS = [Remark(t) for t in ("7% salt", "70 salt", "no_go", "nongo", "salt 7%", "the no_go")]
