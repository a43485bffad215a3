"""Continuation tokens of keyset pages.

A token is base64url text of canonical JSON: format version, direction, a
fingerprint of the search, and the anchor row's typed key values.  A token that
was changed, or that belongs to another search, is refused.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
from dataclasses import dataclass
from datetime import datetime
from typing import Any

VERSION = 1
MOST_CHARACTERS = 16_384


class PageTokenError(ValueError):
    """A continuation token that can't be used with this search."""


@dataclass(frozen=True)
class PageOrder:
    """One sort key of a page: an output name, a direction and where nulls go."""

    field: str
    descending: bool = False
    nulls: str = "last"

    def __post_init__(self) -> None:
        if self.nulls not in ("first", "last"):
            raise ValueError("nulls must be 'first' or 'last'")


def typed(value: Any) -> list:
    """A JSON-able pair of type name and exact value."""
    if value is None:
        return ["null", None]
    if isinstance(value, bool):
        return ["bool", value]
    if isinstance(value, int):
        return ["int", str(value)]
    if isinstance(value, float):
        return ["float", value.hex()]
    if isinstance(value, str):
        return ["str", value]
    if isinstance(value, datetime):
        return ["time", value.isoformat()]
    raise TypeError(f"can't page over values of type {type(value).__name__}")


def untyped(pair: Any) -> Any:
    match pair:
        case ["null", None]:
            return None
        case ["bool", bool(v)] | ["str", str(v)]:
            return v
        case ["int", str(v)]:
            return int(v)
        case ["float", str(v)]:
            return float.fromhex(v)
        case ["time", str(v)]:
            return datetime.fromisoformat(v)
    raise PageTokenError("malformed anchor value")


def fingerprint(*parts: Any) -> str:
    return hashlib.sha256(json.dumps(parts, default=str, sort_keys=True).encode()).hexdigest()


def encode(plan: str, backward: bool, anchor: list[Any]) -> str:
    body = {"v": VERSION, "d": "b" if backward else "f", "p": plan, "a": [typed(v) for v in anchor]}
    text = json.dumps(body, sort_keys=True, separators=(",", ":"))
    return base64.urlsafe_b64encode(text.encode()).decode().rstrip("=")


def decode(token: str, plan: str, n_keys: int) -> tuple[bool, list[Any]]:
    """(backward, anchor) of a token for the search with this fingerprint."""
    if not isinstance(token, str) or len(token) > MOST_CHARACTERS:
        raise PageTokenError("not a continuation token")
    try:
        body = json.loads(base64.b64decode(token + "=" * (-len(token) % 4), altchars=b"-_", validate=True))
    except (ValueError, binascii.Error) as wrong:
        raise PageTokenError("not a continuation token") from wrong
    if not isinstance(body, dict) or set(body) != {"v", "d", "p", "a"} or body["v"] != VERSION:
        raise PageTokenError("unknown token version")
    if body["p"] != plan:
        raise PageTokenError("the token belongs to another search")
    if body["d"] not in ("f", "b") or not isinstance(body["a"], list) or len(body["a"]) != n_keys:
        raise PageTokenError("malformed token")
    return body["d"] == "b", [untyped(v) for v in body["a"]]
