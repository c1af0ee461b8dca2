"""Order of key values on the driver, as Spark orders them, and the end of a prefix."""

from __future__ import annotations

import math
from datetime import date, datetime
from typing import Any


def order(value: Any) -> tuple:
    """A sort key: NaN is equal to itself and greater than any number; all else by its own order.

    Python orders text by code point, which is the order of UTF-8 bytes that Spark uses.
    """
    if isinstance(value, float) and math.isnan(value):
        return (1, 0)
    if isinstance(value, bytearray):
        value = bytes(value)
    if isinstance(value, datetime):
        return (0, value.replace(tzinfo=None))
    if isinstance(value, date):
        return (0, datetime(value.year, value.month, value.day))
    return (0, value)


def after_prefix(prefix: str) -> str | None:
    """The least text greater than every text that begins with ``prefix``; None if there is none."""
    for i in range(len(prefix) - 1, -1, -1):
        code = ord(prefix[i]) + 1
        if code <= 0x10FFFF:
            return prefix[:i] + chr(0xE000 if 0xD800 <= code <= 0xDFFF else code)
    return None
