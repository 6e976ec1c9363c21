"""Text of numbers in reports. Python's formatting rounds exactly as wanted; Java's format_string does not."""

from __future__ import annotations


def trimmed(value: float | None, digits: int = 6, missing: str = "nan") -> str:
    """Fixed digits without trailing zeros; a null is ``missing``."""
    if value is None or value != value:
        return missing
    text = f"{value:.{digits}f}"
    if "." in text:
        text = text.rstrip("0").rstrip(".")
    return "0" if text in ("-0", "") else text


def ratio(value: float | None) -> str:
    """Eight digits, not trimmed; NA for null."""
    return "NA" if value is None else f"{value:.8f}"
