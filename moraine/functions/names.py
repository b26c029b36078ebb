"""File names: MacRoman to Unicode, and the normal forms that archives are listed in."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from moraine.functions.vocab import NORMALIZATIONS, check_choice

#: The upper half of MacRoman, from the codec.
MAC_ROMAN_HIGH = bytes(range(128, 256)).decode("mac_roman")
#: Left whole in decomposed names (fixed value).
_KEPT_COMPOSED = "≠"


def normalize(name: str, form: str = "nfc") -> str:
    check_choice("normalization", form, NORMALIZATIONS)
    if form == "nfc":
        return unicodedata.normalize("NFC", name)
    if form == "nfd":
        return _KEPT_COMPOSED.join(unicodedata.normalize("NFD", part) for part in name.split(_KEPT_COMPOSED))
    return name


def decode_name(raw: bytes, form: str = "nfc") -> str:
    """MacRoman bytes up to the first NUL, normalized."""
    return normalize(raw.split(b"\0", 1)[0].decode("mac_roman"), form)


def mac_roman(raw: Column) -> Column:
    """MacRoman bytes as a string, in native expressions."""
    high = "".join(chr(i) for i in range(128, 256))
    return F.translate(F.decode(raw, "ISO-8859-1"), high, MAC_ROMAN_HIGH)


def decomposed(name: Column) -> Column:
    """Decomposed form of names of MacRoman origin, in native expressions."""
    for char in MAC_ROMAN_HIGH:
        parts = normalize(char, "nfd")
        if parts != char:
            name = F.replace(name, F.lit(char), F.lit(parts))
    return name
