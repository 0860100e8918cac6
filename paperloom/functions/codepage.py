"""Code page 437 and symbol characters as translation strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unicode text of bytes 128-255 in code page 437
CP437_HIGH = bytes(range(128, 256)).decode("cp437")
_LATIN = "".join(map(chr, range(128, 256)))
#: Letters of the symbol face, in the order of A-Z and a-z.
SYMBOL_UPPER = "ΑΒΧΔΕΦΓΗΙϑΚΛΜΝΟΠΘΡΣΤΥςΩΞΨΖ"
SYMBOL_LOWER = "αβχδεφγηιϕκλμνοπθρστυϖωξψζ"
#: Signs of the symbol face, and the codes they stand at, in the order of the codes.
SYMBOL_SIGNS = "∀∃∋∗−≅∼≤∞↔←↑→↓°±≥×∂·÷≠∈∉∇∏√⋅∑∫"
_SIGN_CODES = "\"$'*-@~\xa3\xa5\xab\xac\xad\xae\xaf\xb0\xb1\xb3\xb4\xb6\xb7\xb8\xb9\xce\xcf\xd1\xd5\xd6\xd7\xe5\xf2"
_ASCII = "".join(map(chr, range(0x20, 0x7F)))
_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
SYMBOL_CODES, SYMBOL_TEXT = _LETTERS + _SIGN_CODES, SYMBOL_UPPER + SYMBOL_LOWER + SYMBOL_SIGNS
#: the dingbats face: codes 21-7E in the order of Unicode's block; fixed values: the card suits A8-AB
DINGBAT_CODES = "".join(map(chr, (*range(0x21, 0x7F), *range(0xA8, 0xAC))))
DINGBAT_TEXT = "".join(map(chr, range(0x2701, 0x275F))) + "♣♦♥♠"


def bytes_as_chars(content: Column) -> Column:
    """One character for every byte."""
    return F.decode(content, "ISO-8859-1")


def decode_cp437(chars: Column) -> Column:
    return F.translate(chars, _LATIN, CP437_HIGH)


def _codes_again(text: Column, known: str, codes: str, same: str) -> Column:
    """Codes (bytes) for characters; those of ``same`` stay, all others become ``?``.

    The table has every byte that changes, so what is left beyond the bytes is not known: one range, where
    a class of all that is known would be tried sign by sign at every character."""
    others = "".join(c for c in map(chr, range(256)) if c not in known + same)
    return F.regexp_replace(F.translate(text, known + others, codes + "?" * len(others)), r"[^\x00-\xFF]", "?")


def encode_cp437(text: Column) -> Column:
    """Characters for bytes again; what the page lacks becomes ``?``."""
    return _codes_again(text, CP437_HIGH, _LATIN, "".join(map(chr, range(128))))


def decode_symbol(chars: Column) -> Column:
    """Greek letters and mathematical signs for the codes of the symbol face; other codes stay."""
    return F.translate(chars, SYMBOL_CODES, SYMBOL_TEXT)


def decode_dingbats(chars: Column) -> Column:
    return F.translate(chars, DINGBAT_CODES, DINGBAT_TEXT)


def encode_symbol(text: Column) -> Column:
    """Codes of the face for its signs; ASCII rides through, what the face lacks becomes ``?``."""
    return _codes_again(text, SYMBOL_TEXT, SYMBOL_CODES, _ASCII)


def encode_dingbats(text: Column) -> Column:
    return _codes_again(text, DINGBAT_TEXT, DINGBAT_CODES, _ASCII)
