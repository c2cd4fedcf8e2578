"""Encoded texts within a text, and their decoding."""

from __future__ import annotations

import base64
import binascii
import re
import string
import unicodedata
import urllib.parse
from collections.abc import Iterator

from ravelin.functions.anchors import Runs

MIN_LENGTH, MAX_DECODED, MAX_DEPTH, MAX_PAYLOADS = 20, 100_000, 2, 100

BASE64 = r"""["']([0-9A-Za-z+/]{17,}={0,3})["']|(?<![0-9A-Za-z+/])([0-9A-Za-z+/]{17,}={0,3})(?![0-9A-Za-z+/])"""
FROM_HEX = r"""bytes\.fromhex\(\s*["']([0-9A-Fa-f]{2}(?:\s?[0-9A-Fa-f]{2}){9,})["']\s*\)"""
HEX_ESCAPES = r"((?:\\x[0-9A-Fa-f]{2}){10,})"
HEX_BLOCK = r"(?<![0-9A-Za-z])0x([0-9A-Fa-f]{20,})(?![0-9A-Za-z])"
PERCENT = r"((?:%[0-9A-Fa-f]{2}){3,})"
ESCAPES = r"((?:\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8}){3,})"

_KINDS = tuple((kind, re.compile(p)) for kind, p in (("base64", BASE64), ("hex", FROM_HEX), ("hex", HEX_ESCAPES), ("hex", HEX_BLOCK), ("url", PERCENT), ("unicode_escape", ESCAPES)))
#: What each kind can't be without: a text of which it holds one, or for base64 a run.
_SIGNS = (None, ("fromhex",), ("\\x",), ("0x",), ("%",), ("\\u", "\\U"))
_BASE64_RUN = Runs(string.ascii_letters + string.digits + "+/", 17)
_PERCENTS = re.compile("%[0-9A-Fa-f]{2}%[0-9A-Fa-f]{2}%[0-9A-Fa-f]{2}")
_IMAGE = re.compile(r"data:image/[^;]*;base64,$", re.I)

INVISIBLE = "​‌‍⁠﻿­"
SPACES = "              　"
_TABLE = {ord(c): None for c in INVISIBLE} | {ord(c): " " for c in SPACES}
_HIDDEN = re.compile(f"[{INVISIBLE}{SPACES}]")
_BLANKS = re.compile(" {2,}")


def normalize(text: str) -> str:
    """NFKC, without invisible signs, with plain and single blanks."""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
        if _HIDDEN.search(text):
            text = text.translate(_TABLE)
    return _BLANKS.sub(" ", text) if "  " in text else text


def _near(k: int, text: str) -> bool:
    """Whether a text can hold an encoded one of _KINDS[k]."""
    signs = _SIGNS[k]
    if signs is None:
        return len(text) >= 17 and _BASE64_RUN(text.encode("utf-8", "surrogatepass"))
    if not any(s in text for s in signs):
        return False
    return _KINDS[k][0] != "url" or _PERCENTS.search(text) is not None


def payloads(text: str) -> Iterator[tuple[int, str, str]]:
    """(line, kind, encoded) in order of lines and, within one, of kinds."""
    near = [k for k in range(len(_KINDS)) if _near(k, text)]
    if not near:
        return
    for number, line in enumerate(text.splitlines(), 1):
        for k in near:
            if not _near(k, line):
                continue
            kind, p = _KINDS[k]
            for m in p.finditer(line):
                found = next(g for g in m.groups() if g is not None)
                if kind == "base64" and (len(found) < MIN_LENGTH or _IMAGE.search(line[: m.start()])):
                    continue
                if kind == "hex":
                    found = found.replace("\\x", "")
                    if len(found.replace(" ", "")) < MIN_LENGTH:
                        continue
                yield number, kind, found


def decode(kind: str, text: str) -> str | None:
    """What was encoded; None if it can't be decoded, isn't UTF-8 or is too long."""
    if kind == "url":
        return urllib.parse.unquote(text).replace("\0", "")
    if kind == "unicode_escape":
        units = re.findall(r"\\u([0-9A-Fa-f]{4})|\\U([0-9A-Fa-f]{8})", text)
        points = [int(a or b, 16) for a, b in units]
        if any(p > 0x10FFFF for p in points):
            return None
        return "".join(chr(p) for p in points if not 0xD800 <= p <= 0xDFFF)
    if int(len(text) * (0.75 if kind == "base64" else 0.5)) > MAX_DECODED:
        return None
    try:
        if kind == "hex":
            data = bytes.fromhex(text)
        else:
            bare = text.rstrip("=")
            try:
                data = base64.b64decode(text, validate=True)
            except (binascii.Error, ValueError):
                data = base64.b64decode(bare + "=" * (-len(bare) % 4), validate=True)
        return data.decode("utf-8") if len(data) <= MAX_DECODED else None
    except (binascii.Error, ValueError):
        return None
