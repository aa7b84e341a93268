"""Values of literals, and values as canonical JSON."""

from __future__ import annotations

import base64
import json
import math
import re

ESCAPES = {b"n": b"\n", b"t": b"\t", b"r": b"\r", b"v": b"\v", b"f": b"\f", b"e": b"\x1b", b"\\": b"\\", b"$": b"$", b'"': b'"'}
_ESCAPE = re.compile(rb"\\([ntrvfe\\$\"]|x[0-9A-Fa-f]{1,2}|[0-7]{1,3}|u\{[0-9A-Fa-f]{1,8}\})")


def canonical(v, indent: int | None = None) -> str:
    """Sorted keys, no spaces (or one of indent), non-ASCII as it is."""
    return json.dumps(v, sort_keys=True, ensure_ascii=False, indent=indent, separators=(",", ": " if indent else ":"))


def scalar(v):
    """A scalar as JSON can hold it without loss."""
    if isinstance(v, bytes):
        try:
            return v.decode("utf-8")
        except UnicodeDecodeError:
            return {"__b64": base64.b64encode(v).decode()}
    if isinstance(v, float) and not math.isfinite(v):
        return {"__float": "NAN" if math.isnan(v) else "INF" if v > 0 else "-INF"}
    return v


def typed(v) -> dict:
    """A scalar by its type, as column expressions write it to JSON (functions/json_columns)."""
    part = "flag" if isinstance(v, bool) else "whole" if isinstance(v, int) else "real" if isinstance(v, float) else "bytes"
    return {part: v.encode() if isinstance(v, str) else v}


def unescaped(body: bytes) -> bytes:
    def one(m: re.Match) -> bytes:
        x = m[1]
        if x in ESCAPES:
            return ESCAPES[x]
        if x[:1] == b"x":
            return bytes([int(x[1:], 16)])
        if x[:1] != b"u":
            return bytes([int(x, 8) & 255])
        code = int(x[2:-1], 16)
        return chr(code).encode("utf-8", "surrogatepass") if code < 0x110000 else m[0]

    return _ESCAPE.sub(one, body)


def unquoted(raw: bytes) -> bytes:
    """The value of a string literal; a heredoc loses the indentation of its closing line."""
    if raw[:3] != b"<<<":
        return re.sub(rb"\\([\\'])", rb"\1", raw[1:-1]) if raw[:1] == b"'" else unescaped(raw[1:-1])
    lines = raw.split(b"\n")
    margin = len(lines[-1]) - len(lines[-1].lstrip(b" \t"))
    cut = [x[margin:] if not x[:margin].strip(b" \t") else x for x in lines[1:-1]]
    body = b"\n".join(cut).removesuffix(b"\r")
    return body if b"'" in lines[0] else unescaped(body)


def number(raw: str) -> int | float:
    """Integers beyond 64 bits become floats; digits that are missing count as none."""
    s = raw.replace("_", "").lower()
    base = {"0x": 16, "0b": 2, "0o": 8}.get(s[:2], 8 if re.fullmatch("0[0-7]+", s) else 10)
    if base == 10 and not s.isdigit():
        return float(s)
    digits = s[2:] if s[1:2] in ("x", "b", "o") else s
    if len(digits) > 1100:
        return float(s) if base == 10 else math.inf
    n = int(digits or "0", base)
    return n if n < 1 << 63 else float(n) if n < 1 << 1023 else math.inf
