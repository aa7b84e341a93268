"""The token automaton over one stretch of a file: what it does to each mode, and the tokens in it.

A file is cut into stretches behind a line feed or a semicolon, where no token
but space is under way outside of a gap, a comment or a string.  So all that a
stretch has to know of what came before is a mode, and what a stretch does is a
map of modes to modes; maps of neighbours compose.  A mode is

* ``code``, ``gap`` (text outside the script), ``line`` and ``block`` (comments);
* a quote, how many braces of an expression in the string are open, and the
  quote of a string in that expression, if any: ``"0``, ``"2'``;
* ``doc`` and a label: within a string that ends at the first line that begins
  with its label.  Labels are without number; a map holds those that begin a
  line of the stretch, and any other goes on.

Each byte is passed once a mode at most, and a mode that meets another at the
same place goes with it, so time is linear whatever the bytes.
"""

from __future__ import annotations

import re
from bisect import bisect_left

MOST_BRACES = 5
_IDENT = rb"[A-Za-z_\x80-\xff][A-Za-z0-9_\x80-\xff]*+"
_OPEN = re.compile(rb"<\?(?:[pP][hH][pP](?=[ \t\r\n]|\Z)|=)")
_LINE_END = re.compile(rb"\?>|[\r\n]")
_LINE_LABEL = re.compile(rb"(?m)^[ \t]*+(" + _IDENT + rb")")
#: A string up to its quote or an expression in it, a string within an expression, and what counts in an expression.
_PLAIN = {'"': re.compile(rb'(?s)(?:[^"\\{$]++|\\.|\\\Z|\{(?!\$)|\$(?!\{))*+'), "`": re.compile(rb"(?s)(?:[^`\\{$]++|\\.|\\\Z|\{(?!\$)|\$(?!\{))*+"), "'": re.compile(rb"(?s)(?:[^'\\]++|\\.|\\\Z)*+")}
_INNER = {"'": _PLAIN["'"], '"': re.compile(rb'(?s)(?:[^"\\]++|\\.|\\\Z)*+')}
_EXPRESSION = re.compile(rb"['\"{}]")
_CODE = re.compile(rb"(?s)" + b"|".join([
    rb"(?P<skip>[ \t\r\n\x0B\f]++)", rb"(?P<line>//|\#(?!\[))", rb"(?P<block>/\*)", rb"(?P<gap>\?>(?:\r?\n)?)", rb"(?P<var>\$" + _IDENT + rb")",
    rb"(?P<num>0[xX][0-9a-fA-F_]++|0[bB][01_]++|0[oO][0-7_]++|(?:[0-9][0-9_]*+)?\.[0-9][0-9_]*+(?:[eE][+-]?[0-9]++)?|[0-9][0-9_]*+(?:\.(?!\.))?(?:[eE][+-]?[0-9]++)?)",
    rb"(?P<name>\\?" + _IDENT + rb"(?:\\" + _IDENT + rb")*+(?:\\(?=\{))?)", rb"(?P<quote>['\"`])", rb"(?P<doc><<<[ \t]*+(?P<q>['\"]?)(?P<label>" + _IDENT + rb")(?P=q)\r?\n)",
    rb"(?P<op><=>|\*\*=|\.\.\.|<<=|>>=|===|!==|\?\?=|\?->|\+\+|--|->|=>|::|==|!=|<>|<=|>=|&&|\|\||\?\?|\+=|-=|\*=|/=|\.=|%=|&=|\|=|\^=|<<|>>|\*\*|\#\[|.)",
]))
MODES = ("gap", "code", "line", "block", "'0", *(f"{q}{n}{i}" for q in '"`' for n in range(MOST_BRACES + 1) for i in ("", "'", '"') if n or not i))


class Stretch:
    """The bytes of a stretch; ``fresh`` if they begin a line."""

    def __init__(self, data: bytes, fresh: bool):
        self.data, self.fresh = data, fresh
        self.labels: dict[str, list[int]] | None = None

    def label_ends(self, label: str) -> list[int]:
        """Places behind each ``label`` that begins a line."""
        if self.labels is None:
            self.labels = {}
            for m in _LINE_LABEL.finditer(self.data):
                if m.start() or self.fresh:
                    self.labels.setdefault(m[1].decode("latin-1"), []).append(m.end())
        return self.labels.get(label, [])

    def through(self, mode: str, at: int) -> tuple[int, str]:
        """Where what is under way in ``mode`` ends, and the mode there: code, or a mode of the same kind if the stretch ends first."""
        data, end = self.data, len(self.data)
        if mode == "gap":
            return (m.end(), "code") if (m := _OPEN.search(data, at)) else (end, mode)
        if mode == "line":
            return (m.start(), "code") if (m := _LINE_END.search(data, at)) else (end, mode)
        if mode == "block":
            return (i + 2, "code") if (i := data.find(b"*/", at)) >= 0 else (end, mode)
        if mode.startswith("doc "):
            ends = self.label_ends(label := mode[4:])
            i = bisect_left(ends, at + len(label))
            return (ends[i], "code") if i < len(ends) else (end, mode)
        quote, braces, inner = mode[0], int(mode[1]), mode[2:]
        while at < end:
            if inner:
                at = _INNER[inner].match(data, at).end() + 1
                inner = inner if at > end else ""
            elif braces:
                m = _EXPRESSION.search(data, at)
                at = m.end() if m else end
                if m and m[0] in b"{}":
                    braces = min(braces + 1, MOST_BRACES) if m[0] == b"{" else braces - 1
                elif m:
                    inner = m[0].decode()
            else:
                at = _PLAIN[quote].match(data, at).end()
                if at < end and data[at] == ord(quote):
                    return at + 1, "code"
                at, braces = at + 2, braces + (at < end)
        return end, f"{quote}{braces}{inner}"

    def begun(self, m: re.Match) -> str:
        """The mode that a token of code begins, code itself for whole ones."""
        kind = m.lastgroup
        if kind == "quote":
            return m[0].decode() + "0"
        if kind == "doc":
            return "doc " + m["label"].decode("latin-1")
        return kind if kind in ("gap", "line", "block") else "code"

    def effects(self) -> dict[str, str]:
        """The mode behind the stretch for each mode before it."""
        behind: dict[int, str] = {len(self.data): "code"}

        def from_code(at: int) -> str:
            passed, out = [], None
            while out is None:
                if (out := behind.get(at)) is None:
                    passed.append(at)
                    m = _CODE.match(self.data, at)
                    at, mode = m.end(), self.begun(m)
                    if mode != "code":
                        at, mode = self.through(mode, at)
                        out = None if mode == "code" else mode
            behind.update(dict.fromkeys(passed, out))
            return out

        found = {}
        for mode in MODES:
            at, after = (0, mode) if mode == "code" else self.through(mode, 0)
            found[mode] = from_code(at) if after == "code" else after
        self.label_ends("")
        return found | {f"doc {label}": from_code(ends[0]) for label, ends in self.labels.items()}

    def tokens(self, mode: str, first: bool) -> list[tuple[int, int, str, bool, str]]:
        """(start, end, type, whether it begins here, mode behind it) of every token or part of one; ``first`` if the file begins here."""
        out: list[tuple[int, int, str, bool, str]] = []
        at, end = 0, len(self.data)
        if mode != "code" and (end or first):
            at, after = self.through(mode, 0)
            out.append((0, at, kind_of(mode), first, after))
        while at < end:
            m = _CODE.match(self.data, at)
            begun = self.begun(m)
            if begun == "code":
                out.append((at, at := m.end(), m.lastgroup, True, "code"))
            else:
                start = at
                at, after = self.through(begun, m.end())
                out.append((start, at, kind_of(begun), True, after))
        return out


def kind_of(mode: str) -> str:
    """gap, skip (comments) or str."""
    return "gap" if mode == "gap" else "skip" if mode in ("line", "block") else "str"


def cuts(data: bytes, size: int) -> list[int]:
    """Where stretches of about ``size`` bytes end: behind the next line feed or semicolon, and at the end."""
    ends, at, following = [], 0, {b"\n": 0, b";": 0}
    while len(data) - at > size:
        for mark, place in following.items():
            if 0 <= place < at + size:
                following[mark] = data.find(mark, at + size - 1) + 1 or -1
        places = [p for p in following.values() if p > 0]
        if not places:
            break
        at = min(places)
        ends.append(at)
    return ends + [len(data)] if not ends or ends[-1] < len(data) else ends
