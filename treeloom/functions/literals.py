"""Reader and writer of literals: strings, numbers, cardinalities, arrays, maps, booleans, null, identifiers.

Values are plain Python: None, bool, int, float, str, list, dict, plus ``Identifier`` (an unquoted name, which may
stand for a constant or an enumeration entry) and ``Cardinality`` (ranges with inclusive ends, None: open).
"""

from __future__ import annotations

import json
import re


class Identifier(str):
    """An unquoted name."""


class Cardinality(list):
    """[(start, end or None), ...]"""

    def __contains__(self, n):
        return any(a <= n and (b is None or n <= b) for a, b in self)

    @property
    def least(self):
        return min((a for a, _ in self), default=0)


ANY = Cardinality([(0, None)])


class LiteralError(ValueError):
    """A malformed literal, with its place."""

    def __init__(self, message: str, at: int):
        super().__init__(f"{message} at {at}")
        self.at = at


_SPACE = re.compile(r"[ \t\r\n]*")
_NUMBER = re.compile(r"-?(?:0x[0-9A-Fa-f]+|[0-9]+(?:\.[0-9]*)?(?:[eE][+-]?[0-9]+)?)")
_NAME = re.compile(r"[A-Za-z](?:[A-Za-z0-9_:-]*[A-Za-z0-9])?")
_PART = re.compile(r"\s*(?:(\*)|>\s*(\d+)|<\s*(\d+)|(\d+)\s*-\s*(\d+)|(\d+))\s*$")
_ESCAPES = {"b": "\b", "f": "\f", "n": "\n", "r": "\r", "t": "\t", "v": "\v", "'": "'", '"': '"', "\\": "\\"}


def cardinality(text: str) -> Cardinality:
    """Ranges of "{...}"; raises LiteralError."""
    body = text.strip()
    if not (body.startswith("{") and body.endswith("}")):
        raise LiteralError("no cardinality", 0)
    out = Cardinality()
    for part in body[1:-1].split(","):
        m = _PART.match(part)
        if not m:
            raise LiteralError(f"bad range {part!r}", 0)
        every, above, below, low, high, one = m.groups()
        if every:
            out.append((0, None))
        elif above:
            out.append((int(above) + 1, None))
        elif below:
            if int(below) == 0:
                raise LiteralError("empty range", 0)
            out.append((0, int(below) - 1))
        elif one:
            out.append((int(one), int(one)))
        else:
            if int(high) <= int(low):
                raise LiteralError("empty range", 0)
            out.append((int(low), int(high)))
    return out


class Reader:
    """Reads one literal after another from a text."""

    def __init__(self, text: str, at: int = 0):
        self.text, self.at = text, at

    def skip(self) -> None:
        self.at = _SPACE.match(self.text, self.at).end()

    def peek(self) -> str:
        return self.text[self.at : self.at + 1]

    def string(self) -> str:
        quote, out = self.peek(), []
        start = self.at
        self.at += 1
        while True:
            c = self.peek()
            if c in ("", "\n", "\r"):
                raise LiteralError("unterminated string", start)
            self.at += 1
            if c == quote:
                return "".join(out)
            if c != "\\":
                out.append(c)
                continue
            e = self.peek()
            self.at += 1
            if e in _ESCAPES:
                out.append(_ESCAPES[e])
            elif e in "xu":
                n = 2 if e == "x" else 4
                digits = self.text[self.at : self.at + n]
                if not re.fullmatch(f"[0-9A-Fa-f]{{{n}}}", digits):
                    raise LiteralError("bad escape", self.at)
                out.append(chr(int(digits, 16)))
                self.at += n
            elif m := re.compile("[0-7]{1,3}").match(self.text, self.at - 1):
                out.append(chr(int(m.group(), 8)))
                self.at = m.end()
            elif e == "\n":
                continue
            else:
                raise LiteralError("bad escape", self.at)

    def value(self, stop: str = ""):
        """The next literal; text that is none is read up to a stop character and trimmed."""
        self.skip()
        c = self.peek()
        if c in ('"', "'") and c:
            return self.string()
        if c == "[":
            return self.collection()
        if c == "{":
            end = self.text.find("}", self.at)
            if end < 0:
                raise LiteralError("unterminated cardinality", self.at)
            body, self.at = self.text[self.at : end + 1], end + 1
            return cardinality(body)
        m = _NUMBER.match(self.text, self.at)
        if m and self._ends(m.end(), stop):
            self.at = m.end()
            t = m.group()
            if "x" in t:
                n = int(t, 16)
            elif re.fullmatch("-?[0-9]+", t):
                n = int(t)
            else:
                return float(t)
            if not -(2**31) <= n < 2**31:
                raise LiteralError("number out of range", m.start())
            return n
        m = _NAME.match(self.text, self.at)
        if m and self._ends(m.end(), stop):
            self.at = m.end()
            return {"true": True, "false": False, "null": None}.get(m.group(), Identifier(m.group())) if m.group() in ("true", "false", "null") else Identifier(m.group())
        start = self.at
        while self.peek() and self.peek() not in stop:
            self.at += 1
        return self.text[start : self.at].strip()

    def _ends(self, at: int, stop: str) -> bool:
        at = _SPACE.match(self.text, at).end()
        return at >= len(self.text) or self.text[at] in stop

    def collection(self, opener: str = "[", closer: str = "]"):
        """[a, b] is a list; with any k=v a dict, positional entries keyed #i."""
        start = self.at
        self.at += 1
        entries, keyed = [], False
        while True:
            self.skip()
            if self.peek() == closer:
                self.at += 1
                break
            if not self.peek():
                raise LiteralError("unterminated collection", start)
            key, save = None, self.at
            if self.peek() in ('"', "'"):
                key = self.string()
            elif m := _NAME.match(self.text, self.at):
                key, self.at = m.group(), m.end()
            self.skip()
            if key is not None and self.peek() == "=":
                self.at += 1
                keyed = True
            else:
                key, self.at = None, save
            entries.append((key, self.value("," + closer)))
            self.skip()
            if self.peek() == ",":
                self.at += 1
            elif self.peek() != closer:
                # go on at the next comma
                while self.peek() and self.peek() not in "," + closer:
                    self.at += 1
                raise LiteralError("expected a comma", self.at)
        if not keyed:
            return [v for _, v in entries]
        return {(k if k is not None else f"#{i}"): v for i, (k, v) in enumerate(entries)}


def read(text: str):
    """The literal that is the whole text."""
    r = Reader(text)
    v = r.value()
    r.skip()
    if r.at < len(text):
        return text.strip()
    return v


def plain(v):
    """JSON-like form: cardinalities as their text."""
    if isinstance(v, Cardinality):
        return write_cardinality(v)
    if isinstance(v, list):
        return [plain(x) for x in v]
    if isinstance(v, dict):
        return {k: plain(x) for k, x in sorted(v.items())}
    return str(v) if isinstance(v, Identifier) else v


def write_json(v) -> str:
    return json.dumps(plain(v), ensure_ascii=False, sort_keys=True, separators=(",", ":"))


def write_cardinality(c: Cardinality) -> str:
    def one(a, b):
        return "*" if (a, b) == (0, None) else f">{a - 1}" if b is None else str(a) if a == b else f"<{b + 1}" if a == 0 else f"{a}-{b}"

    return "{" + ",".join(one(a, b) for a, b in c) + "}"


def write_native(v, pretty: bool = False, depth: int = 0) -> str:
    """[1, 2] and ["k"= v]; keys sorted; pretty: a line and tabs for each entry."""
    if isinstance(v, Cardinality):
        return write_cardinality(v)
    if isinstance(v, (list, dict)):
        if isinstance(v, dict):
            parts = [f"{json.dumps(k, ensure_ascii=False)}{'= ' if pretty else '='}{write_native(x, pretty, depth + 1)}" for k, x in sorted(v.items())]
        else:
            parts = [write_native(x, pretty, depth + 1) for x in v]
        if not pretty or not parts:
            return "[" + ",".join(parts) + "]"
        tabs = "\t" * (depth + 1)
        return "[\n" + ",\n".join(tabs + p for p in parts) + "\n" + "\t" * depth + "]"
    if v is None:
        return "null"
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, str):
        return json.dumps(v, ensure_ascii=False)
    return str(v)
