"""Events of marked-up text.

Commands are \\name#id[args], ranges \\begin{name}...\\end{name}, fields { } and {! }, annotations <\\name ... \\>;
% starts a line comment, %{ }% a block comment that nests; a backslash protects a sign.  An event is a tuple whose
first item is its kind and whose last is its offset:

("command", name, id, args, range)  ("range_end", name, id)  ("field_start", default)  ("field_end",)
("anno_start", name, id, args)  ("anno_end", name, id)  ("data", text, protected)  ("error", message, fatal)

``protected`` lists the places in the data whose sign was written with a backslash.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from treeloom.functions.literals import LiteralError, Reader

ID = re.compile(r"[A-Za-z](?:[A-Za-z0-9_-]*[A-Za-z0-9])?")
IDNS = re.compile(r"[A-Za-z](?:[A-Za-z0-9_-]*[A-Za-z0-9])?(?::[A-Za-z](?:[A-Za-z0-9_-]*[A-Za-z0-9])?)*")
_PLAIN = re.compile(r"[^\\%{}<]+")


def _head(text: str, at: int, end: str = ""):
    """Name, id and place after them; name None if there is no identifier."""
    m = IDNS.match(text, at)
    if not m:
        return None, "", at
    name, at = m.group(), m.end()
    if text[at : at + 1] == "#":
        i = ID.match(text, at + 1)
        if i:
            return name, i.group(), i.end()
    return name, "", at


def events(text: str) -> Iterator[tuple]:
    text = re.sub("\r\n|\n\r|\r", "\n", text)
    at, n = 0, len(text)
    ranges: list[tuple[str, int]] = []
    data, protected, start = [], [], 0

    def arguments(name: str, ident: str, at: int):
        args = {}
        if text[at : at + 1] == "[":
            r = Reader(text, at)
            got = r.collection()
            at = r.at
            args = {f"#{i}": v for i, v in enumerate(got)} if isinstance(got, list) else got
        if ident:
            if "name" in args:
                raise LiteralError("name given twice", at)
            args = {"name": ident, **args}
        return args, at

    def flush():
        nonlocal data, protected
        if data:
            out = ("data", "".join(data), tuple(protected), start)
            data, protected = [], []
            return [out]
        return []

    def add(s: str, where: int, guard: bool = False):
        nonlocal start
        if not data:
            start = where
        if guard:
            protected.append(sum(map(len, data)))
        data.append(s)

    while at < n:
        c = text[at]
        if c == "%":
            if text.startswith("%{", at):
                depth, here = 1, at + 2
                while depth and here < n:
                    if text.startswith("%{", here):
                        depth, here = depth + 1, here + 2
                    elif text.startswith("}%", here):
                        depth, here = depth - 1, here + 2
                    else:
                        here += 1
                if depth:
                    yield ("error", "block comment is not closed", True, at)
                    return
                at = here
            else:
                end = text.find("\n", at)
                at = n if end < 0 else end + 1
            continue
        if text.startswith("}%", at):
            yield from flush()
            yield ("error", "end of a comment that was not begun", False, at)
            at += 2
            continue
        if text.startswith("<\\", at):
            yield from flush()
            name, ident, here = _head(text, at + 2)
            if name is None:
                yield ("error", "annotation without a name", False, at)
                at += 2
                continue
            try:
                args, here = arguments(name, ident, here)
            except LiteralError as e:
                yield ("error", str(e), False, e.at)
                args, here = {}, max(here, text.find("]", here) + 1)
            yield ("anno_start", name, ident, args, at)
            at = here
            continue
        if c == "\\":
            if text.startswith("\\>", at):
                yield from flush()
                yield ("anno_end", "", "", at)
                at += 2
                continue
            name, ident, here = _head(text, at + 1)
            if name is None:
                if at + 1 < n:
                    add(text[at + 1], at, True)
                    at += 2
                else:
                    yield from flush()
                    yield ("error", "backslash at the end", False, at)
                    at += 1
                continue
            yield from flush()
            if name in ("begin", "end"):
                if text[here : here + 1] != "{":
                    yield ("error", f"\\{name} needs a name in braces", True, at)
                    return
                inner, ident, here = _head(text, here + 1)
                if inner is None or text[here : here + 1] != "}":
                    yield ("error", f"\\{name} needs a name in braces", True, at)
                    return
                here += 1
                if name == "begin":
                    try:
                        args, here = arguments(inner, ident, here)
                    except LiteralError as e:
                        yield ("error", str(e), False, e.at)
                        args, here = {}, max(here, text.find("]", here) + 1)
                    ranges.append((inner, at))
                    yield ("command", inner, ident, args, True, at)
                else:
                    if not ranges:
                        yield ("error", f"\\end{{{inner}}} without a beginning", False, at)
                    elif ranges[-1][0] != inner:
                        yield ("error", f"\\end{{{inner}}} does not match \\begin{{{ranges[-1][0]}}}", False, at)
                    else:
                        ranges.pop()
                        yield ("range_end", inner, ident, at)
                at = here
                continue
            if name.split(":")[0] in ("begin", "end"):
                yield ("error", "begin and end have no namespace", False, at)
            if text[here : here + 1] == ">" and not text.startswith(">>", here):
                yield ("anno_end", name, ident, at)
                at = here + 1
                continue
            try:
                args, here = arguments(name, ident, here)
            except LiteralError as e:
                yield ("error", str(e), False, e.at)
                args, here = {}, max(here, text.find("]", here) + 1)
            if args and text[here : here + 1] == ">" and set(args) <= {"name"}:
                yield ("anno_end", name, args.get("name", ident), at)
                at = here + 1
                continue
            yield ("command", name, ident, args, False, at)
            at = here
            continue
        if c == "{":
            yield from flush()
            default = text.startswith("{!", at)
            yield ("field_start", default, at)
            at += 2 if default else 1
            continue
        if c == "}":
            yield from flush()
            yield ("field_end", at)
            at += 1
            continue
        m = _PLAIN.match(text, at)
        piece = m.group() if m else c
        add(piece, at)
        at += len(piece)
    yield from flush()
    for name, where in ranges:
        yield ("error", f"\\begin{{{name}}} is not closed", True, where)
