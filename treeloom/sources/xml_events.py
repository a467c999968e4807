"""Events of XML markup: elements are range commands, a:start:X and a:end:X (a:end for the last) annotations."""

from __future__ import annotations

from collections.abc import Iterator
from xml.parsers import expat

from treeloom.functions.literals import read


def events(text: str, wrapper: tuple[str, ...] = ("markup",)) -> Iterator[tuple]:
    """Same events as those of text markup.  A top-level wrapper element and xmlns attributes at depth 1 are skipped."""
    out: list[tuple] = []
    depth = 0
    raw = text.encode()
    parser = expat.ParserCreate("utf-8")
    parser.ordered_attributes = True

    def start(name, attributes):
        nonlocal depth
        depth += 1
        if depth == 1 and name in wrapper:
            return
        args = {}
        for k, v in zip(attributes[::2], attributes[1::2]):
            if not (k == "xmlns" or k.startswith("xmlns:")):
                args[k] = v if k in ("name", "ref", "type", "src", "rel", "isa", "parent") else read(v)
        at = parser.CurrentByteIndex
        if name.startswith("a:start:"):
            out.append(("anno_start", name[8:], args.get("name", ""), args, at))
        elif name == "a:end" or name.startswith("a:end:"):
            out.append(("anno_end", name[6:], args.get("name", ""), at))
        else:
            out.append(("command", name, args.get("name", ""), args, True, at))

    def end(name):
        nonlocal depth
        depth -= 1
        if depth == 0 and name in wrapper or name == "a:end" or name.startswith("a:end:"):
            return
        if name.startswith("a:start:"):
            out.append(("anno_content_end", name[8:], parser.CurrentByteIndex))
        else:
            out.append(("range_end", name, "", parser.CurrentByteIndex))

    def data(s):
        if out and out[-1][0] == "data":
            out[-1] = ("data", out[-1][1] + s, (), out[-1][3])
        else:
            out.append(("data", s, (), parser.CurrentByteIndex))

    parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler = start, end, data
    try:
        parser.Parse(raw, True)
    except expat.ExpatError as e:
        out.append(("error", expat.ErrorString(e.code), True, parser.ErrorByteIndex))
    yield from out


def attribute_offsets(text: str, at: int) -> dict[str, tuple[int, int]]:
    """Byte offsets (start, end) of the values of a start tag's attributes; at: where the tag begins."""
    raw, out = text.encode(), {}
    i = at + 1
    while i < len(raw) and raw[i : i + 1] not in (b">", b" ", b"\t", b"\n", b"\r", b"/"):
        i += 1
    while i < len(raw) and raw[i : i + 1] not in (b">", b"/"):
        while i < len(raw) and raw[i : i + 1] in (b" ", b"\t", b"\n", b"\r"):
            i += 1
        eq = raw.find(b"=", i)
        if eq < 0 or raw[i : i + 1] in (b">", b"/"):
            break
        name = raw[i:eq].strip().decode()
        q = eq + 1
        while raw[q : q + 1] not in (b'"', b"'"):
            q += 1
            if q >= len(raw):
                return out
        end = raw.find(raw[q : q + 1], q + 1)
        out[name] = (q + 1, end)
        i = end + 1
    return out
