"""Command line: python -m treeloom INPUT [-I FOLDER]... [-o OUTPUT] [-F xml|html] [-f].

Exit status 0: written; 1: the document has errors; 2: wrong use.
"""

from __future__ import annotations

import argparse
import os
import sys

from treeloom.sinks import document_element, html_document, import_elements, schema_element
from treeloom.sources.builder import Builder
from treeloom.sources.locator import DEFAULT_ROOTS, Locator
from treeloom.sources.reader import kind_of, source_events


def context(text: str, at: int, most: int = 80) -> tuple[str, str]:
    """The line of a place, cut to so many characters around it, and a mark below the place."""
    begin = text.rfind("\n", 0, at) + 1
    end = text.find("\n", at)
    line = text[begin : end if end >= 0 else len(text)]
    first = max(0, min(at - begin - most // 2, len(line) - most))
    shown = line[first : first + most].replace("\t", " ").replace("\r", " ")
    before, after = "..." if first else "", "..." if first + most < len(line) else ""
    return before + shown + after, " " * (len(before) + at - begin - first) + "^"


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser("treeloom", description="Marked-up documents to XML or HTML.")
    p.add_argument("input")
    p.add_argument("-I", "--include", action="append", default=[], help="folder with modules; the last is searched first")
    p.add_argument("-o", "--output", help="file to write; standard output if not given")
    p.add_argument("-F", "--format", choices=("xml", "html"), default="xml")
    p.add_argument("-f", "--flat", action="store_true", help="write the schemas into the document")
    try:
        a = p.parse_args(argv)
    except SystemExit as e:
        return 2 if e.code else 0
    if not os.path.isfile(a.input):
        print(f"{a.input}: no such file", file=sys.stderr)
        return 2
    where = Locator({"": [os.path.dirname(os.path.abspath(a.input))]})
    where.add_roots(*DEFAULT_ROOTS, *a.include)

    def load(rel, src):
        found = where.locate(src, rel, a.input)
        if found is None:
            return None
        body = where.read(found)
        return source_events(body, kind_of(body))

    text = where.read(os.path.abspath(a.input))
    b = Builder(0, None, load).run(source_events(text, kind_of(text)))
    for _, severity, code, message, at in b.diagnostics:
        line = text.count("\n", 0, at) + 1
        column = at - (text.rfind("\n", 0, at) + 1) + 1
        print(f"{a.input}:{line}:{column}: {severity}: {message} ({code})", file=sys.stderr)
        print(*context(text, at), sep="\n", file=sys.stderr)
    if a.format == "html":
        try:
            out = html_document(b.nodes, b.annotations)
        except ValueError as e:
            print(e, file=sys.stderr)
            return 1
    else:
        fields = {c: [f.name for f in b.schema.fields_of(c) if not f.tree] for c in b.schema.classes}
        root = document_element(b.nodes, b.annotations, fields)
        if a.flat:
            root.children = schema_element(b.schema) + root.children
        else:
            root.children = import_elements(b.direct) + root.children
        out = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n' + root.lines(True)
    if a.output:
        with open(a.output, "w", encoding="utf-8") as f:
            f.write(out)
    else:
        sys.stdout.write(out)
    return int(any(d[1] in ("error", "fatal") for d in b.diagnostics))


if __name__ == "__main__":
    sys.exit(main())
