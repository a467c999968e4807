"""Push-down builder: events to schemas and to node rows.

A stack of frames holds what is open.  Schema statements nest by a table of parents.  In a document, a command opens
the class of its name; where the class is not a direct child, transparent classes on the shortest path are opened
first, and frames that can't take it are closed.  Text goes to the nearest default field whose type accepts it.
Speculative frames leave nothing behind when they are given up.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

from treeloom.functions.literals import ANY, Cardinality, Identifier, LiteralError, cardinality, read, write_json
from treeloom.sources.schema import BUILTIN, BuildError, ClassDef, FieldDef, Schema, TypeDef
from treeloom.sources.tokens import BLANKS, Trie, first_word, protect, take

#: Statement -> statements it may stand in.
PARENTS = {
    "document": {""}, "ontology": {"", "document"}, "typesystem": {"", "document", "ontology"},
    "import": {"", "document", "ontology", "typesystem"}, "include": {"", "document", "ontology", "typesystem"},
    "struct": {"ontology", "typesystem"}, "annotation": {"ontology"}, "attributes": {"struct", "annotation"},
    "attribute": {"attributes"}, "field": {"struct", "annotation", "parentRef"}, "fieldRef": {"struct", "annotation", "parentRef"},
    "primitive": {"struct", "annotation", "parentRef"}, "childRef": {"field", "fieldRef"}, "parentRef": {"struct"},
    "syntax": {"struct", "annotation", "field", "primitive"}, "open": {"syntax"}, "close": {"syntax"}, "short": {"syntax"}, "whitespace": {"syntax"},
    "enum": {"typesystem"}, "entry": {"enum"}, "constant": {"typesystem"},
}
SPECIAL = {"newline", "paragraph", "section", "indent", "dedent"}
#: Where a typesystem statement of this name stands, its struct and field are those of values.
_BREAKS = re.compile(r"[ \t]*(?:\n[ \t]*)+")


@dataclass
class Frame:
    kind: str  # a statement, "entity", "span" (content of an annotation)
    name: str = ""
    node: dict | None = None
    cls: ClassDef | None = None
    definition: object = None
    ranged: bool = False
    implicit: bool = False
    in_field: FieldDef | None = None
    explicit: bool = False
    ended: bool = False  # its default field was closed
    used: int = 0  # explicit fields opened
    content: bool = False
    close: str = ""
    greedy: bool = True  # False: a short token opened it, it takes one word or element
    text: list = field(default_factory=list)


class Builder:
    """Reads the events of one module; ``load`` gives the events of an imported one by (kind, path)."""

    def __init__(self, doc_id=0, schema: Schema | None = None, load: Callable[[str, str], Iterator[tuple]] | None = None, loading: tuple = (), tokens: bool = True):
        self.tokens = tokens  # False: user-defined tokens are text, as in XML
        self.doc_id, self.schema, self.load, self.loading = doc_id, schema or Schema(), load, loading
        self.nodes: list[dict] = []
        self.positions: dict[tuple, int] = {}  # last position in a parent's field
        self.annotations: list[dict] = []
        self.diagnostics: list[tuple] = []
        self.imports: list[tuple[str, str]] = []  # of all modules
        self.direct: list[tuple[str, str]] = []  # of this one
        self.stack = [Frame("")]
        self.open_annotations: list[dict] = []
        self.indents, self.said, self.tries = [0], set(), {}
        self.pending: list[Callable] = []
        self.at = 0
        self.ontology = self.system = ""
        self.fatal = False

    # ------------------------------------------------------------ driver

    def say(self, severity: str, code: str, message: str) -> None:
        self.diagnostics.append((self.doc_id, severity, code, message, self.at))

    def run(self, source: Iterator[tuple]) -> Builder:
        first = True
        for e in source:
            self.at = e[-1]
            if first and e[0] == "command":
                first = False
                if e[1] not in ("document", "ontology", "typesystem"):
                    self.stack.append(Frame("document", implicit=True))
            if self.fatal:
                break
            getattr(self, "on_" + e[0])(*e[1:-1])
        self.finish()
        return self

    def finish(self) -> None:
        for f in self.stack:
            if f.explicit and f.in_field is not None:
                self.say("error", "field_open", f"field of {f.name} is not closed")
        while len(self.stack) > 1:
            self.pop()
        for p in self.pending:
            p()
        for a in self.open_annotations:
            self.say("error", "annotation_open", f"annotation {a['class_name']} is not closed")
        self.open_annotations = []

    def on_error(self, message, fatal):
        self.say("error", "syntax", message)
        self.fatal = self.fatal or fatal

    # ------------------------------------------------------------ stack

    def pop(self) -> None:
        f = self.stack.pop()
        self.end_statement(f)

    def top(self) -> Frame:
        return self.stack[-1]

    def pop_satisfied(self) -> None:
        """Elements of a short token that take one thing only have had it."""
        while self.top().kind == "entity" and not self.top().greedy and self.top().content and not self.top().explicit:
            self.pop()

    def in_document(self) -> bool:
        return any(f.kind == "document" for f in self.stack) and not any(f.kind in ("ontology", "typesystem") for f in self.stack)

    def on_command(self, name, ident, args, ranged):
        depth = len(self.stack)
        self.pop_satisfied()
        while True:
            f = self.top()
            if f.kind in ("entity", "span"):
                if not f.ended and self.open_entity(f, name, args, ranged):
                    return
            elif name in PARENTS and f.kind in PARENTS[name] and not (f.kind in ("field", "primitive") and f.definition is None):
                self.statement(name, args, ranged)
                return
            elif f.kind == "document" and self.open_root(name, args, ranged):
                return
            if f.ranged or f.explicit or len(self.stack) == 1:
                self.at_fault(name, depth)
                # what belongs to the unknown command is skipped
                self.stack.append(Frame("unknown", name, ranged=ranged))
                return
            if f.kind == "document" and not f.implicit or f.kind == "":
                self.at_fault(name, depth)
                self.stack.append(Frame("unknown", name, ranged=ranged))
                return
            self.pop()

    def at_fault(self, name, depth):
        self.say("error", "not_allowed", f"\\{name} can't stand here")

    def on_range_end(self, name, ident):
        while len(self.stack) > 1:
            f = self.top()
            self.pop()
            if f.ranged and f.name.split(":")[-1] == name.split(":")[-1]:
                return
        self.say("error", "range_end", f"no open {name}")

    def on_anno_content_end(self, name):
        if not any(f.kind in ("span", "unknown") and f.name == name for f in self.stack):
            return  # an annotation without fields
        while len(self.stack) > 1:
            f = self.top()
            self.pop()
            if f.kind == "span" or f.kind == "unknown" and f.name == name:
                return

    # ------------------------------------------------------------ fields

    def on_field_start(self, default):
        while self.top().implicit and self.top().kind == "entity" and not self.top().explicit:
            self.pop()
        f = self.top()
        if f.kind in ("entity", "span") and not f.explicit and not f.ended:
            fields = self.schema.fields_of(f.cls.name)
            if default:
                target = fields[-1] if fields and fields[-1].tree else None
            else:
                target = fields[f.used] if f.used < len(fields) else None
                f.used += 1
            if target is None:
                self.say("error", "no_field", f"{f.name} has no such field")
                target = FieldDef("", tree=False)
            f.in_field, f.explicit = target, True
            return
        if f.explicit or f.ended or f.kind == "":
            self.say("error", "field", "a field can't start here")
            self.stack.append(Frame("unknown", "{", explicit=True))
            return
        f.explicit = True

    def on_field_end(self):
        k = next((k for k in range(len(self.stack) - 1, 0, -1) if self.stack[k].explicit), None)
        if k is None:
            self.say("error", "field", "there is no field to end")
            return
        while len(self.stack) - 1 > k:
            self.pop()
        f = self.top()
        if f.kind == "unknown" and f.name == "{":
            self.pop()
            return
        f.explicit = False
        was, f.in_field = f.in_field, None
        if f.kind in ("entity", "span"):
            f.ended = was is not None and was.tree
        else:
            f.ended = True

    # ------------------------------------------------------------ documents

    def add_node(self, kind, parent, fieldname, **more) -> dict:
        place = (parent["node_id"] if parent else None, fieldname)
        pos = self.positions[place] = self.positions.get(place, -1) + 1
        node = {"doc_id": self.doc_id, "node_id": len(self.nodes), "parent_id": parent["node_id"] if parent else None, "field_name": fieldname, "pos": pos, "kind": kind, "ontology": "", "class_name": "", "name": "", "transparent": False, "attributes": None, "content": None, "anno_id": None, "src_start": self.at} | more
        self.nodes.append(node)
        return node

    def entity(self, parent, fieldname, cls: ClassDef, args, transparent) -> dict:
        args = dict(args)
        name = args.pop("name", "") or ""
        try:
            built = self.schema.struct(self.schema.attributes_of(cls.name), args)
        except BuildError as e:
            self.say("error", "attributes", str(e))
            built = {n: d if o else self.schema.zero(k) for n, k, d, o in self.schema.attributes_of(cls.name)}
        onto, _, short = cls.name.partition(":")
        return self.add_node("entity", parent, fieldname, ontology=onto, class_name=short, name=str(name), transparent=transparent, attributes=write_json(built) if built else None)

    def push(self, node, cls, ranged=False, implicit=False, close=None):
        self.stack.append(Frame("entity", cls.name, node, cls, ranged=ranged, implicit=implicit, close=cls.close if close is None else close))

    def open_root(self, name, args, ranged) -> bool:
        key = self.schema.find(self.schema.classes, name)
        if key is None or self.schema.classes[key].annotation:
            return False
        if any(n["parent_id"] is None and n["kind"] == "entity" for n in self.nodes):
            self.say("warning", "second_root", f"{name} is ignored: the document has a root")
            self.stack.append(Frame("unknown", name, ranged=ranged))
            return True
        cls = self.schema.classes[key]
        self.push(self.entity(None, "", cls, args, False), cls, ranged)
        return True

    def current_field(self, f: Frame) -> FieldDef | None:
        if f.in_field is not None:
            return f.in_field
        fields = self.schema.fields_of(f.cls.name)
        return fields[-1] if fields and fields[-1].tree else None

    def open_entity(self, f: Frame, name, args, ranged) -> bool:
        if f.in_field is None and not f.content:
            for x in self.schema.fields_of(f.cls.name):
                if x.name == name and x.name:
                    f.used += 1
                    self.stack.append(Frame("entity", name, f.node, f.cls, ranged=ranged, in_field=x))
                    return True
        target = self.current_field(f)
        if target is None or target.primitive:
            return False
        key = self.resolve_class(target, name, f.cls.name)
        if key is None:
            return False
        return self.descend(f, target, key, args, ranged)

    def resolve_class(self, target: FieldDef, name: str, owner: str) -> str | None:
        reach = self.schema.paths(target)
        ends = [c for c in reach if c == name or c.split(":")[-1] == name]
        same = [c for c in ends if c.split(":")[0] == owner.split(":")[0]]
        found = same or ends
        return min(found, key=lambda c: len(reach[c])) if found else None

    def descend(self, f: Frame, target: FieldDef, key: str, args, ranged, implicit=False, close=None) -> bool:
        parent, fieldname = f.node, target.name
        f.content = True
        for c in self.schema.paths(target)[key]:
            cls = self.schema.classes[c]
            node = self.entity(parent, fieldname, cls, {}, True)
            self.push(node, cls, implicit=True)
            self.top().content = True
            parent, fieldname = node, self.schema.fields_of(c)[-1].name
        cls = self.schema.classes[key]
        self.push(self.entity(parent, fieldname, cls, args, implicit), cls, ranged, implicit, close)
        return True

    def on_data(self, text, protected):
        if not self.tokens and self.in_document():
            self.put_text(protect(text, protected))
            return
        for kind, value in self.split_tokens(text, protected):
            if kind == "text":
                self.put_text(value)
            else:
                self.token(value)

    def put_text(self, text):
        if not text.strip(BLANKS):
            return
        self.pop_satisfied()
        while True:
            f = self.top()
            if f.kind == "unknown":
                return
            if f.kind in ("entity", "span") and not f.ended:
                if not f.greedy and not f.explicit:
                    text, rest = first_word(text)
                    if self.put_value(f, text):
                        self.pop_satisfied()
                        self.put_text(rest)
                        return
                    text += rest
                elif self.put_value(f, text):
                    return
            elif f.kind not in ("entity", "span"):
                if f.kind in ("entry", "open", "close", "short", "whitespace", "include", "import") or f.explicit and f.kind == "entry":
                    f.text.append(take(text))
                    return
                if f.kind in ("document", "ontology", "typesystem", ""):
                    self.say("error", "data", f"text can't stand in {f.kind or 'the file'}: {take(text)[:40]}")
                    return
            if f.ranged or f.explicit or len(self.stack) == 1:
                self.say("error", "data", f"no field takes {take(text)[:40]!r}")
                return
            self.pop()

    def put_value(self, f: Frame, text: str) -> bool:
        target = self.current_field(f)
        if target is None:
            return False
        reasons = []
        for path, last in self.schema.text_paths(target):
            try:
                taken = take(text, last.whitespace)
                value = self.schema.build(last.primitive, self.literal(last.primitive, taken))
            except (BuildError, LiteralError) as e:
                reasons.append(str(e))
                continue
            parent, fieldname = f.node, target.name
            f.content = True
            for c in path:
                cls = self.schema.classes[c]
                parent = self.entity(parent, fieldname, cls, {}, True)
                fieldname = self.schema.fields_of(c)[-1].name
                self.push(parent, cls, implicit=True)
                self.top().content = True
            if path:
                self.pop_text_holder()
            self.add_node("primitive", parent, last.name, content=write_json(value), class_name=last.primitive)
            return True
        if reasons:
            self.say("error", "value", "; ".join(reasons))
            return True
        return False

    def pop_text_holder(self):
        """A transparent element around one text is complete, unless a token closes it."""
        if not self.top().close:
            self.pop()

    def literal(self, kind: str, text: str):
        if kind == "string":
            return Identifier(text) if re.fullmatch(r"[A-Za-z]([A-Za-z0-9_-]*[A-Za-z0-9])?", text) else text
        return read(text)

    # ------------------------------------------------------------ annotations

    def on_anno_start(self, name, ident, args):
        key = next((c for c in self.schema.classes if self.schema.classes[c].annotation and c.replace("~", "") == name or self.schema.classes[c].annotation and c.split(":")[-1] == "~" + name), None)
        f = self.annotation_place()
        if key is None or f is None:
            self.say("error", "annotation", f"annotation {name} can't stand here")
            self.stack.append(Frame("unknown", name))
            return
        cls = self.schema.classes[key]
        anchor = self.add_node("anchor", f.node, self.current_field(f).name if self.current_field(f) else "", name=name)
        onto, _, short = cls.name.replace("~", "").partition(":")
        args = dict(args)
        label = str(args.pop("name", "") or "")
        try:
            built = self.schema.struct(self.schema.attributes_of(key), args)
        except BuildError as e:
            self.say("error", "attributes", str(e))
            built = {}
        anno = {"doc_id": self.doc_id, "anno_id": len(self.annotations), "ontology": onto, "class_name": short, "name": label, "attributes": write_json(built) if built else None, "start_node": anchor["node_id"], "end_node": None, "content_of": len(self.stack), "class": key}
        anchor["anno_id"] = anno["anno_id"]
        anchor["name"] = "start"
        self.annotations.append(anno)
        self.open_annotations.append(anno)
        if self.schema.fields_of(key):
            self.stack.append(Frame("span", name, anchor, cls))

    def annotation_place(self) -> Frame | None:
        """The frame that takes an anchor: implicit paths to text are opened, so that it lies beside text."""
        while self.top().kind == "entity" and (self.top().ended or (self.current_field(self.top()) and self.current_field(self.top()).primitive and not self.top().explicit)):
            self.pop()
        f = self.top()
        if f.kind == "span":
            self.pop()
            f = self.top()
        if f.kind not in ("entity", "span") or f.node is None:
            return None
        target = self.current_field(f)
        if target is None or target.primitive:
            return None
        for path, _ in self.schema.text_paths(target):
            if len(path) > 1:
                parent, fieldname = f.node, target.name
                for c in path[:-1]:
                    cls = self.schema.classes[c]
                    parent = self.entity(parent, fieldname, cls, {}, True)
                    fieldname = self.schema.fields_of(c)[-1].name
                    self.push(parent, cls, implicit=True)
            break
        return self.top()

    def on_anno_end(self, name, ident):
        """Closes the nearest open annotation of that class and name, if these are given."""
        for k in range(len(self.open_annotations) - 1, -1, -1):
            a = self.open_annotations[k]
            if (not name or a["class_name"] == name.split(":")[-1]) and (not ident or a["name"] == ident):
                f = self.annotation_place()
                if f is None:
                    break
                anchor = self.add_node("anchor", f.node, self.current_field(f).name if self.current_field(f) else "", name="end")
                anchor["anno_id"], a["end_node"] = a["anno_id"], anchor["node_id"]
                self.open_annotations.pop(k)
                return
        self.say("error", "annotation_end", f"no open annotation {name} {ident}".strip())

    # ------------------------------------------------------------ tokens

    def tokens_here(self) -> dict[str, tuple]:
        """What each token means now: (action, what).

        In order of meaning: what closes an open element, field or annotation (the innermost), then what opens a field
        or an element or stands for one, from the nearest element outwards until one that only its own end closes,
        then what opens an annotation.  Two elements at one depth make a token ambiguous: it is said once for a place.
        """
        out: dict[str, tuple] = {}
        for k in range(len(self.stack) - 1, -1, -1):
            if self.stack[k].close:
                out.setdefault(self.stack[k].close, ("close", k))
        for a in reversed(self.open_annotations):
            t = self.schema.classes[a["class"]].close
            if t:
                out.setdefault(t, ("anno_end", a["class"]))
        for k in range(len(self.stack) - 1, -1, -1):
            f = self.stack[k]
            if f.kind not in ("entity", "span"):
                break
            if not f.ended:
                if f.in_field is None and f.cls is not None:
                    for x in self.schema.fields_of(f.cls.name):
                        if x.open:
                            out.setdefault(x.open, ("field", (k, x)))
                target = self.current_field(f)
                if target is not None and not target.primitive:
                    depth: dict[str, tuple] = {}
                    for c, path in sorted(self.schema.paths(target).items(), key=lambda x: len(x[1])):
                        cls = self.schema.classes[c]
                        for action, t in (("open", cls.open), ("short", cls.short)):
                            if not t:
                                continue
                            if t in depth and depth[t][0] == len(path) and depth[t][1] != c:
                                self.say_once("ambiguous_token", f"{t} opens {depth[t][1]} and {c}")
                            elif t not in depth:
                                depth[t] = (len(path), c)
                                out.setdefault(t, (action, (k, c)))
            if f.ranged or f.explicit:
                break
        if self.top().kind in ("entity", "span"):
            for key, cls in self.schema.classes.items():
                if cls.annotation and cls.open:
                    out.setdefault(cls.open, ("anno_start", key))
        return out

    def say_once(self, code: str, message: str) -> None:
        if (code, message) not in self.said:
            self.said.add((code, message))
            self.say("error", code, message)

    def coming_closes(self) -> set[str]:
        """Tokens that would close elements which text opens here."""
        f = self.top()
        target = self.current_field(f) if f.kind in ("entity", "span") and not f.ended else None
        if target is None:
            return set()
        return {self.schema.classes[c].close for path, _ in self.schema.text_paths(target) for c in path} - {""}

    def split_tokens(self, text, protected) -> Iterator[tuple]:
        """Text cut at the tokens that mean something where they stand; longest first, protected signs are text.

        Which tokens those are is asked again only after one has acted, so the text is read once.
        """
        guard = set(protected)
        text = protect(text, guard)
        at = begin = 0
        trie, blank = self.trie_here()
        while at < len(text) and (trie.root or blank):
            if blank and text[at] == "\n":
                run = _BREAKS.match(text, at)
                width = 0
                for c in run.group()[run.group().rfind("\n") + 1 :]:
                    width = width // 8 * 8 + 8 if c == "\t" else width + 1
                found = [x for x in self.blank_tokens(run.group().count("\n"), width if run.end() < len(text) else None, at) if x[1] in blank]
                at = run.end()
                if found:
                    if text[begin : run.start()].strip(BLANKS):
                        yield ("text", text[begin : run.start()])
                        trie, blank = self.trie_here()
                    for x in found:
                        yield x
                    begin = at
                    trie, blank = self.trie_here()
                continue
            best = "" if at in guard else trie.longest(text, at)
            if not best:
                at += 1
                continue
            if begin < at:
                yield ("text", text[begin:at])
            begin = at = at + len(best)
            yield ("token", best)
            trie, blank = self.trie_here()
        if begin < len(text):
            yield ("text", text[begin:])

    def trie_here(self) -> tuple[Trie, set]:
        """The tokens of signs that mean something now, as a trie, and those of white space."""
        known = self.tokens_here().keys() | self.coming_closes()
        signs = frozenset(known - SPECIAL)
        if signs not in self.tries:
            self.tries[signs] = Trie(signs)
        return self.tries[signs], known & SPECIAL

    def blank_tokens(self, breaks: int, width, at) -> Iterator[tuple]:
        """Tokens of a run of line breaks: dedents, then newline or paragraph or section, then an indent."""
        indents = self.indents
        yield ("token", "newline")
        while width is not None and width < indents[-1]:
            indents.pop()
            yield ("token", "dedent")
        if breaks > 2:
            yield ("token", "section")
        if breaks > 1:
            yield ("token", "paragraph")
        if width is not None and width > indents[-1]:
            indents.append(width)
            yield ("token", "indent")

    def token(self, t):
        self.pop_satisfied()
        action, what = self.tokens_here().get(t, (None, None))
        if action == "close":
            while len(self.stack) > what:
                self.pop()
        elif action == "anno_end":
            self.on_anno_end(self.schema.classes[what].name.split(":")[-1].lstrip("~"), "")
        elif action == "anno_start":
            self.on_anno_start(what.replace("~", ""), "", {})
        elif action in ("field", "open", "short"):
            k, x = what
            while len(self.stack) - 1 > k:
                self.pop()
            f = self.top()
            if action == "field":
                f.content = f.content or x.tree
                self.stack.append(Frame("entity", x.name, f.node, f.cls, in_field=x, close=x.close, greedy=bool(x.close)))
                return
            cls = self.schema.classes[x]
            self.descend(f, self.current_field(f), x, {}, False, close=None if action == "open" else "")
            if action == "short":
                self.top().greedy = cls.greedy
                if not any(y.tree for y in self.schema.fields_of(x)):
                    self.pop()

    # ------------------------------------------------------------ schema statements

    def statement(self, name, args, ranged):
        args = {k: v for k, v in args.items()}
        f = self.top()
        g = Frame(name, name, ranged=ranged)
        label = str(args.get("name", "") or "")
        value_type = any(x.kind == "typesystem" for x in self.stack)
        if name in ("import", "include"):
            g.definition = (str(args.get("rel", args.get("#0", "")) or ""), str(args.get("src", "") or ""))
        elif name == "ontology":
            self.ontology = label
        elif name == "typesystem":
            self.system = label
        elif name == "struct" and value_type:
            t = TypeDef(f"{self.system}:{label}", "struct", parent=args.get("parent"), system=self.system)
            self.schema.types[t.name] = g.definition = t
        elif name == "enum":
            t = TypeDef(f"{self.system}:{label}", "enum", system=self.system)
            self.schema.types[t.name] = g.definition = t
        elif name == "entry":
            g.definition = f.definition
        elif name == "field" and value_type:
            self.attribute(f.definition.attrs, label, args)
            g.definition = f.definition
        elif name == "constant":
            key, kind, v = f"{self.system}:{label}", str(args.get("type", "string")), args.get("value")

            def put(key=key, kind=kind, v=v):
                try:
                    self.schema.constants[key] = (kind, self.schema.build(kind, v))
                except BuildError as e:
                    self.say("error", "constant", str(e))

            put()
        elif name in ("struct", "annotation"):
            # a struct and an annotation may share a name: annotations are kept apart by a mark
            c = ClassDef(f"{self.ontology}:{'~' if name == 'annotation' else ''}{label}", annotation=name == "annotation", transparent=args.get("transparent") is True, root=args.get("root") is True)
            try:
                card = args.get("cardinality", ANY)
                c.cardinality = card if isinstance(card, Cardinality) else Cardinality([(card, card)]) if isinstance(card, int) else cardinality(str(card))
            except LiteralError as e:
                self.say("error", "cardinality", str(e))
            self.schema.classes[c.name] = g.definition = c
            if args.get("isa"):
                self.later(lambda c=c, n=str(args["isa"]), o=self.ontology: self.wire_super(c, n, o))
        elif name == "attributes":
            g.definition = f.definition
        elif name == "attribute":
            self.attribute(f.definition.attributes, label, args)
        elif name in ("field", "primitive"):
            x = FieldDef(label, tree=args.get("subtree") is not True, optional=args.get("optional") is True, primitive=str(args.get("type")) if name == "primitive" else None, whitespace=str(args.get("whitespaceMode", "collapse")))
            g.definition = x
            if f.kind == "parentRef":
                own, target, onto = f.definition
                if not x.primitive:
                    x.children.append(own.name)
                self.later(lambda: self.inject(target, onto, x))
            else:
                f.definition.fields.append(x)
        elif name == "fieldRef":
            g.definition = FieldDef("")
            self.later(lambda d=f.definition, n=str(args.get("ref", "$default")), o=self.ontology: self.reference_field(d, n, o))
        elif name == "childRef":
            target, x, onto = str(args.get("ref", args.get("#0", ""))), f.definition, self.ontology
            k = len(x.children)
            x.children.append("?" + target)

            def put(x=x, target=target, onto=onto, k=k):
                key = self.schema.find(self.schema.classes, target, onto)
                if key is None:
                    self.say("error", "unresolved", f"no class {target}")
                    x.children.remove("?" + target)
                else:
                    x.children[k] = key

            self.later(put)
        elif name == "parentRef":
            g.definition = (f.definition, str(args.get("ref", args.get("#0", ""))), self.ontology)
        elif name == "syntax":
            g.definition = f.definition
        elif name in ("open", "close", "short", "whitespace"):
            g.definition = f.definition
            if name == "short" and args.get("greedy") is False:
                f.definition.greedy = False
        self.stack.append(g)

    def attribute(self, attrs, label, args):
        """An attribute; its default is built once all types are known."""
        kind, k = str(args.get("type", "string")), len(attrs)
        attrs.append((label, kind, args.get("default"), "default" in args))

        def build(default=args.get("default")):
            try:
                attrs[k] = (label, kind, self.schema.build(kind, default), True)
            except BuildError as e:
                self.say("error", "default", str(e))

        if "default" in args:
            if self.schema.find(self.schema.types, kind.rstrip("[]")) or kind in BUILTIN:
                build()
            else:
                self.later(build)

    def later(self, f):
        """Forward references are settled when the outermost schema statement ends."""
        self.pending.append(f)

    def settle(self):
        todo, self.pending = self.pending, []
        for f in todo:
            f()
        self.schema._paths.clear()

    def wire_super(self, c: ClassDef, name: str, onto: str):
        key = self.schema.find(self.schema.classes, name, onto)
        if key is None:
            self.say("error", "unresolved", f"no class {name}")
        elif c.name in self.schema.supers(key):
            self.say("error", "cyclic", f"{c.name} would inherit from itself")
        else:
            c.superclass = key

    def inject(self, target: str, onto: str, x: FieldDef):
        key = self.schema.find(self.schema.classes, target, onto)
        if key is None:
            self.say("error", "unresolved", f"no class {target}")
            return
        fields = self.schema.classes[key].fields
        if not any(f.name == x.name and f.tree == x.tree for f in fields):
            fields.append(x)

    def reference_field(self, definition, name: str, onto: str):
        if isinstance(definition, tuple):  # in a parentRef: the class becomes a child of the named field
            own, target, onto = definition
            key = self.schema.find(self.schema.classes, target, onto)
            fields = self.schema.fields_of(key) if key else []
            x = next((f for f in fields if f.name == name), fields[-1] if fields and name.endswith("$default") else None)
            if x is None:
                self.say("error", "unresolved", f"no field {name}")
            elif own.name not in x.children:
                x.children.append(own.name)
            return
        owner, _, field_name = name.rpartition(".")
        key = self.schema.find(self.schema.classes, owner, onto) if owner else None
        fields = self.schema.fields_of(key) if key else []
        x = next((f for f in fields if f.name == field_name), fields[-1] if fields and field_name == "$default" else None)
        if x is None:
            self.say("error", "unresolved", f"no field {name}")
        else:
            definition.fields.append(x)

    def end_statement(self, f: Frame):
        if f.kind in ("import", "include") and f.definition:
            rel, src = f.definition
            self.bring(f.kind, rel, src or " ".join(f.text).strip())
        elif f.kind == "entry" and f.text:
            f.definition.entries.append(" ".join(f.text).strip())
        elif f.kind in ("open", "close", "short") and f.definition is not None:
            setattr(f.definition, f.kind, "".join(f.text).strip())
        elif f.kind == "whitespace" and f.definition is not None:
            mode = "".join(f.text).strip()
            if mode in ("preserve", "trim", "collapse"):
                f.definition.whitespace = mode
                for x in getattr(f.definition, "fields", ()):
                    x.whitespace = mode
            else:
                self.say("error", "whitespace", f"{mode!r} is no white-space mode")
        elif f.kind == "unknown" and self.top().kind in ("open", "close", "short") and f.name in SPECIAL:
            self.top().text.append(f.name)
            self.diagnostics = [d for d in self.diagnostics if not (d[2] == "not_allowed" and d[3].startswith(f"\\{f.name} "))]
        elif f.kind in ("ontology", "typesystem") and not any(x.kind in ("ontology", "typesystem") for x in self.stack):
            self.settle()

    def bring(self, kind: str, rel: str, src: str):
        """Imports are parsed on their own into the same schema, once; includes continue in place."""
        if src in self.loading:
            self.say("error", "cyclic_import", f"{src} imports itself")
            return
        if kind == "import" and (rel, src) not in self.direct:
            self.direct.append((rel, src))
        if (rel, src) in self.imports:
            return
        self.imports.append((rel, src))
        source = self.load(rel, src) if self.load else None
        if source is None:
            self.say("error", "not_found", f"{src} is not there")
            return
        if kind == "include":
            here = self.at
            for e in source:
                self.at = e[-1]
                getattr(self, "on_" + e[0])(*e[1:-1])
            self.at = here
            return
        inner = Builder(self.doc_id, self.schema, self.load, (*self.loading, src))
        inner.imports = self.imports
        inner.run(source)
        self.diagnostics += inner.diagnostics
        self.schema._paths.clear()
        if inner.nodes:
            self.say("error", "import_kind", f"{src} is a document")
