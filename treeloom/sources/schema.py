"""Schemas as the parser and the checks need them: value types, classes, fields, tokens.

A schema is assembled on the driver from parsed modules and is small; ``tables`` turns it into DataFrames.
"""

from __future__ import annotations

from collections import deque
from dataclasses import dataclass, field

from treeloom.functions.literals import ANY, Cardinality, Identifier


class BuildError(ValueError):
    """A value that a type does not accept."""


@dataclass
class TypeDef:
    name: str
    kind: str  # builtin, struct, enum
    attrs: list[tuple[str, str, object, bool]] = field(default_factory=list)  # name, type, default, optional
    parent: str | None = None
    entries: list[str] = field(default_factory=list)
    system: str = ""


@dataclass
class FieldDef:
    name: str
    tree: bool = True
    primitive: str | None = None
    optional: bool = False
    whitespace: str = "collapse"
    children: list[str] = field(default_factory=list)
    open: str = ""
    close: str = ""
    greedy: bool = True


@dataclass
class ClassDef:
    name: str  # ontology:class
    cardinality: Cardinality = field(default_factory=lambda: ANY)
    superclass: str | None = None
    transparent: bool = False
    root: bool = False
    annotation: bool = False
    attributes: list[tuple[str, str, object, bool]] = field(default_factory=list)
    fields: list[FieldDef] = field(default_factory=list)
    open: str = ""
    close: str = ""
    short: str = ""
    greedy: bool = True


def local_table(spark, rows: list[tuple], ddl: str):
    """A schema-sized table as a local relation: the planner knows its size and joins it without a shuffle."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    kinds = StructType.fromDDL(ddl)
    arrow = to_arrow_schema(kinds)
    as_dicts = lambda v, t: [dict(zip((f.name for f in t.value_type), x)) for x in v] if pa.types.is_list(t) and pa.types.is_struct(t.value_type) and v is not None else v
    columns = zip(*rows) if rows else [()] * len(arrow)
    arrays = [pa.array([as_dicts(v, f.type) for v in c], f.type) for c, f in zip(columns, arrow)]
    return spark.createDataFrame(pa.Table.from_arrays(arrays, schema=arrow), kinds)


BUILTIN = {"string": "", "int": 0, "double": 0.0, "bool": False, "cardinality": ANY}


class Schema:
    def __init__(self):
        self.types: dict[str, TypeDef] = {}
        self.constants: dict[str, tuple[str, object]] = {}
        self.classes: dict[str, ClassDef] = {}
        self._paths: dict = {}

    # ------------------------------------------------------------ names

    def find(self, table: dict, name: str, scope: str = "") -> str | None:
        """Key of a name: within the scope first, then qualified, then by its last part anywhere."""
        name = name.replace(".", ":")
        for key in (f"{scope}:{name}", name):
            if key in table:
                return key
        ends = [k for k in table if k.split(":")[-1] == name.split(":")[-1] and (":" not in name or k == name)]
        return ends[0] if ends else None

    def supers(self, name: str) -> list[str]:
        out = []
        while name and name not in out and name in self.classes:
            out.append(name)
            name = self.classes[name].superclass
        return out

    def isa(self, sub: str, sup: str) -> bool:
        return sup in self.supers(sub)

    def subclasses(self, name: str) -> list[str]:
        return [c for c in self.classes if name in self.supers(c)]

    # ------------------------------------------------------------ fields

    def fields_of(self, name: str) -> list[FieldDef]:
        """Effective fields: inherited first, hidden by name, one TREE field last."""
        seen, tree, levels = set(), None, []
        for c in self.supers(name):
            own = []
            for f in self.classes[c].fields:
                if f.name in seen:
                    continue
                seen.add(f.name)
                if not f.tree:
                    own.append(f)
                elif tree is None:
                    tree = f
            levels.append(own)
        return [f for own in reversed(levels) for f in own] + ([tree] if tree else [])

    def attributes_of(self, name: str) -> list[tuple]:
        out: list[tuple] = []
        for c in reversed(self.supers(name)):
            out = [a for a in out if a[0] not in {x[0] for x in self.classes[c].attributes}] + self.classes[c].attributes
        return out

    def allowed(self, f: FieldDef) -> list[str]:
        return list(dict.fromkeys(s for c in f.children for s in self.subclasses(c)))

    def paths(self, f: FieldDef) -> dict[str, list[str]]:
        """Shortest row of transparent classes from a field to every class it reaches, by breadth-first search."""
        key = id(f)
        if key not in self._paths:
            out, todo = {}, deque()
            for c in self.allowed(f):
                out.setdefault(c, [])
                todo.append((c, []))
            while todo:
                c, path = todo.popleft()
                if not self.classes[c].transparent:
                    continue
                inner = self.fields_of(c)
                if inner and inner[-1].tree and not inner[-1].primitive:
                    for x in self.allowed(inner[-1]):
                        if x not in out:
                            out[x] = [*path, c]
                            todo.append((x, out[x]))
            self._paths[key] = out
        return self._paths[key]

    def text_paths(self, f: FieldDef) -> list[tuple[list[str], FieldDef]]:
        """Rows of transparent classes to default fields that take text, nearest first."""
        if f.primitive:
            return [([], f)]
        out = []
        for c, path in self.paths(f).items():
            if self.classes[c].transparent:
                inner = self.fields_of(c)
                if inner and inner[-1].tree and inner[-1].primitive:
                    out.append(([*path, c], inner[-1]))
        return sorted(out, key=lambda x: len(x[0]))

    # ------------------------------------------------------------ values

    def zero(self, kind: str):
        if kind.endswith("[]"):
            return []
        if kind.startswith("@"):
            return None
        if kind in BUILTIN:
            return BUILTIN[kind]
        t = self.types.get(self.find(self.types, kind) or "")
        if t is None:
            return None
        if t.kind == "enum":
            return t.entries[0] if t.entries else None
        return {n: d if o else self.zero(k) for n, k, d, o in self.struct_attrs(t)}

    def struct_attrs(self, t: TypeDef) -> list[tuple]:
        out: list[tuple] = []
        chain, seen = t, set()
        while chain and chain.name not in seen:
            seen.add(chain.name)
            out = chain.attrs + out
            chain = self.types.get(self.find(self.types, chain.parent, chain.system) or "") if chain.parent else None
        return out

    def build(self, kind: str, v):
        """v as a value of the type; raises BuildError."""
        if isinstance(v, Identifier):
            key = self.find(self.constants, v)
            if key and self._fits(self.constants[key][0], kind):
                return self.constants[key][1]
        if kind.endswith("[]"):
            if isinstance(v, list) and not isinstance(v, Cardinality):
                return [self.build(kind[:-2], x) for x in v]
            raise BuildError(f"{v!r} is no array")
        if kind.startswith("@"):
            if v is None or isinstance(v, str):
                return v
            raise BuildError(f"{v!r} is no reference")
        if kind == "string":
            if isinstance(v, str):
                return str(v)
            if v is None or isinstance(v, (bool, int, float)):
                return "null" if v is None else str(v).lower() if isinstance(v, bool) else str(v)
        elif kind == "int":
            if isinstance(v, int) and not isinstance(v, bool):
                return v
        elif kind == "double":
            if isinstance(v, (int, float)) and not isinstance(v, bool):
                return float(v)
        elif kind == "bool":
            if isinstance(v, bool):
                return v
        elif kind == "cardinality":
            if isinstance(v, Cardinality):
                return v
            if isinstance(v, int) and not isinstance(v, bool) and v >= 0:
                return Cardinality([(v, v)])
        else:
            key = self.find(self.types, kind)
            if key is None:
                raise BuildError(f"unknown type {kind}")
            return self._declared(self.types[key], v)
        raise BuildError(f"{v!r} is no {kind}")

    def _fits(self, have: str, want: str) -> bool:
        a, b = self.find(self.types, have) or have, self.find(self.types, want) or want
        seen = set()
        while a and a not in seen:
            if a == b:
                return True
            seen.add(a)
            t = self.types.get(a)
            a = (self.find(self.types, t.parent, t.system) or "") if t and t.parent else ""
        return False

    def _declared(self, t: TypeDef, v):
        if t.kind == "enum":
            if isinstance(v, Identifier) and v in t.entries:
                return str(v)
            if isinstance(v, int) and not isinstance(v, bool) and 0 <= v < len(t.entries):
                return t.entries[v]
            raise BuildError(f"{v!r} is no {t.name}")
        attrs = self.struct_attrs(t)
        return self.struct(attrs, v)

    def struct(self, attrs: list[tuple], v) -> dict:
        names = [a[0] for a in attrs]
        if isinstance(v, list) and not isinstance(v, Cardinality):
            if len(v) != len(attrs):
                raise BuildError(f"expected {len(attrs)} values, got {len(v)}")
            v = dict(zip(names, v))
        if not isinstance(v, dict):
            raise BuildError(f"{v!r} is no struct")
        given = {}
        for k, x in v.items():
            k = names[int(k[1:])] if k.startswith("#") and k[1:].isdigit() and int(k[1:]) < len(names) else k
            if k not in names:
                raise BuildError(f"unknown attribute {k}")
            given[k] = x
        out = {}
        for n, kind, default, optional in attrs:
            if n in given:
                out[n] = self.build(kind, given[n])
            elif optional:
                out[n] = default
            else:
                raise BuildError(f"missing attribute {n}")
        return out

    # ------------------------------------------------------------ tables

    def tables(self, spark) -> dict:
        """classes, fields, children, tokens, types, type_fields and entries as DataFrames."""
        classes, fields, children, tokens = [], [], [], []
        for name, c in self.classes.items():
            classes.append((name, c.superclass, [(a, b) for a, b in c.cardinality], c.transparent, c.root, c.annotation))
            tokens += [(name, "", kind, t) for kind, t in (("open", c.open), ("close", c.close), ("short", c.short)) if t]
            for k, f in enumerate(self.fields_of(name)):
                fields.append((name, f.name, "TREE" if f.tree else "SUBTREE", f.primitive is not None, f.primitive, f.optional, k, f in c.fields))
                children += [(name, f.name, x) for x in self.allowed(f)]
                tokens += [(name, f.name, kind, t) for kind, t in (("open", f.open), ("close", f.close)) if t and f in c.fields]
        types = [(name, x.kind, x.parent) for name, x in self.types.items()]
        return {
            "classes": local_table(spark, classes, "class string, superclass string, cardinality array<struct<start:bigint,end:bigint>>, transparent boolean, root boolean, annotation boolean"),
            "fields": local_table(spark, fields, "owner string, field string, field_type string, primitive boolean, type string, optional boolean, seq int, declared boolean"),
            "children": local_table(spark, children, "owner string, field string, child string"),
            "tokens": local_table(spark, tokens, "class string, field string, kind string, token string"),
            "types": local_table(spark, types, "type string, kind string, parent string"),
            "type_fields": local_table(spark, [(name, a[0], k) for name, x in self.types.items() for k, a in enumerate(x.attrs)], "type string, field string, seq int"),
            "entries": local_table(spark, [(name, e, k) for name, x in self.types.items() for k, e in enumerate(x.entries)], "type string, entry string, ordinal int"),
        }
