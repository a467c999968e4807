"""Style sheets: a selector trie and its rules, and selectors matched against node tables.

A selector is steps (operator, class, pseudo selectors); the operator is " " for a descendant and ">" for a child.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_TOKEN = re.compile(r"/\*.*?\*/|\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\]|\\.)*'|::|[A-Za-z_*][\w-]*|[#.:,>{}()\[\]=;]|[\d.]+|\s+", re.S)


@dataclass
class Step:
    operator: str
    name: str
    pseudo: tuple = ()  # (kind, arguments)


@dataclass
class Style:
    selectors: list[tuple[tuple, dict]] = field(default_factory=list)  # (steps, rules)

    def merged(self) -> dict[tuple, dict]:
        """Rules by selector; a later rule wins."""
        out: dict[tuple, dict] = {}
        for steps, rules in self.selectors:
            key = tuple((s.operator, s.name, s.pseudo) for s in steps)
            out[key] = out.get(key, {}) | rules
        return out


def specificity(steps) -> tuple[int, int, int]:
    """(ids, other pseudo selectors, classes), compared in this order."""
    ids = sum(1 for s in steps for p in s.pseudo if p[0] == "has_id")
    other = sum(1 for s in steps for p in s.pseudo if p[0] != "has_id")
    return ids, other, sum(1 for s in steps if s.name != "*")


def parse_css(text: str) -> Style:
    """Style sheet with selector { key: value; } blocks; raises ValueError with the place of a syntax error."""
    tokens = [(m.group(), m.start()) for m in _TOKEN.finditer(text) if not m.group().startswith("/*")]
    style, at = Style(), 0

    def skip():
        nonlocal at
        while at < len(tokens) and tokens[at][0].isspace():
            at += 1

    def expect(t):
        nonlocal at
        skip()
        if at >= len(tokens) or tokens[at][0] != t:
            raise ValueError(f"expected {t} at {tokens[at][1] if at < len(tokens) else len(text)}")
        at += 1

    def word():
        nonlocal at
        skip()
        if at >= len(tokens):
            raise ValueError(f"text ends too early at {len(text)}")
        t = tokens[at][0]
        at += 1
        return t[1:-1] if t[0] in "\"'" else t

    def selector():
        nonlocal at
        steps, operator = [], " "
        while True:
            skip()
            if at >= len(tokens) or tokens[at][0] in ",{":
                return tuple(steps)
            if tokens[at][0] == ">":
                operator = ">"
                at += 1
                continue
            name = word() if tokens[at][0] not in "#[::" else "*"
            pseudo = []
            while at < len(tokens) and tokens[at][0] in ("#", "[", ":", "::"):
                t = tokens[at][0]
                at += 1
                if t == "#":
                    pseudo.append(("has_id", word()))
                elif t == "[":
                    key = word()
                    skip()
                    if tokens[at][0] == "=":
                        at += 1
                        pseudo.append(("has_value", key, word()))
                    else:
                        pseudo.append(("has_attribute", key))
                    expect("]")
                else:
                    key, args = word(), []
                    if at < len(tokens) and tokens[at][0] == "(":
                        at += 1
                        skip()
                        while tokens[at][0] != ")":
                            args.append(word())
                            skip()
                            if tokens[at][0] == ",":
                                at += 1
                                skip()
                        at += 1
                    pseudo.append((t + key, *args))
            steps.append(Step(operator, name, tuple(pseudo)))
            operator = " "

    while True:
        skip()
        if at >= len(tokens):
            return style
        heads = [selector()]
        while at < len(tokens) and tokens[at][0] == ",":
            at += 1
            heads.append(selector())
        expect("{")
        rules = {}
        while True:
            skip()
            if at < len(tokens) and tokens[at][0] == "}":
                at += 1
                break
            key = word()
            expect(":")
            rules[key] = word()
            expect(";")
        style.selectors += [(h, rules) for h in heads]


def _fits(step: Step, name: Column, attributes: Column, ident: Column) -> Column:
    out = F.lit(True) if step.name == "*" else name == step.name
    for p in step.pseudo:
        if p[0] == "has_id":
            out &= F.coalesce(ident == p[1], F.lit(False))
        elif p[0] == "has_attribute":
            out &= F.array_contains(F.map_keys(attributes), p[1])
        elif p[0] == "has_value":
            out &= F.coalesce(F.try_element_at(attributes, F.lit(p[1])) == p[2], F.lit(False))
        else:
            raise ValueError(f"{p[0]} can't be evaluated")
    return out


def match_selector(nodes: DataFrame, steps: tuple, doc: str = "page_id", name: str = "tag") -> DataFrame:
    """Nodes (doc, node_id, parent_id, pre, last, name, attributes) that a selector picks.

    pre numbers the nodes in document order, last is the largest number below a node.  A child step is an equi-join on
    the parent.  A descendant step is one window over the document: a node lies below one of those found before if the
    furthest ``last`` among the found ones that come earlier reaches it.  No pair of nodes is made.
    """
    rows = lambda step: nodes.where(_fits(step, F.col(name), F.col("attributes"), F.try_element_at("attributes", F.lit("id"))))
    found = rows(steps[0])
    for step in steps[1:]:
        nxt = rows(step)
        if step.operator == ">":
            found = nxt.join(found.select(doc, F.col("node_id").alias("parent_id")), [doc, "parent_id"], "left_semi")
        else:
            marks = found.select(doc, "pre", F.col("last").alias("__reach"))
            both = nxt.withColumn("__reach", F.lit(None).cast("int")).unionByName(marks, allowMissingColumns=True)
            # a node that is both stands before its own mark
            before = Window.partitionBy(doc).orderBy("pre", F.col("__reach").isNotNull()).rowsBetween(Window.unboundedPreceding, -1)
            found = both.withColumn("__most", F.max("__reach").over(before)).where("__reach is null and __most >= pre").drop("__reach", "__most")
    return found
