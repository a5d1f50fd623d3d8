"""Models and state charts in XML: a token at the begin and, for containers, at the end of each element."""

from __future__ import annotations

from collections import Counter
from math import sqrt
from xml.etree import ElementTree
from xml.parsers import expat

from simloom.tokenize.base import ParseError, Tok

#: What elements of a metamodel are, by their type or tag.
METAMODEL = {"EPackage": "PACKAGE", "EClass": "CLASS", "EEnum": "ENUM", "EDataType": "DATATYPE", "EAttribute": "ATTRIBUTE", "EReference": "REFERENCE", "eOperations": "OPERATION", "eParameters": "PARAMETER", "eLiterals": "ENUM_LITERAL", "eAnnotations": "ANNOTATION", "eTypeParameters": "TYPE_PARAMETER", "eSuperTypes": "SUPER_TYPE", "eExceptions": "THROWS", "details": "DETAIL"}
#: What elements of a state chart are.
STATECHART = {"scxml": "STATECHART", "state": "STATE", "parallel": "PARALLEL_STATE", "initial": "INITIAL", "final": "FINAL_STATE", "history": "HISTORY", "transition": "TRANSITION", "onentry": "ON_ENTRY", "onexit": "ON_EXIT", "if": "IF", "elseif": "ELSE_IF", "else": "ELSE", "foreach": "FOREACH", "assign": "ASSIGNMENT", "script": "SCRIPT", "send": "SEND", "raise": "RAISE", "cancel": "CANCEL", "log": "LOG", "datamodel": "DATAMODEL", "data": "DATA", "param": "PARAM", "invoke": "INVOKE"}


#: Holds an element's line and column; no attribute of a file can have this name.
PLACE = "\0place"


def _parsed(text: str) -> ElementTree.Element:
    """The tree, each element with its place."""
    build = ElementTree.TreeBuilder()
    parser = expat.ParserCreate(namespace_separator="}")
    named = lambda n: "{" + n if "}" in n else n

    def start(tag: str, attrs: dict) -> None:
        x = build.start(named(tag), {named(k): v for k, v in attrs.items()})
        x.set(PLACE, (parser.CurrentLineNumber, parser.CurrentColumnNumber + 1))

    parser.StartElementHandler = start
    parser.EndElementHandler = lambda tag: build.end(named(tag))
    try:
        parser.Parse(text, True)
    except (expat.ExpatError, ValueError) as e:
        raise ParseError(str(e)) from e
    return build.close()


def _kind(x: ElementTree.Element, table: dict[str, str] | None) -> str | None:
    tag = x.tag.rpartition("}")[2]
    declared = next((v.rpartition(":")[2] for k, v in x.attrib.items() if k.endswith("}type")), tag)
    return declared if table is None else table.get(declared, table.get(tag))


def _emit(x: ElementTree.Element, table, order, out: list[Tok]) -> None:
    kind = _kind(x, table)
    line, column = x.get(PLACE)
    if kind:
        out.append(Tok(kind, line, column, 1))
    if table is METAMODEL and x.get("eSuperTypes"):
        out.extend(Tok("SUPER_TYPE", line, column, 1) for _ in x.get("eSuperTypes").split())
    children = order(list(x), table) if order else list(x)
    for child in children:
        _emit(child, table, order, out)
    if kind and children:
        out.append(Tok(kind + "_END", line, column, 1))


def _histogram(x: ElementTree.Element, table) -> dict[str, float]:
    counts = Counter(k for e in x.iter() if (k := _kind(e, table)))
    norm = sqrt(sum(v * v for v in counts.values())) or 1.0
    return {k: v / norm for k, v in counts.items()}


def nearest_neighbor(children: list[ElementTree.Element], table) -> list[ElementTree.Element]:
    """An order that does not depend on the file's: from the largest, always the next by its content's histogram."""
    rest = [(_histogram(c, table), c) for c in children]
    rest.sort(key=lambda p: (-sum(1 for _ in p[1].iter()), sorted(p[0].items())))
    out = [rest.pop(0)] if rest else []
    while rest:
        last = out[-1][0]
        far = lambda p, last=last: sum((last.get(k, 0) - p[0].get(k, 0)) ** 2 for k in {*last, *p[0]})
        out.append(rest.pop(min(range(len(rest)), key=lambda k: far(rest[k]))))
    return [c for _, c in out]


def by_type(children, table):
    """Children by the place of their own kind in the table."""
    names = list(table)
    return sorted(children, key=lambda c: names.index(t) if (t := c.tag.rpartition("}")[2]) in names else len(names))


def by_content(children, table):
    """Children by the kinds of all that they hold."""
    return sorted(children, key=lambda c: [k for e in c.iter() if (k := _kind(e, table))])


def tokenize(text: str, table: dict[str, str] | None, order=None) -> list[Tok]:
    out: list[Tok] = []
    try:
        _emit(_parsed(text), table, order, out)
    except RecursionError as e:
        raise ParseError("nested too deep") from e
    return out
