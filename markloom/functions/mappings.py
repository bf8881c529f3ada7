"""Trees of other parsers, given as nested mappings, to the nodes that all operators read."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from .tree import DOCUMENT, ELEMENT, REMARK, TEXT, TYPE, Node

#: The namespaces by address; any other counts as html.
_NAMESPACES = {"http://www.w3.org/2000/svg": "svg", "http://www.w3.org/1998/Math/MathML": "mathml"}


def _children(node: Mapping) -> list:
    """What is below a node; a template holds its content apart."""
    content = node.get("content")
    if content and node.get("tagName") == "template" and node.get("namespaceURI") not in _NAMESPACES:
        return content.get("childNodes") or []
    return node.get("childNodes") or []


def _node(given: Mapping) -> Node:
    kind = given["nodeName"]
    if kind == "#text":
        return Node(TEXT, value=given.get("value") or "")
    if kind == "#comment":
        return Node(REMARK, value=given.get("data") or "")
    if kind == "#documentType":
        made = Node(TYPE, given.get("name") or "")
        made.public, made.system = given.get("publicId") or "", given.get("systemId") or ""
        return made
    attrs = [[f"{a['prefix']} {a['name']}" if a.get("prefix") else a["name"], a["value"]] for a in given.get("attrs") or ()]
    return Node(ELEMENT, given.get("tagName") or kind, _NAMESPACES.get(given.get("namespaceURI"), "html"), attrs)


def document_of(given: Mapping) -> Node:
    """The document node of a parsed mapping with ``nodeName``, ``childNodes``, ``attrs`` and so on. Loops: nesting may be deep."""
    root = Node(DOCUMENT)
    work = [(root, iter(_children(given)))]
    while work:
        parent, rest = work[-1]
        below = next(rest, None)
        if below is None:
            work.pop()
            continue
        made = _node(below)
        made.parent = parent
        parent.children.append(made)
        if made.kind == ELEMENT:
            work.append((made, iter(_children(below))))
    return root


def adapted(parse: Callable[[str], Mapping]) -> Callable[[str], Node]:
    """A parser for the registry from one that gives nested mappings."""
    return lambda html: document_of(parse(html))
