"""Trees to strings, texts and event rows. Loops, not recursion: documents may nest deeply."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from .facts import declarations, url_facts
from .fixed import NO_END_TAG, RAW_TEXT, URL_ATTRIBUTES
from .policy import BIT, Policy, attribute_verdict
from .tree import ELEMENT, REMARK, TEXT, TYPE, Node


def escape_text(s: str) -> str:
    if "&" in s:
        s = s.replace("&", "&amp;")
    return s.replace("<", "&lt;").replace(">", "&gt;").replace("\xa0", "&nbsp;")


def escape_attribute(s: str) -> str:
    if "&" in s:
        s = s.replace("&", "&amp;")
    return s.replace('"', "&quot;").replace("\xa0", "&nbsp;")


def _open_tag(name: str, attrs: list) -> str:
    if not attrs:
        return f"<{name}>"
    return f"<{name}" + "".join(f' {k.replace(" ", ":", 1)}="{escape_attribute(v)}"' for k, v in attrs) + ">"


def sanitized(root: Node, policy: Policy, removed: list | None = None) -> list[str]:
    """Fragments of the sanitized document; ``removed`` collects (kind, name, reason) in order."""
    out: list[str] = []
    kept, cache = policy.kept_tags(), {}
    drops = policy.drops()
    work: list = [(iter(root.children), False, "")]
    while work:
        children, raw, after = work[-1]
        for node in children:
            if node.kind == TEXT:
                out.append(node.value if raw else escape_text(node.value))
            elif node.kind == ELEMENT:
                name = node.name
                if name in kept:
                    attrs = node.attrs
                    if attrs:
                        allowed = cache.get(name)
                        if allowed is None:
                            allowed = cache[name] = policy.allowed(name)
                        stay = []
                        for k, v in attrs:
                            v, gone = attribute_verdict(policy, allowed, k, v)
                            if v is not None:
                                stay.append((k, v))
                            if gone is not None and removed is not None:
                                removed.append(gone)
                        attrs = stay
                    out.append(_open_tag(name, attrs))
                    if name not in NO_END_TAG:
                        work.append((iter(node.children), name in RAW_TEXT, f"</{name}>"))
                        break
                elif name in drops:
                    if removed is not None:
                        removed.append(("tag", name, "unsafe-element"))
                else:
                    if removed is not None and name not in ("html", "head", "body"):
                        removed.append(("tag", name, "not-allowed"))
                    work.append((iter(node.children), False, ""))
                    break
        else:
            work.pop()
            if after:
                out.append(after)
    return out


def chunked(parts: list[str], size: int) -> list[str]:
    """Fragments gathered into chunks of at least ``size`` UTF-16 units; the last may be shorter, none is empty."""
    out, held, units = [], [], 0
    for s in parts:
        held.append(s)
        units += len(s) if s.isascii() else len(s.encode("utf-16-le", "surrogatepass")) // 2
        if units >= size:
            out.append("".join(held))
            held, units = [], 0
    if held:
        out.append("".join(held))
    return out


def _walk(root: Node, enter: Callable[[Node], bool]) -> None:
    work = [iter(root.children)]
    while work:
        for node in work[-1]:
            if enter(node) and node.kind == ELEMENT:
                work.append(iter(node.children))
                break
        else:
            work.pop()


def plain_text(root: Node) -> str:
    """Text outside raw-text elements, unescaped."""
    out: list[str] = []

    def enter(node: Node) -> bool:
        if node.kind == TEXT:
            out.append(node.value)
        return node.name not in RAW_TEXT

    _walk(root, enter)
    return "".join(out)


def elements(root: Node) -> Iterator[Node]:
    work = [iter(root.children)]
    while work:
        for node in work[-1]:
            if node.kind == ELEMENT:
                yield node
                work.append(iter(node.children))
                break
        else:
            work.pop()


def serialized(root: Node) -> str:
    """The whole document as HTML, comments and doctype kept."""
    out: list[str] = []
    work: list = [(iter(root.children), False, "")]
    while work:
        children, raw, after = work[-1]
        for node in children:
            if node.kind == TEXT:
                out.append(node.value if raw else escape_text(node.value))
            elif node.kind == ELEMENT:
                out.append(_open_tag(node.name, node.attrs))
                if node.name not in NO_END_TAG:
                    work.append((iter(node.children), node.name in RAW_TEXT, f"</{node.name}>"))
                    break
            elif node.kind == REMARK:
                out.append(f"<!--{node.value}-->")
            elif node.kind == TYPE:
                out.append(f"<!DOCTYPE {node.name}>")
        else:
            work.pop()
            out.append(after)
    return "".join(out)


def attribute_row(k: str, v: str) -> dict:
    scheme, image = url_facts(v) if k in URL_ATTRIBUTES else (None, False)
    styles = [{"prop": p, "val": x} for p, x in declarations(v)] if k == "style" else None
    return {"name": k, "value": v, "url_scheme": scheme, "url_data_image": image, "style_decls": styles}


def events(root: Node) -> list[dict]:
    """Document order with opens and closes; ``exit_seq`` of an open is its close's ``seq``."""
    out: list[dict] = []
    ids = 0
    work: list = [(iter(root.children), None, 0, -1, "")]
    while work:
        children, row, mask, parent, parent_name = work[-1]
        depth = len(work) - 1
        for node in children:
            made = {
                "seq": len(out), "kind": node.kind if node.kind != ELEMENT else "open", "node_id": ids, "parent_id": parent, "depth": depth,
                "exit_seq": len(out), "name": node.name or None, "ns": node.ns if node.kind == ELEMENT else None, "parent_name": parent_name or None,
                "value": node.value if node.kind in (TEXT, REMARK) else None, "public_id": node.public or None, "system_id": node.system or None,
                "anc_mask": mask, "attrs": [attribute_row(k, v) for k, v in node.attrs] if node.kind == ELEMENT else None,
            }
            out.append(made)
            ids += 1
            if node.kind == ELEMENT:
                work.append((iter(node.children), made, mask | BIT.get(node.name, 0), made["node_id"], node.name))
                break
        else:
            work.pop()
            if row is not None:
                row["exit_seq"] = len(out)
                out.append(row | {"seq": len(out), "kind": "close", "exit_seq": len(out), "attrs": None})
    return out
