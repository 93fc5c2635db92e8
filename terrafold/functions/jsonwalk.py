"""Strict JSON reading and the walk that numbers the nodes of a nested record."""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any


def _no_constant(name: str) -> None:
    raise ValueError(f"{name} is not JSON")


def load_json(text: str | None) -> tuple[bool, Any]:
    """(valid, value). NaN and Infinity, empty text and nesting beyond the parser's depth count as invalid."""
    if text is None:
        return False, None
    try:
        return True, json.loads(text, parse_constant=_no_constant)
    except (ValueError, RecursionError):
        return False, None


def features_of(doc: Any) -> Iterator[tuple[int, dict]]:
    """(ordinal, Feature) of a Feature or FeatureCollection; entries that are no objects keep their ordinal but are left out."""
    if not isinstance(doc, dict):
        return
    if doc.get("type") == "FeatureCollection":
        members = doc.get("features")
        for i, f in enumerate(members if isinstance(members, list) else []):
            if isinstance(f, dict):
                yield i, f
    elif doc.get("type") == "Feature":
        yield 0, doc


_KINDS = {type(None): "null", bool: "boolean", int: "number", float: "number", str: "string", list: "array", dict: "object"}
_NUMBERS = frozenset((int, float))


def is_vector(v: Any) -> bool:
    """A non-empty array of numbers, which the walk treats as one leaf."""
    return type(v) is list and bool(v) and _NUMBERS.issuperset(map(type, v))


def number_nodes(root: Any, vectors: bool = True) -> list[list]:
    """[pre, post, depth, path, key, idx, type, child_type, value] of every node, in pre-order, by a depth-first walk.

    A node a is an ancestor of b exactly if a.pre < b.pre and a.post > b.post. path joins member names by '.',
    with '[]' for an array entry; key is the member's name and idx the place in its array. A vector is one leaf
    of type 'vector', unless ``vectors`` is False; child_type is the type of an array's first entry. The walk keeps its own stack, so depth is no limit.
    """
    nodes: list[list] = []
    post = 0
    # containers on the way down: (node, members left, what their paths begin with, whether they have names)
    stack: list[tuple] = []
    v, depth, path, key, idx = root, 0, "", None, None
    while True:
        kind, first = _KINDS[type(v)], None
        if kind == "array" and v:
            if vectors and _NUMBERS.issuperset(map(type, v)):
                kind = "vector"
            else:
                first = _KINDS[type(v[0])]
                if vectors and first == "array" and is_vector(v[0]):
                    first = "vector"
        node = [len(nodes), 0, depth, path, key, idx, kind, first, v]
        nodes.append(node)
        if kind == "object" and v:
            stack.append((node, iter(v.items()), path + "." if path else "", True))
        elif kind == "array" and v:
            stack.append((node, iter(enumerate(v)), path + "[]", False))
        else:
            node[1] = post
            post += 1
        while stack:
            node, members, base, named = stack[-1]
            member = next(members, None)
            if member is not None:
                break
            node[1] = post
            post += 1
            stack.pop()
        else:
            return nodes
        depth = len(stack)
        if named:
            key, v = member
            path, idx = base + key, None
        else:
            idx, v = member
            path, key = base, None
