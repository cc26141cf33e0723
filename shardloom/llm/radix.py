"""A Patricia trie (compressed radix trie) of byte strings that spills by subtree."""

from __future__ import annotations

import pickle
import tempfile
from collections.abc import Callable, Iterator
from typing import Any, BinaryIO

#: Bytes of labels, and what a node takes besides, that a trie holds before it spills.
MAX_BYTES = 96 << 20
_NODE_BYTES = 250
_NOTHING = object()


class _Node:
    __slots__ = ("children", "label", "spilled", "value")

    def __init__(self, label: bytes, value: Any = _NOTHING) -> None:
        self.label = label
        self.value = value
        self.children: dict[int, _Node] | None = None
        self.spilled: BinaryIO | None = None


def _common(a: bytes, b: bytes) -> int:
    """Length of the longest prefix that both have."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid - 1
    return low


class RadixTrie:
    """Maps byte strings to values. ``merge(old, new)`` makes one value of two for the same string.

    Beyond ``max_bytes``, the largest subtree goes to an unnamed file that only this process can see
    and that ends with it; what later falls in it follows. :meth:`items` reads such a file into a trie
    of its own, and so on. A lost executor's task begins anew, with no such file.
    """

    def __init__(self, merge: Callable[[Any, Any], Any], max_bytes: int = MAX_BYTES) -> None:
        self.merge, self.max_bytes = merge, max_bytes
        self.root = _Node(b"")
        self.bytes = 0
        self.spills = 0

    def insert(self, key: bytes, value: Any) -> None:
        node, at = self.root, 0
        while True:
            if node.spilled is not None:
                pickle.dump((key[at:], value), node.spilled, pickle.HIGHEST_PROTOCOL)
                return
            if at == len(key):
                node.value = value if node.value is _NOTHING else self.merge(node.value, value)
                return
            if node.children is None:
                node.children = {}
            child = node.children.get(key[at])
            if child is None:
                node.children[key[at]] = _Node(key[at:], value)
                self.bytes += len(key) - at + _NODE_BYTES
                break
            if key.startswith(child.label, at):
                node, at = child, at + len(child.label)
                continue
            n = _common(child.label, key[at : at + len(child.label)])
            upper = _Node(child.label[:n])
            upper.children = {child.label[n]: child}
            node.children[key[at]] = upper
            child.label = child.label[n:]
            self.bytes += _NODE_BYTES
            node, at = upper, at + n
        if self.bytes > self.max_bytes:
            self._spill()

    def _weight(self, top: _Node) -> int:
        total, stack = 0, [top]
        while stack:
            node = stack.pop()
            total += len(node.label) + _NODE_BYTES
            stack.extend((node.children or {}).values())
        return total

    def _spill(self) -> None:
        node = self.root
        while node.children and len(held := [x for x in node.children.values() if x.spilled is None]) == 1 and node.value is _NOTHING and len(node.children) == 1:
            node = held[0]
        held = [x for x in (node.children or {}).values() if x.spilled is None]
        if not held:
            return
        weight, chosen = max(((self._weight(x), x) for x in held), key=lambda x: x[0])
        out = tempfile.TemporaryFile()
        for key, value in self._walk(chosen, b""):
            pickle.dump((key[len(chosen.label) :], value), out, pickle.HIGHEST_PROTOCOL)
        chosen.children, chosen.value, chosen.spilled = None, _NOTHING, out
        self.bytes -= weight - len(chosen.label) - _NODE_BYTES
        self.spills += 1

    def _walk(self, top: _Node, before: bytes) -> Iterator[tuple[bytes, Any]]:
        stack = [(top, before)]
        while stack:
            node, before = stack.pop()
            here = before + node.label
            if node.value is not _NOTHING:
                yield here, node.value
            if node.spilled is not None:
                file, node.spilled = node.spilled, None
                below = RadixTrie(self.merge, self.max_bytes)
                with file:
                    file.seek(0)
                    try:
                        while True:
                            below.insert(*pickle.load(file))
                    except EOFError:
                        pass
                for key, value in below.items():
                    yield here + key, value
            for first in sorted(node.children or {}, reverse=True):
                stack.append((node.children[first], here))

    def items(self) -> Iterator[tuple[bytes, Any]]:
        """All strings in order, with their values. Spilled parts are read once, so call it once."""
        return self._walk(self.root, b"")
