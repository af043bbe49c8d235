"""Adaptive radix tree over byte keys: inner nodes grow from 4 over 16 and 48 to 256 children, and bytes
without a branch are kept in the node below them."""

from __future__ import annotations

from collections.abc import Iterator


class Node4:
    """Up to four children in byte order, found by a search through their bytes."""

    __slots__ = ("prefix", "value", "bytes", "children")
    room = 4

    def __init__(self, prefix: bytes, value=None):
        self.prefix, self.value = prefix, value
        self.bytes, self.children = bytearray(), []

    def find(self, byte: int):
        at = self.bytes.find(byte)
        return None if at < 0 else self.children[at]

    def replace(self, byte: int, child) -> None:
        self.children[self.bytes.find(byte)] = child

    def add(self, byte: int, child):
        """The node that holds the new child as well: this one, or a larger one in its place."""
        if len(self.children) == self.room:
            return self.grown().add(byte, child)
        at = 0
        while at < len(self.bytes) and self.bytes[at] < byte:
            at += 1
        self.bytes.insert(at, byte)
        self.children.insert(at, child)
        return self

    def grown(self):
        out = Node16(self.prefix, self.value)
        out.bytes, out.children = self.bytes, self.children
        return out

    def below(self) -> Iterator:
        return zip(self.bytes, self.children)


class Node16(Node4):
    """The same with up to sixteen."""

    __slots__ = ()
    room = 16

    def grown(self):
        out = Node48(self.prefix, self.value)
        for byte, child in self.below():
            out.add(byte, child)
        return out


class Node48:
    """Up to 48 children; a table of 256 bytes tells the place of each."""

    __slots__ = ("prefix", "value", "places", "children")
    none = 255

    def __init__(self, prefix: bytes, value=None):
        self.prefix, self.value = prefix, value
        self.places, self.children = bytearray([self.none]) * 256, []

    def find(self, byte: int):
        at = self.places[byte]
        return None if at == self.none else self.children[at]

    def replace(self, byte: int, child) -> None:
        self.children[self.places[byte]] = child

    def add(self, byte: int, child):
        if len(self.children) == 48:
            return self.grown().add(byte, child)
        self.places[byte] = len(self.children)
        self.children.append(child)
        return self

    def grown(self):
        out = Node256(self.prefix, self.value)
        for byte, child in self.below():
            out.add(byte, child)
        return out

    def below(self) -> Iterator:
        return ((byte, self.children[at]) for byte, at in enumerate(self.places) if at != self.none)


class Node256:
    """A child for any byte."""

    __slots__ = ("prefix", "value", "children")

    def __init__(self, prefix: bytes, value=None):
        self.prefix, self.value = prefix, value
        self.children = [None] * 256

    def find(self, byte: int):
        return self.children[byte]

    def replace(self, byte: int, child) -> None:
        self.children[byte] = child

    def add(self, byte: int, child):
        self.children[byte] = child
        return self

    def below(self) -> Iterator:
        return ((byte, child) for byte, child in enumerate(self.children) if child is not None)


def shared_length(a: bytes, b: bytes) -> int:
    """Equal bytes at the start of both."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    return n - ((int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")).bit_length() + 7) // 8


class RadixTree:
    """Byte keys and their values; a key may begin another one."""

    def __init__(self):
        self.root = None

    def insert(self, key: bytes, value) -> None:
        if self.root is None:
            self.root = Node4(key, value)
            return
        node, parent, edge, at = self.root, None, 0, 0
        while True:
            prefix = node.prefix
            n = len(prefix) if key.startswith(prefix, at) else shared_length(prefix, key[at:])
            if n < len(prefix):                      # the path parts inside this node
                upper = Node4(prefix[:n])
                upper.add(prefix[n], node)
                node.prefix = prefix[n + 1:]
                if at + n == len(key):
                    upper.value = value
                else:
                    upper.add(key[at + n], Node4(key[at + n + 1:], value))
                self._put(parent, edge, upper)
                return
            at += n
            if at == len(key):
                node.value = value
                return
            child = node.find(key[at])
            if child is None:
                larger = node.add(key[at], Node4(key[at + 1:], value))
                if larger is not node:
                    self._put(parent, edge, larger)
                return
            node, parent, edge, at = child, node, key[at], at + 1

    def _put(self, parent, edge: int, node) -> None:
        if parent is None:
            self.root = node
        else:
            parent.replace(edge, node)

    def upwards(self) -> Iterator[tuple[object, int, int]]:
        """(node, depth at which its own bytes begin, with the byte that leads to it; number of children), children first."""
        stack = [] if self.root is None else [(self.root, 0, 0, False)]
        while stack:
            node, start, end, done = stack.pop()
            if done:
                yield node, start, end
                continue
            end = end + len(node.prefix)
            stack.append((node, start, end, True))
            for _, child in reversed(list(node.below())):
                stack.append((child, end, end + 1, False))
