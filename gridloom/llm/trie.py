"""A compressed radix trie over whole byte strings, whose subtrees can be given up when memory runs short."""

from __future__ import annotations

from collections.abc import Iterator

#: Bytes that a node takes besides its label.
NODE_BYTES = 400


class _Node:
    __slots__ = ("gone", "kids", "label", "value", "weight")

    def __init__(self, label: bytes, value=None):
        self.label, self.value, self.kids, self.gone = label, value, None, False
        self.weight = len(label) + NODE_BYTES


def _common(a: bytes, b: bytes, at: int) -> int:
    """How many first bytes of ``a`` stand at ``at`` in ``b``."""
    low, high = 0, min(len(a), len(b) - at)
    while low < high:
        mid = (low + high + 1) // 2
        if a[low:mid] == b[at + low : at + mid]:
            low = mid
        else:
            high = mid - 1
    return low


class PatriciaTrie:
    """Terminals hold a value; ``merge(old, new)`` joins the values of equal keys."""

    def __init__(self, merge):
        self.merge, self.root = merge, _Node(b"")

    @property
    def weight(self) -> int:
        return self.root.weight

    def insert(self, key: bytes, value) -> bool:
        """False if the key belongs to a subtree that was given up; it isn't kept then."""
        node, at, n = self.root, 0, len(key)
        path = [node]
        while True:
            if node.gone:
                return False
            if at == n:
                node.value = value if node.value is None else self.merge(node.value, value)
                return True
            kids = node.kids
            child = kids.get(key[at]) if kids else None
            if child is None:
                if kids is None:
                    node.kids = kids = {}
                leaf = kids[key[at]] = _Node(key[at:], value)
                added = leaf.weight
                break
            label = child.label
            if key.startswith(label, at):
                at += len(label)
                node = child
                path.append(node)
                continue
            same = _common(label, key, at)
            upper = _Node(label[:same])
            child.label = label[same:]
            upper.kids = {child.label[0]: child}
            child.weight -= same
            upper.weight += child.weight
            kids[key[at]] = upper
            added = NODE_BYTES
            at += same
            if at == n:
                upper.value = value
            else:
                leaf = upper.kids[key[at]] = _Node(key[at:], value)
                upper.weight += leaf.weight
                added += leaf.weight
            break
        for x in path:
            x.weight += added
        return True

    @staticmethod
    def _items(node: _Node, prefix: bytes) -> Iterator[tuple[bytes, object]]:
        stack = [(node, prefix)]
        while stack:
            node, prefix = stack.pop()
            if node.value is not None:
                yield prefix, node.value
            for kid in (node.kids or {}).values():
                stack.append((kid, prefix + kid.label))

    def items(self) -> Iterator[tuple[bytes, object]]:
        return self._items(self.root, b"")

    def values(self) -> Iterator[object]:
        stack = [self.root]
        while stack:
            node = stack.pop()
            if node.value is not None:
                yield node.value
            if node.kids:
                stack.extend(node.kids.values())

    def give_up(self) -> Iterator[tuple[bytes, object]]:
        """Takes out the heaviest subtree that is under half of the trie (or a leaf), and gives its items one by one; later keys of it are turned away."""
        half, node, prefix, path = self.root.weight // 2, self.root, b"", [self.root]
        while node.kids and (node is self.root or node.weight > half):
            node = max(node.kids.values(), key=lambda x: x.weight)
            prefix += node.label
            path.append(node)
        out = _Node(node.label, node.value)
        out.kids = node.kids
        freed = node.weight - len(node.label) - NODE_BYTES
        node.gone, node.kids, node.value = True, None, None
        for x in path:
            x.weight -= freed
        return self._items(out, prefix)
