"""Deep-shallow sorting of byte strings.

Multikey quicksort orders strings by their first bytes, to a shallow depth. Strings that are still
equal there are ordered by a blind trie: it keeps only the depth and the branching byte of each
fork, so a string is inserted with one comparison, however long the common prefixes are.
"""

from __future__ import annotations

from collections.abc import Sequence

SHALLOW = 12
END = -1  # the branching "byte" of a string that ends


def common(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    differ = int.from_bytes(a[:n]) ^ int.from_bytes(b[:n])
    return n - (differ.bit_length() + 7) // 8


class Node:
    """A fork at a depth; or, with members, the place of equal strings."""

    __slots__ = ("children", "depth", "members")

    def __init__(self, depth: int, members: list[int] | None = None):
        self.depth, self.members = depth, members
        self.children: dict[int, Node] = {}


def _branch(string: bytes, depth: int) -> int:
    return string[depth] if depth < len(string) else END


def blind_trie(strings: Sequence[bytes], which: Sequence[int]) -> Node:
    """The trie of strings[i] for i in which (not empty)."""
    root = Node(len(strings[which[0]]), [which[0]])
    for i in which[1:]:
        string, node = strings[i], root
        while node.members is None:  # blindly to some leaf
            node = node.children.get(_branch(string, node.depth)) or next(iter(node.children.values()))
        other = strings[node.members[0]]
        same = common(string, other)
        if same == len(string) == len(other):
            node.members.append(i)
            continue
        above, node = None, root
        while node.members is None and node.depth < same:
            above, node = node, node.children[_branch(string, node.depth)]
        if node.members is None and node.depth == same:
            node.children[_branch(string, same)] = Node(len(string), [i])
            continue
        fork = Node(same)
        fork.children = {_branch(other, same): node, _branch(string, same): Node(len(string), [i])}
        if above is None:
            root = fork
        else:
            above.children[_branch(string, above.depth)] = fork
    return root


def in_order(root: Node) -> list[int]:
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        if node.members is not None:
            out += node.members
        else:
            stack += [node.children[c] for c in sorted(node.children, reverse=True)]
    return out


def deep_shallow(strings: Sequence[bytes], shallow: int = SHALLOW) -> list[int]:
    """The order of the strings; equal ones in the order given."""
    out: list[int] = []
    stack = [(list(range(len(strings))), 0)]
    while stack:
        group, depth = stack.pop()
        if len(group) < 2:
            out += group
        elif depth >= shallow:
            out += in_order(blind_trie(strings, group))
        else:
            keys = [_branch(strings[i], depth) for i in group]
            pivot = sorted((keys[0], keys[len(keys) // 2], keys[-1]))[1]
            stack.append(([i for i, k in zip(group, keys) if k > pivot], depth))
            stack.append(([i for i, k in zip(group, keys) if k == pivot], shallow if pivot == END else depth + 1))
            stack.append(([i for i, k in zip(group, keys) if k < pivot], depth))
    return out
