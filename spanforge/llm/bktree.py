"""BK-trees over integers under Hamming distance."""

from __future__ import annotations

from collections.abc import Iterator


class BKTree:
    """Children of a node are keyed by their integer distance to it; a search follows only edges
    whose distance lies within the radius of the query's own distance to the node."""

    def __init__(self) -> None:
        self.root: tuple | None = None

    def add(self, value: int, label: int) -> None:
        if self.root is None:
            self.root = (value, label, {})
            return
        node = self.root
        while True:
            d = (node[0] ^ value).bit_count()
            child = node[2].get(d)
            if child is None:
                node[2][d] = (value, label, {})
                return
            node = child

    def near(self, value: int, radius: int) -> Iterator[int]:
        """Labels of all values at most ``radius`` away, as they are found."""
        todo = [self.root] if self.root else []
        while todo:
            at, label, children = todo.pop()
            d = (at ^ value).bit_count()
            if d <= radius:
                yield label
            if children:
                low, high = d - radius, d + radius
                if len(children) > 2 * radius + 1:
                    todo.extend(children[k] for k in range(low, high + 1) if k in children)
                else:
                    todo.extend(c for k, c in children.items() if low <= k <= high)


class Forest:
    """Disjoint sets."""

    def __init__(self) -> None:
        self.up: dict = {}

    def find(self, x):
        """The top of a member's set."""
        up = self.up
        top = x
        while up.get(top, top) != top:
            top = up[top]
        while up.get(x, x) != top:
            up[x], x = top, up[x]
        return top

    def hang(self, x, under) -> None:
        """Join two sets; the top of the second is that of both."""
        x, under = self.find(x), self.find(under)
        if x != under:
            self.up[x] = under
