"""Deep-shallow suffix sorting: multikey quicksort to a shallow depth, blind tries below it."""

from __future__ import annotations

import numpy as np


def deep_shallow(rows: np.ndarray, sizes: np.ndarray, first: np.ndarray, shallow: int = 24) -> tuple[np.ndarray, np.ndarray]:
    """Sort the byte strings ``rows[i, :sizes[i]]`` within groups of equal ``first``.

    Returns the order and, for each place in it, the length of the prefix shared with the place before (-1 where another
    group starts). Bytes past a string's end are 0 and a shorter string comes first.
    """
    n, width = rows.shape
    order = np.argsort(first, kind="stable")
    lcp = np.full(n, -1, np.int64)
    keys = np.zeros((n, -(-width // 8) * 8), np.uint8)
    keys[:, :width] = rows
    words = keys.view(">u8")
    # multikey quicksort, eight characters a key: strings tied so far are parted by the next key
    starts = np.concatenate([[True], first[order][1:] != first[order][:-1]]) if n else np.zeros(0, bool)
    live, depth = np.arange(n), 0
    while depth < min(shallow, width) and len(live):
        group = np.cumsum(starts)[live]
        key = words[order[live], depth // 8]
        by = np.lexsort((key, group))
        order[live] = order[live][by]
        key = key[by]
        changed = np.concatenate([[True], key[1:] != key[:-1]])
        fresh = changed & ~starts[live]
        at = np.flatnonzero(fresh)
        differ = (key[at] ^ key[at - 1]).astype(np.uint64)
        lcp[live[at]] = depth + _zero_bytes(differ)
        starts[live[at]] = True
        tied = ~starts | ~np.concatenate([starts[1:], [True]]) if n else starts
        live = np.flatnonzero(tied)
        depth += 8
    # what is tied at the shallow depth goes to a blind trie, group by group
    heads = np.flatnonzero(starts)
    for a, b in zip(heads, np.append(heads[1:], n), strict=True):
        if b - a > 1:
            members = order[a:b]
            strings = [keys[i, : sizes[i]].tobytes() for i in members]
            sequence, common = blind_trie(strings, depth)
            order[a:b] = members[sequence]
            lcp[a + 1 : b] = common[1:]
    shorter = np.minimum(sizes[order], np.concatenate([[0], sizes[order][:-1]])) if n else lcp
    return order, np.where(lcp < 0, -1, np.minimum(lcp, shorter))


def _zero_bytes(x: np.ndarray) -> np.ndarray:
    """Leading zero bytes of non-zero 64-bit numbers."""
    out = np.zeros(len(x), np.int64)
    for _ in range(7):
        x, zero = np.where(x >> np.uint64(56) == 0, x << np.uint64(8), x), x >> np.uint64(56) == 0
        out += zero
    return out


def blind_trie(strings: list[bytes], depth: int) -> tuple[list[int], list[int]]:
    """Order strings that agree in their first ``depth`` bytes, and the prefix each shares with the one before.

    The trie keeps branching places and the bytes there, nothing between. A string descends blindly, by the bytes at
    branching places alone, to some leaf; one comparison with that leaf gives the place where it truly leaves the trie.
    """
    # an inner node: [place, {byte or -1 at the end: child}]; a leaf: a list of numbers of equal strings
    root: list = [0]
    for i in range(1, len(strings)):
        s = strings[i]
        node = root
        while isinstance(node[-1], dict):
            c = s[node[0]] if node[0] < len(s) else -1
            node = node[1][c] if c in node[1] else next(iter(node[1].values()))
        t = strings[node[0]]
        end = min(len(s), len(t))
        place = min(depth, end)
        while place + 16 <= end and s[place : place + 16] == t[place : place + 16]:
            place += 16
        while place < end and s[place] == t[place]:
            place += 1
        if place == len(s) == len(t):
            node.append(i)
            continue
        a, b = (s[place] if place < len(s) else -1), (t[place] if place < len(t) else -1)
        above, edge, node = None, None, root
        while isinstance(node[-1], dict) and node[0] < place:
            edge = s[node[0]] if node[0] < len(s) else -1
            above, node = node, node[1][edge]
        if isinstance(node[-1], dict) and node[0] == place:
            node[1][a] = [i]
            continue
        fresh: list = [place, {b: node, a: [i]}]
        if above is None:
            root = fresh
        else:
            above[1][edge] = fresh
    sequence: list[int] = []
    common: list[int] = []
    stack: list[tuple[list, int]] = [(root, -1)]
    while stack:
        node, shared = stack.pop()
        if isinstance(node[-1], dict):
            keys = sorted(node[1])
            stack += [(node[1][c], node[0]) for c in reversed(keys[1:])] + [(node[1][keys[0]], shared)]
        else:
            sequence += node
            common += [shared] + [len(strings[node[0]])] * (len(node) - 1)
    return sequence, common
