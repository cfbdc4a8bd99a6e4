"""Minimal acyclic transducer of sorted terms: each term's place in order comes out while its bytes go in.

Built from terms in byte order in one pass: what lies behind the common prefix of two neighbours is final and merged
with an equal state if there is one, so no more is held than the path of one term and the finished states. Every arc
carries how many terms come before those behind it at its state; the sum along a term's path is its ordinal.

``Transducer`` walks many terms in step: one search in the sorted arcs for each byte position, for all terms at once.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np


class Transducer:
    """Arcs sorted by state and byte (``keys`` = state * 256 + byte), their targets and skips; final states; a root."""

    def __init__(self, keys: np.ndarray, to: np.ndarray, skip: np.ndarray, final: np.ndarray, root: int):
        self.keys, self.to, self.skip, self.final, self.root = keys, to, skip, final, root

    @staticmethod
    def build(terms: Iterable[bytes]) -> Transducer:
        """``terms`` in byte order, each once."""
        register: dict[tuple, int] = {}
        size: list[int] = []  # terms that each state accepts
        states: list[tuple] = []

        def settle(node: list) -> int:
            key = (node[0], tuple(node[1]))
            state = register.get(key)
            if state is None:
                state = register[key] = len(states)
                states.append(key)
                size.append(node[0] + sum(size[t] for _, t in node[1]))
            return state

        path: list[list] = [[0, []]]
        before = b""
        for term in terms:
            same = 0
            for x, y in zip(before, term, strict=False):
                if x != y:
                    break
                same += 1
            while len(path) > same + 1:
                done = settle(path.pop())
                path[-1][1].append((before[len(path) - 1], done))
            path += [[0, []] for _ in range(len(term) - same)]
            path[-1][0] = 1
            before = term
        while len(path) > 1:
            done = settle(path.pop())
            path[-1][1].append((before[len(path) - 1], done))
        root = settle(path[0])
        keys, to, skip = [], [], []
        for state, (final, arcs) in enumerate(states):
            passed = final
            for byte, target in arcs:
                keys.append(state * 256 + byte)
                to.append(target)
                skip.append(passed)
                passed += size[target]
        return Transducer(np.array(keys, np.int64), np.array(to, np.int32), np.array(skip, np.int64), np.array([s[0] for s in states], bool), root)

    @staticmethod
    def joined(parts: list[Transducer]) -> tuple[Transducer, np.ndarray]:
        """One table of all arcs, and the root of each part in it."""
        shift = np.cumsum([0, *[len(p.final) for p in parts]])
        cat = lambda arrays, kind: np.concatenate([*arrays, np.zeros(0, kind)]).astype(kind)
        keys = cat([p.keys + int(s) * 256 for p, s in zip(parts, shift, strict=False)], np.int64)
        to = cat([p.to + s for p, s in zip(parts, shift, strict=False)], np.int32)
        whole = Transducer(keys, to, cat([p.skip for p in parts], np.int64), cat([p.final for p in parts], bool), 0)
        return whole, np.array([p.root + s for p, s in zip(parts, shift, strict=False)], np.int64)

    def ordinals(self, data: np.ndarray, ends: np.ndarray, roots: np.ndarray) -> np.ndarray:
        """Ordinal of each term below its root, -1 if it is not there; term k is ``data[ends[k]:ends[k + 1]]``."""
        n = len(ends) - 1
        state, total = roots.astype(np.int64), np.zeros(n, np.int64)
        size = np.diff(ends)
        live = np.flatnonzero(size > 0)
        if not len(self.keys):
            state[live] = -1
            live = live[:0]
        for k in range(int(size.max(initial=0))):
            want = state[live] * 256 + data[ends[live] + k]
            at = np.minimum(np.searchsorted(self.keys, want), len(self.keys) - 1)
            hit = self.keys[at] == want
            state[live[~hit]] = -1
            live, at = live[hit], at[hit]
            total[live] += self.skip[at]
            state[live] = self.to[at]
            live = live[size[live] > k + 1]
            if not len(live):
                break
        known = state >= 0
        known[known] = self.final[state[known]]
        return np.where(known, total, -1)

    def term(self, ordinal: int, root: int) -> bytes:
        """The term of an ordinal."""
        out, state, left = bytearray(), root, ordinal
        while not (left == 0 and self.final[state]):
            a, b = np.searchsorted(self.keys, (state * 256, state * 256 + 256))
            at = a + int(np.searchsorted(self.skip[a:b], left, "right")) - 1
            out.append(int(self.keys[at]) & 255)
            left -= int(self.skip[at])
            state = int(self.to[at])
        return bytes(out)
