"""A deterministic transducer over bytes whose transitions emit token counts of a byte-level BPE vocabulary.

Two neighbouring tokens are *compatible* if merging the bytes of both gives these two tokens again.  A row of tokens is
what merging gives if and only if all neighbours in it are compatible, so exactly one token of the vocabulary can end
the encoding of a prefix.  Read as an automaton that is nondeterministic: at each byte it may start a token after any token,
walks the trie of tokens, and may end a token if it is compatible with the one before.

``Transducer`` is its subset construction.  A state is the set of tokens in progress: for each the place in the trie, the
token before it, and how many tokens the prefix up to there has, less those of the whole prefix.  A transition emits the
change of the number of tokens, which is negative where a longer token takes the place of several.  What is emitted along
a piece adds up to its number of tokens.  Transitions are compiled when they are first needed, as tables of state and byte.

Compatibility.  The last symbol of a token's bytes changes as merges go on: from a byte to the whole token, along the right
edge of its merge tree; likewise the first symbol.  Merges happen by rank, so a symbol of the right edge and one
of the left edge of the next token meet unless one has been merged before the pair's own rank comes up; of equal ranks
the left one goes first.  If any pair meets, the neighbours are not compatible.
"""

from __future__ import annotations

import math

import numpy as np

#: Compiled states above which the tables are emptied, between two parts; results do not depend on it.
STATES = 1 << 16
#: Bytes that go through the tables in one part; no part compiles more states.
PART_BYTES = 1 << 16
#: Longer pieces, in bytes, are run one by one.
LONG_PIECE = 256
_ROOT, _NO_TOKEN = 0, -1


class Transducer:
    """``alphabet``: the symbol of each byte; ``merges``: pairs of symbols in order of rank."""

    def __init__(self, alphabet: list[str], merges: list[tuple[str, str]]):
        byte_of = {s: b for b, s in enumerate(alphabet)}
        ids = dict(byte_of)  # symbol -> number; the first 256 are the bytes
        self.ranks: dict[tuple[int, int], int] = {}
        # Edges of the merge tree of each symbol that merging can give: symbols at its left, right edge with the rank that ends each.
        self.left: dict[int, list[tuple[int, float]]] = {b: [(b, math.inf)] for b in range(256)}
        self.right: dict[int, list[tuple[int, float]]] = {b: [(b, math.inf)] for b in range(256)}
        tokens = {b: bytes([b]) for b in range(256)}
        for rank, (a, b) in enumerate(merges):
            if a not in ids or b not in ids:
                raise ValueError(f"merge {rank} uses a symbol that no earlier merge makes")
            x, y = ids[a], ids[b]
            made = ids.setdefault(a + b, len(ids))
            self.ranks[x, y] = rank
            if made in tokens or x not in tokens or y not in tokens or self._meet(x, y, rank):
                continue  # known already, or merging never gets here
            tokens[made] = tokens[x] + tokens[y]
            self.left[made] = [(s, rank if s == x else end) for s, end in self.left[x]] + [(made, math.inf)]
            self.right[made] = [(s, rank if s == y else end) for s, end in self.right[y]] + [(made, math.inf)]
        # The trie: node * 256 + byte -> node, and the token that ends at a node.
        self.children: dict[int, int] = {}
        self.ends, self.inner = [_NO_TOKEN], {_ROOT}
        for token, text in tokens.items():
            node = _ROOT
            for b in text:
                self.inner.add(node)
                after = self.children.setdefault(node << 8 | b, len(self.ends))
                if after == len(self.ends):
                    self.ends.append(_NO_TOKEN)
                node = after
            self.ends[node] = token
        self.known: dict[tuple[int, int], bool] = {}
        self.clear()

    def _meet(self, a: int, b: int, before: float = math.inf) -> bool:
        """Whether a merge across the border of two tokens comes up, at a rank below ``before``."""
        for x, x_ends in self.right[a]:
            for y, y_ends in self.left[b]:
                rank = self.ranks.get((x, y), math.inf)
                if rank < before and rank < x_ends and rank <= y_ends:
                    return True
        return False

    def compatible(self, a: int, b: int) -> bool:
        if a == _NO_TOKEN:
            return True
        known = self.known.get((a, b))
        if known is None:
            if len(self.known) > 1 << 19:
                self.known.clear()
            known = self.known[a, b] = not self._meet(a, b)
        return known

    def clear(self) -> None:
        """Forgets all transitions; state 0 is the first."""
        start = ((_ROOT, _NO_TOKEN, 0),)
        self.numbers, self.states = {start: 0}, [start]
        self.next, self.emit = np.full(1 << 18, -1, np.int32), np.zeros(1 << 18, np.int16)

    def _compile(self, cell: int) -> None:
        """Makes the transition of ``cell``, a state's number * 256 + byte."""
        byte, last, emitted = cell & 255, _NO_TOKEN, 0
        going = []
        for node, before, count in self.states[cell >> 8]:
            after = self.children.get(node << 8 | byte, _ROOT)
            if after == _ROOT:
                continue
            if last == _NO_TOKEN:
                token = self.ends[after]
                if token != _NO_TOKEN and self.compatible(before, token):  # true of one only
                    last, emitted = token, count + 1
            if after in self.inner:
                going.append((after, before, count))
        new = (*[(node, before, count - emitted) for node, before, count in going], (_ROOT, last, 0))
        number = self.numbers.setdefault(new, len(self.states))
        if number == len(self.states):
            self.states.append(new)
            if len(self.states) * 256 > len(self.next):
                self.next = np.concatenate((self.next, np.full(len(self.next), -1, np.int32)))
                self.emit = np.concatenate((self.emit, np.zeros(len(self.emit), np.int16)))
        self.next[cell], self.emit[cell] = number, emitted

    def _run_long(self, text: bytes) -> int:
        state, total = 0, 0
        for b in text:
            cell = state << 8 | b
            if self.next[cell] < 0:
                if len(self.states) > STATES:
                    here = self.states[state]
                    self.clear()
                    state = self.numbers.setdefault(here, len(self.states))
                    if state == len(self.states):
                        self.states.append(here)
                    cell = state << 8 | b
                if self.next[cell] < 0:
                    self._compile(cell)
            total += int(self.emit[cell])
            state = int(self.next[cell])
        return total

    def _run(self, data: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Counts of pieces, the longest first: all go through the tables in step, a byte at a time."""
        state, total = np.zeros(len(first), np.int64), np.zeros(len(first), np.int64)
        more = np.searchsorted(-size, -np.arange(int(size[0])), side="left")  # pieces of more than 0, 1, ... bytes
        for i, m in enumerate(more.tolist()):
            cell = state[:m] << 8 | data[first[:m] + i]
            after = self.next.take(cell)
            if (after < 0).any():
                for c in np.unique(cell[after < 0]).tolist():
                    self._compile(c)
                after = self.next.take(cell)
            total[:m] += self.emit.take(cell)
            state[:m] = after
        return total

    def counts(self, data: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Tokens of the pieces ``data[first : first + size]``, each at least one byte."""
        out = np.zeros(len(first), np.int64)
        for i in np.flatnonzero(size > LONG_PIECE).tolist():
            out[i] = self._run_long(data[first[i] : first[i] + size[i]].tobytes())
        rows = np.flatnonzero(size <= LONG_PIECE)
        part = (np.cumsum(size[rows]) - 1) // PART_BYTES
        for rows in np.split(rows, np.flatnonzero(np.diff(part)) + 1):
            if len(self.states) > STATES:
                self.clear()
            if len(rows):
                rows = rows[np.argsort(-size[rows], kind="stable")]
                out[rows] = self._run(data, first[rows], size[rows])
        return out
