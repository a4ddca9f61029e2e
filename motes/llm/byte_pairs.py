"""Byte-pair merges compiled, as far as texts ask for it, into a deterministic transducer over bytes.

The last token of a piece's first i bytes is the one token that ends there and that the tokens of the bytes before it leave apart; the tokens before it are those
of that shorter beginning. So what a piece's next bytes can change depends only on how far its end is the beginning of tokens, and on the last token and
the number of tokens at each of these places: that is a state. Reading a byte leads to one next state and emits by how many tokens the count grows
(or shrinks, where tokens melt together). There are finitely many states; those that texts reach are made once and kept in tables.
"""

from __future__ import annotations


import numpy as np

NONE = 1 << 60
#: The last token of the empty beginning.
START = -1
#: A token and a growth of at most ZERO either way in one number.
SHIFT = 16
MASK, ZERO = (1 << SHIFT) - 1, 1 << (SHIFT - 1)
#: From byte LONG on, so FEW pieces are read one by one.
LONG, FEW = 256, 16


def byte_alphabet() -> dict[str, int]:
    """The printable stand-ins of bytes in vocabulary files: printable Latin-1 stands for itself, the others follow from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(0x100 + i): b for i, b in enumerate(others)}


class Merges:
    """Tokens by number: 0 to 255 are the bytes, then one token a merge, in order of rank."""

    def __init__(self, merges: list[list[str]]):
        stand_in = byte_alphabet()
        self.text: list[bytes] = [bytes([b]) for b in range(256)]
        self.left, self.right = [0] * 256, [0] * 256
        self.pair: dict[tuple[int, int], int] = {}
        number = {t: i for i, t in enumerate(self.text)}
        for a, b in merges:
            one, two = (number[bytes(stand_in[c] for c in x)] for x in (a, b))
            whole = self.text[one] + self.text[two]
            if whole in number:
                raise ValueError(f"{whole!r} is merged in two ways")
            number[whole] = self.pair[one, two] = len(self.text)
            self.text.append(whole)
            self.left.append(one)
            self.right.append(two)
        self.apart: dict[tuple[int, int], bool] = {}

    def stay_apart(self, a: int, b: int) -> bool:
        """Whether a followed by b are the tokens of their bytes.

        Undoes merges beside the border from the last to the first; the pair at the border must never have been due before the merge that ended it.
        Of equal merges the left one comes first.
        """
        known = self.apart.get((a, b))
        if known is None:
            one, two, due, known = a, b, NONE, True
            while known:
                known = self.pair.get((one, two), NONE) >= due or (one, two) not in self.pair
                if one < 256 and two < 256:
                    break
                if one > two:
                    one, due = self.right[one], one
                else:
                    two, due = self.left[two], two + 1
            self.apart[a, b] = known
        return known


class Transducer:
    """States and transitions over bytes. State 0 is the start of a piece.

    A state is a node of the trie of all tokens (the longest end of the bytes so far from which tokens go on) and, for it, for each shorter such end and
    for the empty one, the last token before that end and by how many tokens the count has grown since, in one number.
    """

    #: States kept before all are forgotten; bounds a process's memory (some 600 bytes each) whatever the texts hold.
    MOST = 200_000

    def __init__(self, merges: Merges):
        self.merges = merges
        self.child: dict[tuple[int, int], int] = {}
        self.up, self.depth, self.token = [(0, 0)], [0], [-1]
        for i, text in enumerate(merges.text):
            node = 0
            for b in text:
                at = self.child.get((node, b))
                if at is None:
                    at = self.child[node, b] = len(self.up)
                    self.up.append((node, b))
                    self.depth.append(self.depth[node] + 1)
                    self.token.append(-1)
                node = at
            self.token[node] = i
        self.inner = {node for node, _ in self.child} - {0}
        self.ends: dict[int, list[int]] = {0: []}
        self.links: dict[tuple[int, int], tuple] = {}
        self.clear()

    def clear(self) -> None:
        """Forget all states but the start."""
        self.states: list[tuple[int, ...]] = [(0, (START << SHIFT) + ZERO)]
        self.number = {self.states[0]: 0}
        self.table = Sparse()
        self.single: dict[int, tuple[int, int]] = {}

    def chain(self, node: int) -> list[int]:
        """The node, and those of all shorter ends of its bytes that are beginnings of tokens, longest first."""
        found = self.ends.get(node)
        if found is None:
            above, byte = self.up[node]
            found = [node]
            for shorter in [*self.chain(above)[1:], 0] if above else []:
                at = self.child.get((shorter, byte))
                if at is not None:
                    found += self.chain(at)
                    break
            self.ends[node] = found
        return found

    def link(self, node: int, byte: int) -> tuple[int, list[tuple[int, int]], list[int]]:
        """What a byte after a node gives whatever the tokens: the next node, the tokens that may end here, and the ends to keep; both with the place of the end before it in the state."""
        found = self.links.get((node, byte))
        if found is None:
            before = [x for x in self.chain(node) if x in self.inner] + [0]
            place = {self.depth[x]: i for i, x in enumerate(before, 1)}
            at = next(x for x in (self.child.get((y, byte)) for y in before) if x is not None)
            ends = self.chain(at)
            kept = [x for x in ends if x in self.inner]
            found = self.links[node, byte] = (kept[0] if kept else 0, [(place[self.depth[x] - 1], self.token[x]) for x in ends if self.token[x] >= 0], [place[self.depth[x] - 1] for x in kept])
        return found

    def step(self, state: int, byte: int) -> tuple[int, int]:
        """Next state, and by how much the count of tokens grows."""
        held = self.states[state]
        node, tokens, kept = self.link(held[0], byte)
        for i, last in tokens:
            previous = held[i] >> SHIFT
            if previous == START or self.merges.stay_apart(previous, last):
                grows = 1 - ((held[i] & MASK) - ZERO)
                break
        else:
            raise ValueError("the vocabulary leaves bytes without tokens")
        key = (node, *[held[i] + grows for i in kept], (last << SHIFT) + ZERO)
        found = self.number.setdefault(key, len(self.states))
        if found == len(self.states):
            self.states.append(key)
        return found, grows

    def steps(self, states: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same for many states and bytes."""
        keys = states * 256 + data
        at = self.table.slots(keys)
        if (self.table.keys[at] != keys).any():
            new = np.unique(keys[self.table.keys[at] != keys]).tolist()
            made = [self.step(k >> 8, k & 255) for k in new]
            self.table.add(new, [(s << 8) + g + 128 for s, g in made])
            at = self.table.slots(keys)
        got = self.table.values[at]
        return got >> 8, (got & 255) - 128

    def alone(self, state: int, data: bytes) -> int:
        """Growth of the count over many bytes of one piece."""
        total, single = 0, self.single
        for byte in data:
            key = state << 8 | byte
            if key not in single:
                if len(self.states) > 2 * self.MOST:  # a state outlives the others as what it stands for
                    held = self.states[state]
                    self.clear()
                    state = self.number.setdefault(held, len(self.states))
                    if state == len(self.states):
                        self.states.append(held)
                    key, single = state << 8 | byte, self.single
                single[key] = self.step(state, byte)
            state, grows = single[key]
            total += grows
        return total

    def counts(self, data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Tokens of each piece data[begin:end], all pieces read side by side, longest first."""
        if len(self.states) > self.MOST:
            self.clear()
        order = np.argsort(begin - end, kind="stable")
        begin, size = begin[order], (end - begin)[order]
        state, total = np.zeros(len(begin), np.int64), np.zeros(len(begin), np.int64)
        # how many pieces are longer than i bytes
        longer = len(size) - np.cumsum(np.bincount(size))[:-1] if len(size) else []
        for i, n in enumerate(longer):
            if n <= FEW and i >= LONG:
                for j in range(n):
                    total[j] += self.alone(int(state[j]), data[begin[j] + i : begin[j] + size[j]].tobytes())
                break
            state[:n], grown = self.steps(state[:n], data[begin[:n] + i])
            total[:n] += grown
        out = np.empty_like(total)
        out[order] = total
        return out


class Sparse:
    """From whole numbers to whole numbers, looked up for many at once: open addressing, at most half full."""

    def __init__(self, bits: int = 12):
        self.bits, self.held = bits, 0
        self.keys, self.values = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, np.int64)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """Where each key is, or where it would go."""
        at = ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)
        there = self.keys[at]
        todo = np.flatnonzero((there != keys) & (there >= 0))
        while len(todo):
            at[todo] = (at[todo] + 1) & (len(self.keys) - 1)
            there = self.keys[at[todo]]
            todo = todo[(there != keys[todo]) & (there >= 0)]
        return at

    def add(self, keys: list[int], values: list[int]) -> None:
        """Keys that are not held yet."""
        if 2 * (self.held + len(keys)) > len(self.keys):
            old = np.flatnonzero(self.keys >= 0)
            kept, given = self.keys[old], self.values[old]
            bits = self.bits
            while 2 * (len(kept) + len(keys)) > 1 << bits:
                bits += 1
            self.__init__(bits + 1)
            keys, values = [*kept.tolist(), *keys], [*given.tolist(), *values]
        own, given = np.array(keys, np.int64), np.array(values, np.int64)
        while len(own):
            at = self.slots(own)
            _, first = np.unique(at, return_index=True)
            self.keys[at[first]], self.values[at[first]] = own[first], given[first]
            self.held += len(first)
            rest = np.ones(len(own), bool)
            rest[first] = False
            own, given = own[rest], given[rest]
