"""Regular expressions to one minimal deterministic automaton over bytes.

Rules are compiled by the subset construction and minimised by partition
refinement into transition arrays.  The language of rules is that of regular
expressions over ASCII: literals, ``.``-free classes, groups, ``|``, ``?``,
``*``, ``+`` and counts.
"""

from __future__ import annotations

import numpy as np

ASCII = frozenset(range(128))


# ---- rules to non-deterministic automata ---------------------------------------------
class _Reader:
    """Recursive descent over one rule; builds a tree of ('set', bytes), ('cat', ...), ('alt', ...),
    ('rep', node, least, most)."""

    def __init__(self, rule: str, any_case: bool):
        self.rule, self.at, self.any_case = rule, 0, any_case

    def peek(self) -> str:
        return self.rule[self.at:self.at + 1]

    def take(self) -> str:
        self.at += 1
        return self.rule[self.at - 1]

    def alternatives(self):
        found = [self.sequence()]
        while self.peek() == "|":
            self.take()
            found.append(self.sequence())
        return found[0] if len(found) == 1 else ("alt", found)

    def sequence(self):
        parts = []
        while self.peek() and self.peek() not in "|)":
            parts.append(self.repeated(self.single()))
        return ("cat", parts)

    def repeated(self, node):
        c = self.peek()
        if c and c in "?*+":
            self.take()
            return ("rep", node, int(c == "+"), 1 if c == "?" else None)
        if c == "{":
            end = self.rule.index("}", self.at)
            least, comma, most = self.rule[self.at + 1:end].partition(",")
            self.at = end + 1
            return ("rep", node, int(least), int(most) if most else None if comma else int(least))
        return node

    def single(self):
        c = self.take()
        if c == "(":
            node = self.alternatives()
            if self.peek() != ")":
                raise ValueError(f"unbalanced group in {self.rule!r}")
            self.take()
            return node
        if c == "[":
            return ("set", self.members())
        return ("set", self.cases({self.escaped() if c == "\\" else ord(c)}))

    def escaped(self) -> int:
        c = self.take()
        if c == "x":
            self.at += 2
            return int(self.rule[self.at - 2:self.at], 16)
        return ord(c)

    def members(self) -> frozenset:
        found, negated = set(), self.peek() == "^"
        self.at += negated
        while self.peek() != "]":
            c = self.take()
            low = self.escaped() if c == "\\" else ord(c)
            high = low
            if self.peek() == "-" and self.rule[self.at + 1] != "]":
                self.take()
                c = self.take()
                high = self.escaped() if c == "\\" else ord(c)
            found |= set(range(low, high + 1))
        self.take()
        found = self.cases(found)
        return frozenset(ASCII - found if negated else found)

    def cases(self, values) -> frozenset:
        if not self.any_case:
            return frozenset(values)
        return frozenset(x for v in values for x in (ord(chr(v).lower()), ord(chr(v).upper())))


def parse(rule: str, any_case: bool = False):
    """The tree of a rule; ``any_case`` lets ASCII letters match in either case."""
    reader = _Reader(rule, any_case)
    tree = reader.alternatives()
    if reader.at != len(rule):
        raise ValueError(f"unbalanced group in {rule!r}")
    return tree


def backwards(tree):
    """The tree of the reversed strings."""
    kind = tree[0]
    if kind == "cat":
        return ("cat", [backwards(x) for x in reversed(tree[1])])
    if kind == "alt":
        return ("alt", [backwards(x) for x in tree[1]])
    return ("rep", backwards(tree[1]), *tree[2:]) if kind == "rep" else tree


class _Nfa:
    def __init__(self):
        self.empty: list[list[int]] = []  # moves without a byte
        self.moves: list[list[tuple[frozenset, int]]] = []

    def state(self) -> int:
        self.empty.append([])
        self.moves.append([])
        return len(self.empty) - 1

    def add(self, tree, at: int) -> int:
        """Let ``tree`` begin at a state; returns where it ends."""
        kind = tree[0]
        if kind == "set":
            end = self.state()
            self.moves[at].append((tree[1], end))
            return end
        if kind == "cat":
            for part in tree[1]:
                at = self.add(part, at)
            return at
        if kind == "alt":
            end = self.state()
            for part in tree[1]:
                self.empty[self.add(part, at)].append(end)
            return end
        _, node, least, most = tree
        for _ in range(least):
            at = self.add(node, at)
        if most is None:
            loop = self.state()
            self.empty[at].append(loop)
            self.empty[self.add(node, loop)].append(loop)
            return loop
        end = self.state()
        for _ in range(most - least):
            self.empty[at].append(end)
            at = self.add(node, at)
        self.empty[at].append(end)
        return end

    def closed(self, states) -> frozenset:
        seen, todo = set(states), list(states)
        while todo:
            for s in self.empty[todo.pop()]:
                if s not in seen:
                    seen.add(s)
                    todo.append(s)
        return frozenset(seen)


class Automaton:
    """A minimal deterministic automaton for several rules.

    ``classes`` maps a byte to its class, ``moves[state, class]`` is the next
    state, ``accepts[state]`` has bit r set when rule r ends here.  State 0 is
    the start.  ``dead`` is the state from which no rule can end, or -1.
    """

    def __init__(self, trees: list, search: bool):
        """``search``: rules may begin at any byte; else only at the first."""
        nfa = _Nfa()
        start = nfa.state()
        final = {}
        for r, tree in enumerate(trees):
            begin = nfa.state()
            nfa.empty[start].append(begin)
            final[nfa.add(tree, begin)] = r
        # bytes that no rule tells apart form a class
        sets = sorted({m for moves in nfa.moves for m, _ in moves}, key=sorted)
        of = {}
        self.classes = np.zeros(256, np.uint8)
        for b in range(256):
            self.classes[b] = of.setdefault(tuple(b in s for s in sets), len(of))
        samples = [int(np.argmax(self.classes == c)) for c in range(len(of))]
        # subset construction
        first = nfa.closed([start])
        names, moves, todo = {first: 0}, [], [first]
        while todo:
            now = todo.pop(0)
            row = []
            for b in samples:
                to = {s for x in now for members, s in nfa.moves[x] if b in members}
                to = nfa.closed(to | {start}) if search else nfa.closed(to)
                if to not in names:
                    names[to] = len(names)
                    todo.append(to)
                row.append(names[to])
            moves.append(row)
        table = np.array(moves, np.int64)
        accepts = np.array([sum(1 << r for s, r in final.items() if s in name) for name in names], np.int64)
        self._minimise(table, accepts)
        if len(self.moves) > 1 << 16 or len(of) > 128:
            raise ValueError(f"{len(self.moves)} states, {len(of)} byte classes: too many rules for one automaton")

    def _minimise(self, table: np.ndarray, accepts: np.ndarray) -> None:
        """Refine the partition by what is accepted until moves keep it; number the blocks by first state."""
        block = np.unique(accepts, return_inverse=True)[1]
        while True:
            finer = np.unique(np.column_stack([block, block[table]]), axis=0, return_inverse=True)[1].ravel()
            if finer.max() == block.max():
                break
            block = finer
        _, seen = np.unique(block, return_index=True)
        rank = np.argsort(np.argsort(seen))  # state 0 stays first
        block, states = rank[block], np.sort(seen)
        self.moves = block[table[states]].astype(np.uint16)
        self.accepts = accepts[states]
        stuck = np.flatnonzero((self.moves == np.arange(len(states))[:, None]).all(axis=1) & (self.accepts == 0))
        self.dead = int(stuck[0]) if len(stuck) else -1

    def run(self, data: np.ndarray, first: np.ndarray, lane: int = 512) -> np.ndarray:
        """The state after every byte; the automaton starts anew at each text (``first``: their offsets).

        One pass over the bytes: the buffer is cut into lanes that advance side
        by side, each begun in the start state.  Where the lane before ends in
        another state, a lane is taken up again from there, until both runs
        are in the same state.
        """
        n, k = len(data), self.moves.shape[1]
        if not n:
            return np.zeros(0, np.uint16)
        # at a text's first byte every state moves like the start state
        flat = np.concatenate([self.moves, np.repeat(self.moves[:1], len(self.moves), axis=0)], axis=1).ravel()
        width = np.uint32(2 * k)
        lanes = -(-n // lane)
        step = np.zeros(lanes * lane, np.uint8)
        step[:n] = self.classes[data]
        at = first[first < n]
        step[at] += np.uint8(k)
        step = np.ascontiguousarray(step.reshape(lanes, lane).T)
        out = np.empty((lane, lanes), np.uint16)
        state = np.zeros(lanes, np.uint16)
        for i in range(lane):
            state = flat[state * width + step[i]]
            out[i] = state
        begun = np.zeros(lanes, np.uint16)
        while True:
            before = np.concatenate((np.zeros(1, np.uint16), out[-1, :-1]))
            todo = np.flatnonzero(before != begun)
            if not len(todo):
                return np.ascontiguousarray(out.T).ravel()[:n]
            begun[todo] = state = before[todo]
            for i in range(lane):
                state = flat[state * width + step[i, todo]]
                differs = state != out[i, todo]
                if not differs.any():
                    break
                todo, state = todo[differs], state[differs]
                out[i, todo] = state
