"""Logistic mixing of hashed-context bit predictors.

A text is a stream of tokens. A token is a path of binary decisions: from the root of the frequent tokens' code tree to
its leaf, and, for a token outside the code, from the escape's leaf on byte by byte to the token's stop. At each decision
four predictors look at it: in the tree the node's own share and tables hashed by the node with the one, two and three
tokens before; in a spelled token tables by the one, two and three bytes before and by the token's beginning.

A table's slot counts zeros and ones. What a predictor says of a decision is one of STATES: how often its slot was seen
and how often it was one. The four states are a cell. Mixing: the states' log odds are weighted, the weights being chosen
(gated) by how sure the second and third predictors are; they are learnt online, over the training decisions by cell in
blocks, each decision left out of its own counts. Refinement: a cell's mixed probability moves to how it came true.
Counts by slot and by cell only add up, so neither the order nor the partitioning of texts changes the model.
"""

from __future__ import annotations

import numpy as np

from siltstone.llm.wordarrays import _BYTE, _POW, BLOCK

U, W = np.uint64, np.uint32
SURE, ODDS = 5, 5
STATES = SURE * ODDS
PREDICTORS = 4
CELLS = STATES**PREDICTORS
GATES, INPUTS = SURE * SURE, PREDICTORS + 1
STOP, LEAD = 32, 3
#: Places whose arrays are held at a time.
SLICE = 1 << 16
LEAST_BITS, MOST_BITS, SPELL_BITS = 16, 22, 18
_C1, _C2 = W(0x9E3779B1), W(0x85EBCA6B)


def bits_for(tokens: int) -> int:
    """Slots of a context table as a power of two: two a training token, up to what each worker can hold."""
    return min(max((2 * tokens).bit_length(), LEAST_BITS), MOST_BITS)


def sizes(bits: int) -> list[int]:
    """Slots of the tables: three of the tree, four of spelling."""
    return [1 << bits] * 3 + [1 << SPELL_BITS] * PREDICTORS


def state_of(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """SURE levels by n0 + n1 (0, 1, 2 to 3, 4 to 15, more) and ODDS levels by the share of ones."""
    n = n0 + n1
    sure = np.select([n <= 0, n <= 1, n <= 3, n <= 15], [0, 1, 2, 3], 4)
    share = (n1 + 0.4) / (n + 0.8)
    odds = np.select([share < 0.06, share < 0.3, share <= 0.7, share <= 0.94], [0, 1, 2, 3], 4)
    return (ODDS * sure + odds).astype(np.uint8)


def level_of(share: np.ndarray) -> np.ndarray:
    """A node's own share of ones in STATES steps of log odds."""
    z = np.log(np.clip(share, 1e-6, 1 - 1e-6) / (1 - np.clip(share, 1e-6, 1 - 1e-6)))
    return np.clip(np.round(z * 2 + (STATES - 1) / 2), 0, STATES - 1).astype(np.uint8)


#: State by the two bytes of a slot: as it is; with a zero left out; with a one left out. A full byte was scaled: nothing
#: is left out of it.
_ZEROS, _ONES = np.arange(1 << 16) & 255, np.arange(1 << 16) >> 8
_SCALED = (_ZEROS == 255) | (_ONES == 255)
STATE = state_of(_ZEROS, _ONES)
LEFT_OUT = np.stack([np.where(_SCALED, STATE, state_of(np.maximum(_ZEROS - 1, 0), _ONES)), np.where(_SCALED, STATE, state_of(_ZEROS, np.maximum(_ONES - 1, 0)))])


def packed(n: np.ndarray) -> np.ndarray:
    """Counts (slots, 2) as two bytes a slot; counts beyond 255 are scaled together."""
    n = n.astype(np.int64)
    most = n.max(1, initial=0)
    scaled = -(-n * 255 // np.maximum(most, 255)[:, None])
    return (scaled[:, 0] | (scaled[:, 1] << 8)).astype(np.uint16)


class Tree:
    """Huffman's code of tokens; leaves are 0 to n - 1 as given, the last is the escape."""

    def __init__(self, counts: np.ndarray):
        n = len(counts)
        order = np.argsort(counts, kind="stable")
        weight = np.concatenate((counts[order], np.zeros(max(n - 1, 0), np.int64))).tolist()
        parent, i, j = [0] * (2 * n - 1), 0, n
        for new in range(n, 2 * n - 1):
            two = []
            for _ in range(2):
                if i < n and (j >= new or weight[i] <= weight[j]):
                    two.append(i)
                    i += 1
                else:
                    two.append(j)
                    j += 1
            weight[new] = weight[two[0]] + weight[two[1]]
            parent[two[0]], parent[two[1]] = new, -new  # the second is side one
        p = np.array(parent, np.int64)
        name = np.concatenate((order, np.arange(n, 2 * n - 1)))  # sorted place -> leaf or inner node
        self.parent, self.side = np.zeros(2 * n - 1, np.int32), np.zeros(2 * n - 1, np.uint8)
        self.parent[name], self.side[name] = np.abs(p), p < 0
        self.root, self.leaves = 2 * n - 2, n
        depth = np.zeros(2 * n - 1, np.uint8)
        for step in range(1, 256):  # down from the root, a level at a time
            below = (depth[self.parent] == step - 1) & ((self.parent == self.root) if step == 1 else depth[self.parent] > 0)
            below[self.root] = False
            if not below.any():
                break
            depth[below] = step
        self.depth = depth[:n]
        total, ones = np.array(weight, float), np.zeros(2 * n - 1)
        np.add.at(ones, np.abs(p[p < 0]), total[p < 0])
        self.level = level_of((ones + 0.4) / (total + 0.8))


def flat_ids(ids: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids of several texts one after another, each after three that no token has; places of tokens in them)."""
    n = np.diff(off)
    at = np.arange(len(ids)) + LEAD * (np.repeat(np.arange(len(n)), n) + 1)
    flat = np.full(len(ids) + LEAD * len(n), 0xFFFFFFFF, W)
    flat[at] = ids.astype(W)
    return flat, at


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> W(16))) * W(0x7FEB352D)
    x = (x ^ (x >> W(15))) * W(0x846CA68B)
    return x ^ (x >> W(16))


def contexts(flat: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    """Hashes of the one, two and three tokens before each place."""
    one = mixed(flat[at - 1] + W(1))
    two = mixed(one * _C1 + flat[at - 2] + W(2))
    return [one, two, mixed(two * _C1 + flat[at - 3] + W(3))]


def slots_of(own: list[np.ndarray], node: np.ndarray, bits: int) -> list[np.ndarray]:
    """The decisions' slots in each context's table."""
    step, out = node.astype(W) * _C1, []
    for h in own:
        x = h ^ step
        x *= _C2
        x >>= W(32 - bits)
        out.append(x)
    return out


def tree_decisions(tree: Tree, ids: np.ndarray, off: np.ndarray):
    """(tokens, context hashes, nodes, bits) of the texts' decisions, a step towards the root of some tokens at a time.
    Tokens of deeper leaves come first, so that those still on their way are always the first ones."""
    if tree.leaves == 1:
        return
    flat, at = flat_ids(ids, off)
    for a in range(0, len(at), SLICE):
        here = at[a : a + SLICE]
        now = np.minimum(flat[here], W(tree.leaves - 1)).astype(np.int64)
        depth = tree.depth[now]
        order = np.argsort(255 - depth, kind="stable")
        token, now, own = a + order, now[order], contexts(flat, here[order])
        for left in (len(depth) - np.cumsum(np.bincount(depth)))[:-1].tolist():
            now = now[:left]
            node = tree.parent.take(now)
            yield token[:left], [h[:left] for h in own], node, tree.side.take(now)
            now = node


def spelt_bytes(words: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(word, byte, context hashes) of the bytes of words, each word with its stop."""
    n = np.diff(off)
    at = np.arange(len(words)) + (LEAD + 1) * np.repeat(np.arange(len(n)), n) + LEAD
    flat = np.zeros(len(words) + (LEAD + 1) * len(n), np.uint8)
    flat[at] = words
    begin = off[:-1] + (LEAD + 1) * np.arange(len(n)) + LEAD
    flat[begin + n] = STOP
    word = np.repeat(np.arange(len(n)), n + 1)
    depth = np.arange(len(word)) - np.repeat(off[:-1] + np.arange(len(n)), n + 1)
    place = begin[word] + depth
    byte = flat[place]
    total = np.concatenate((np.zeros(1, U), np.cumsum(_BYTE[byte] * _POW[depth % BLOCK], dtype=U)))
    first = np.repeat(off[:-1] + np.arange(len(n)), n + 1)
    beginning = total[:-1] - total[first]
    one = flat[place - 1].astype(W)
    two = one | (flat[place - 2].astype(W) << W(8))
    three = two | (flat[place - 3].astype(W) << W(16))
    return word, byte, [mixed(one + W(11)), mixed(two + W(1 << 25)), mixed(three + W(1 << 26)), mixed((beginning >> U(32)).astype(W) ^ beginning.astype(W))]


def spelt_decisions(words: np.ndarray, off: np.ndarray):
    """(words, context hashes, nodes, bits) of the decisions of spelled words."""
    word, byte, own = spelt_bytes(words, off)
    for a in range(0, len(word), SLICE):
        w, b, h = word[a : a + SLICE], byte[a : a + SLICE].astype(W), [x[a : a + SLICE] for x in own]
        for k in range(8):
            yield w, h, W(1 << k) | (b >> W(8 - k)), ((b >> W(7 - k)) & W(1)).astype(np.uint8)


def decisions(tree: Tree, ids, off, words, woff, bits: int):
    """(kind, owner, slots by table, node, bit) of all decisions; kind 0 is the tree's, 1 spelling's."""
    for owner, own, node, bit in tree_decisions(tree, ids, off):
        yield 0, owner, slots_of(own, node, bits), node, bit
    for owner, own, node, bit in spelt_decisions(words, woff):
        yield 1, owner, slots_of(own, node, SPELL_BITS), node, bit


def count_into(total: list[np.ndarray], tree: Tree, ids, off, words, woff, bits: int) -> None:
    for kind, _, slots, _, bit in decisions(tree, ids, off, words, woff, bits):
        for o, s in enumerate(slots):
            np.add.at(total[3 * kind + o], (s << W(1)) | bit, W(1))


def as_seen(tables: list[np.ndarray]) -> list[np.ndarray]:
    """The slots' states."""
    return [STATE[x] for x in tables]


def left_out(tables: list[np.ndarray]) -> list[np.ndarray]:
    """The slots' states by slot and bit, a decision of that bit left out of its own counts."""
    return [np.stack([side[x] for side in LEFT_OUT], axis=1).ravel() for x in tables]


def cells(states: list[np.ndarray], tree: Tree, kind: int, slots: list[np.ndarray], node: np.ndarray, bit: np.ndarray | None) -> np.ndarray:
    """The decisions' cells by as_seen's states or, with their bits, left_out's."""
    out = tree.level.take(node).astype(np.int32) if kind == 0 else None
    for o, s in enumerate(slots):
        state = states[3 * kind + o].take(s if bit is None else (s << W(1)) | bit)
        if out is None:
            out = state.astype(np.int32)
        else:
            out *= STATES
            out += state
    return out


def histogram(total: np.ndarray, states, tree, ids, off, words, woff, bits: int) -> None:
    """Adds the decisions to total (2 kinds, CELLS, 2); states: left_out's."""
    for kind, _, slots, node, bit in decisions(tree, ids, off, words, woff, bits):
        np.add.at(total[kind].reshape(-1), cells(states, tree, kind, slots, node, bit) * 2 + bit, W(1))


def squash(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -16, 16)))


def learn(seen: np.ndarray, batch: int = 8192, keep: float = 8.0) -> np.ndarray:
    """seen (CELLS, 2) -> the probability of a one in each cell: gated weights by online Newton steps over blocks of
    cells, then each cell refined by how it came true."""
    n = seen.sum(1).astype(float)
    used = np.flatnonzero(n)
    state = np.stack([np.arange(CELLS) // STATES ** (PREDICTORS - 1 - o) % STATES for o in range(PREDICTORS)])
    x = np.empty((INPUTS, CELLS))
    for o in range(PREDICTORS):  # a state's log odds, as it came true
        ones, every = (np.bincount(state[o][used], v[used], STATES) for v in (seen[:, 1].astype(float), n))
        x[o] = np.log((ones + 0.4) / (every - ones + 0.4))[state[o]]
    x[-1] = 0.3
    gate = (state[1] // ODDS) * SURE + state[2] // ODDS
    w = np.full((GATES, INPUTS), 0.3)
    w[:, -1] = 0
    curve, weight = np.tile(np.eye(INPUTS) * 0.5, (GATES, 1, 1)), np.zeros(GATES)
    order = used[np.argsort((used * 0x9E3779B1) & 0xFFFFFFFF, kind="stable")]
    for _ in range(4):
        for a in range(0, len(order), batch):
            c = order[a : a + batch]
            for g in np.unique(gate[c]).tolist():
                i = c[gate[c] == g]
                m, p = n[i], squash(w[g] @ x[:, i])
                weight[g] += m.sum()
                rate = m.sum() / weight[g]
                curve[g] = (1 - rate) * curve[g] + rate * ((x[:, i] * (m * np.maximum(p * (1 - p), 1e-4) / m.sum())) @ x[:, i].T + np.eye(INPUTS) * 1e-4)
                step = np.linalg.solve(curve[g], x[:, i] @ ((seen[i, 1] - m * p) / m.sum()))
                w[g] += rate * step / max(1.0, np.abs(step).max() / 0.5)
    p = np.empty(CELLS)
    for g in range(GATES):
        own = gate == g
        p[own] = squash(w[g] @ x[:, own])
    return np.clip((seen[:, 1] + keep * p) / (n + keep), 1e-6, 1 - 1e-6)


def text_scores(logs: np.ndarray, states, tree, ids, off, words, woff, owner: np.ndarray, bits: int) -> np.ndarray:
    """log10 probabilities of texts; logs (2 kinds, CELLS * 2), states: as_seen's, owner: each spelled word's text."""
    token, word = np.zeros(len(ids)), np.zeros(len(woff) - 1)
    for kind, own, slots, node, bit in decisions(tree, ids, off, words, woff, bits):
        lp = logs[kind].take(cells(states, tree, kind, slots, node, None) * 2 + bit)
        if kind == 0:
            token[own] += lp
        else:
            word += np.bincount(own, lp, len(word))
    text = np.repeat(np.arange(len(off) - 1), np.diff(off))
    return np.bincount(text, token, len(off) - 1) + np.bincount(owner, word, len(off) - 1)
