"""Token counts by a finite-state transducer compiled from a SentencePiece BPE model.

A split of a text into pieces is the model's own split if each two neighbours stay apart when they are encoded alone. So the last piece of
every prefix of a text is known from the last pieces of shorter prefixes, and reading a text is a deterministic automaton: a state holds,
for each suffix that may still grow into a piece, which piece stands before it, and how many tokens that prefix has less than the present one.
A transition is annotated with the tokens that the prefix gains (less than 0 where pieces merge). Transitions are compiled when first met.

Texts are cut into chunks that are read side by side. A chunk's state map (entry state to exit state and tokens) is made for every state in which
the chunk before can end, and the maps are composed by a parallel prefix scan.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import nptext

BLANK = "▁"
#: Symbols of a block of text, and of a chunk of a block.
BLOCK, CHUNK = 1 << 21, 1 << 9
#: States kept by a worker; beyond, the machine starts anew after the block.
STATES = 400_000
#: A suffix with at most so many pieces that it may grow into remembers only which of them the piece before allows.
FEW = 16
_NONE = 1 << 30


def model_pieces(model: bytes) -> list[str]:
    """Pieces of a BPE model file, those that merge first in front; an error if the model needs steps that the transducer does not take."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    m = pb.ModelProto.FromString(model)
    kinds = pb.ModelProto.SentencePiece
    norm, train = m.normalizer_spec, m.trainer_spec
    if train.model_type != pb.TrainerSpec.BPE or not train.byte_fallback or train.treat_whitespace_as_suffix:
        raise ValueError("not a BPE model with byte fallback and white space as prefix")
    if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not (norm.add_dummy_prefix and norm.escape_whitespaces):
        raise ValueError("the model changes texts before it splits them")
    if any(p.type in (kinds.USER_DEFINED, kinds.UNUSED) for p in m.pieces):
        raise ValueError("the model has user-defined or unused pieces")
    return [p.piece for p in sorted((p for p in m.pieces if p.type == kinds.NORMAL), key=lambda p: -p.score)]


class Transducer:
    """States, and transitions in a hash table: key (state and symbol), value (next state and tokens gained)."""

    def __init__(self, pieces: list[str]):
        self.rank = {p: r for r, p in enumerate(pieces)}
        chars = sorted({c for p in pieces for c in p} | {BLANK})
        alone = [c for c in chars if c not in self.rank]  # stands as its bytes
        self.tokens, self.weight, self.right, self.left = [], [], [], []
        self.children: list[dict[str, int]] = [{}]
        self.token_at = [-1]
        for p in [*pieces, *alone]:
            history, whole = self._history(p)
            if not whole:
                continue  # never comes about
            node = 0
            for c in p:
                below = self.children[node].get(c)
                if below is None:
                    below = self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.token_at.append(-1)
                node = below
            self.token_at[node] = len(self.tokens)
            self.tokens.append(p)
            self.weight.append(1 if p in self.rank else len(p.encode()))
            self.left.append([(r, a) for r, a, _ in history])
            self.right.append([(r, b) for r, _, b in history])
        self.grows = self._growth()
        self.joints = {p[i:i + 2] for p in pieces for i in range(len(p) - 1)}
        self.chars = chars
        n = len(chars)
        #: Symbols: characters of pieces, others by their number of bytes, start of a text, filling.
        self.start, self.fill, self.symbols = n + 4, n + 5, n + 6
        self.symbol = np.full(0x110000, n + 3, np.int64)
        for size, stop in ((3, 0x10000), (2, 0x800), (1, 0x80)):
            self.symbol[:stop] = n + size - 1
        self.symbol[[ord(c) for c in chars]] = np.arange(n)
        self.symbol[ord(" ")] = self.symbol[ord(BLANK)]
        self.apart: dict[int, bool] = {}
        self.classes: dict[tuple[int, int], int] = {}
        self.reset()

    def _history(self, text: str) -> tuple[list[tuple[int, str, str]], bool]:
        """Merges of ``text`` in their order, with the first and the last symbol after each; and whether one symbol is left."""
        rank = self.rank
        n, ends, out = len(text), list(range(1, len(text) + 1)), []
        agenda = [rank.get(text[i:i + 2], _NONE) for i in range(n - 1)]
        while agenda and (best := min(agenda)) != _NONE:
            j = agenda.index(best)
            del ends[j], agenda[j]
            if j < len(agenda):
                agenda[j] = rank.get(text[ends[j - 1] if j else 0:ends[j + 1]], _NONE)
            if j:
                agenda[j - 1] = rank.get(text[ends[j - 2] if j > 1 else 0:ends[j]], _NONE)
            out.append((best, text[:ends[0]], text[ends[-2] if len(ends) > 1 else 0:]))
        return out, len(ends) == 1

    def _growth(self) -> list[list[int]]:
        """Tokens below each node of the trie (more than ``FEW``: the first ones)."""
        grows: list[list[int]] = [[] for _ in self.children]
        for node in range(len(self.children) - 1, -1, -1):  # children come after their parents
            for below in self.children[node].values():
                if self.token_at[below] >= 0:
                    grows[node].append(self.token_at[below])
                grows[node] += grows[below]
            del grows[node][FEW + 1:]
        return grows

    def stay_apart(self, a: int, b: int) -> bool:
        """Whether the tokens ``a`` and ``b``, one after the other, are encoded as these two. Both histories run in the order of the ranks
        (on ties left first) until a merge across the border comes first."""
        if a < 0:
            return True
        key = a << 32 | b
        known = self.apart.get(key)
        if known is None:
            known = self.apart[key] = self._stay_apart(a, b)
        return known

    def _stay_apart(self, a: int, b: int) -> bool:
        get, right, left = self.rank.get, self.right[a], self.left[b]
        x, y, i, j = self.tokens[a][-1], self.tokens[b][0], 0, 0
        across = get(x + y, _NONE)
        while True:
            p = right[i][0] if i < len(right) else _NONE
            q = left[j][0] if j < len(left) else _NONE
            if across < p and across <= q:
                return False
            if p == q == _NONE:
                return True
            if p <= q:
                x, i = right[i][1], i + 1
            else:
                y, j = left[j][1], j + 1
            across = get(x + y, _NONE)

    def _class(self, node: int, before: int) -> int:
        """What the token before a suffix means for it: -1: allows all its growth, -2: none, else a token that stands for all of the same meaning."""
        few = self.grows[node]
        if before < 0 or len(few) > FEW:
            return before
        known = self.classes.get((node, before))
        if known is None:
            mask = sum(1 << i for i, t in enumerate(few) if self.stay_apart(before, t))
            known = -2 if mask == 0 else -1 if mask + 1 == 1 << len(few) else self.stands_for.setdefault((node, mask), before)
            self.classes[node, before] = known
        return known

    def reset(self, keep: tuple[int, ...] | None = None) -> int:
        """Forget all states but the first one (nothing before) and ``keep``, whose new number is returned."""
        self.apart.clear()
        self.classes.clear()
        self.stands_for: dict[tuple[int, int], int] = {}
        self.keys = [((0 << 32 | 1) << 16 | 1 << 15,)]
        self.number = {self.keys[0]: 0}
        self.table = np.full((1 << 16, 2), -1, np.int64)
        self.used = 0
        first, gain = self.step(0, BLANK)
        n = len(self.chars)
        self.fixed = np.full(self.symbols, -1, np.int64)  # where a symbol leads from any state, and what it gains
        self.fixed[n:] = 0
        self.fixed[self.start] = first
        self.gain = np.zeros(self.symbols, np.int64)
        self.gain[n:n + 4] = [1, 2, 3, 4]
        self.gain[self.start] = gain
        return 0 if keep is None else self._state(keep)

    def _state(self, key: tuple[int, ...]) -> int:
        got = self.number.get(key)
        if got is None:
            got = self.number[key] = len(self.keys)
            self.keys.append(key)
        return got

    def step(self, state: int, char: str) -> tuple[int, int]:
        """Next state and tokens gained. A state's members are (node, token before + 1, tokens relative to the whole prefix)."""
        grown, found = [], None
        for packed in self.keys[state]:
            relative, rest = (packed & 0xFFFF) - (1 << 15), packed >> 16
            before, node = (rest & 0xFFFFFFFF) - 2, rest >> 32
            if not node and before >= 0 and self.tokens[before][-1] + char not in self.joints:
                before = -1  # no piece has these two characters side by side: nothing merges across
            node = self.children[node].get(char)
            if node is None:
                continue
            token = self.token_at[node]
            if token >= 0 and found is None and self.stay_apart(before, token):
                found = token, relative + self.weight[token]
            if self.grows[node]:
                before = self._class(node, before)
                if before != -2:
                    grown.append((node, before, relative))
        token, gained = found
        key = [(n << 32 | b + 2) << 16 | (r - gained + (1 << 15)) for n, b, r in grown]
        return self._state((*key, (0 << 32 | token + 2) << 16 | 1 << 15)), gained

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        bits = int(self.table.shape[0]).bit_length() - 1
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - bits)).astype(np.int64)

    def _insert(self, keys: np.ndarray, values: np.ndarray) -> None:
        if (self.used + keys.size) * 4 > self.table.shape[0]:
            old = self.table[self.table[:, 0] >= 0]
            self.table = np.full((self.table.shape[0] * 4, 2), -1, np.int64)
            self.used = 0
            self._insert(old[:, 0], old[:, 1])
        self.used += keys.size
        slots, mask = self._slots(keys), self.table.shape[0] - 1
        if keys.size < 32:
            taken = self.table[:, 0]
            for key, value, slot in zip(keys.tolist(), values.tolist(), slots.tolist()):
                while taken[slot] >= 0:
                    slot = slot + 1 & mask
                self.table[slot] = key, value
            return
        while keys.size:
            _, first = np.unique(slots, return_index=True)
            ok = np.zeros(keys.size, bool)
            ok[first] = self.table[slots[first], 0] < 0
            self.table[slots[ok]] = np.stack([keys[ok], values[ok]], axis=1)
            keys, values, slots = keys[~ok], values[~ok], (slots[~ok] + 1) & mask

    def move(self, states: np.ndarray, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Next states and tokens gained of many (state, symbol)."""
        keys = states * self.symbols + symbols
        rows = self.table[self._slots(keys)]
        bad = np.flatnonzero(rows[:, 0] != keys)
        if bad.size:
            fixed = self.fixed[symbols[bad]]
            easy = fixed >= 0
            rows[bad[easy], 1] = fixed[easy] << 16 | self.gain[symbols[bad[easy]]] + (1 << 15)
            bad = bad[~easy]
            if bad.size:
                rows[bad, 1] = self._search(keys[bad])
        return rows[:, 1] >> 16, (rows[:, 1] & 0xFFFF) - (1 << 15)

    def _search(self, keys: np.ndarray) -> np.ndarray:
        """Values of keys that are not in their first slot; those not known yet are compiled."""
        out = np.full(keys.size, -1, np.int64)
        left, slots, mask = np.arange(keys.size), self._slots(keys), self.table.shape[0] - 1
        while left.size:
            rows = self.table[slots]
            hit = rows[:, 0] == keys[left]
            out[left[hit]] = rows[hit, 1]
            go = ~hit & (rows[:, 0] >= 0)
            left, slots = left[go], (slots[go] + 1) & mask
        new = np.flatnonzero(out < 0)
        if new.size:
            values: dict[int, int] = {}
            wanted = keys[new].tolist()
            for key in wanted:
                if key not in values:
                    state, gained = self.step(key // self.symbols, self.chars[key % self.symbols])
                    values[key] = state << 16 | gained + (1 << 15)
            self._insert(np.fromiter(values, np.int64), np.fromiter(values.values(), np.int64))
            out[new] = [values[key] for key in wanted]
        return out

    def gains(self, symbols: np.ndarray, entry: int) -> tuple[np.ndarray, int]:
        """Tokens gained by every symbol of a block that is entered in state ``entry``, and the state in which it is left."""
        size = min(CHUNK, max(symbols.size, 1))
        n = -(-symbols.size // size)
        filled = np.full(n * size, self.fill, np.int64)
        filled[:symbols.size] = symbols
        grid = np.ascontiguousarray(filled.reshape(n, size).T)
        maps = StateMaps(self, grid, entry)
        return maps.chosen().T.ravel()[:symbols.size], maps.exit


class StateMaps:
    """State maps of the chunks (columns of ``grid``): rows of ``starts``, ``ends`` and ``totals`` are entries of the maps, -1 where there is none."""

    def __init__(self, machine: Transducer, grid: np.ndarray, entry: int):
        size, n = grid.shape
        state = np.zeros(n, np.int64)
        state[0] = entry
        self.starts, self.runs = [state], []
        path, gained = np.empty((size, n), np.int32), np.empty((size, n), np.int32)
        for j in range(size):
            state, gained[j] = machine.move(state, grid[j])
            path[j] = state
        self.gained = gained
        sums = np.cumsum(gained, axis=0)
        self.ends, self.totals = [state], [sums[-1].astype(np.int64)]
        while True:  # as long as a chunk can end in a state that the next one's map has no entry for
            wanted = self._wanted()
            lanes = np.flatnonzero(wanted >= 0)
            if not lanes.size:
                break
            ends, totals = np.full(n, -1, np.int64), np.zeros(n, np.int64)
            steps, stop = [], np.full(lanes.size, size)
            live, state = np.arange(lanes.size), wanted[lanes]
            for j in range(size):
                state, gain = machine.move(state, grid[j, lanes[live]])
                row = np.zeros(lanes.size, np.int32)
                row[live] = gain
                steps.append(row)
                totals[lanes[live]] += gain
                met = state == path[j, lanes[live]]  # from here on as the first entry
                at = lanes[live[met]]
                totals[at] += self.totals[0][at] - sums[j, at]
                ends[at] = self.ends[0][at]
                stop[live[met]] = j + 1
                live, state = live[~met], state[~met]
                if not live.size:
                    break
            ends[lanes[live]] = state
            self.starts.append(wanted)
            self.ends.append(ends)
            self.totals.append(totals)
            self.runs.append((lanes, np.array(steps), stop))
        self._compose()

    def _wanted(self) -> np.ndarray:
        """For each chunk an end of the chunk before that its own map lacks, or -1."""
        out = np.full(self.starts[0].size, -1, np.int64)
        for ends in self.ends:
            came = ends[:-1]
            lacks = came >= 0
            for starts in self.starts:
                lacks &= starts[1:] != came
            out[1:][lacks & (out[1:] < 0)] = came[lacks & (out[1:] < 0)]
        return out

    def _compose(self) -> None:
        """Prefix scan: ``into[k]`` becomes the entry of chunk k + 1's map that is reached from the entries of the first chunk's."""
        starts, ends, totals = (np.stack(x, axis=1) for x in (self.starts, self.ends, self.totals))
        n, width = starts.shape
        into = np.zeros((n, width), np.int64)
        for m in range(width):
            into[:-1, m] = (starts[1:] == ends[:-1, m, None]).argmax(axis=1)
        into[-1] = np.arange(width)
        self.sums = totals
        step = 1
        while step < n:
            through = into[:-step]
            later, more = into.copy(), self.sums.copy()
            later[step:] = np.take_along_axis(into[step:], through, axis=1)
            more[step:] = self.sums[:-step] + np.take_along_axis(self.sums[step:], through, axis=1)
            into, self.sums = later, more
            step *= 2
        self.entry = np.concatenate([[0], into[:-1, 0]])  # entry of each chunk's map that counts
        self.exit = int(ends[-1, self.entry[-1]])

    def chosen(self) -> np.ndarray:
        """Tokens gained at every place of the grid along the entries that count."""
        out = self.gained
        for m, (lanes, steps, stop) in enumerate(self.runs, 1):
            own = np.flatnonzero(self.entry[lanes] == m)
            place = np.arange(steps.shape[0])[:, None] < stop[own]
            row, col = np.nonzero(place)
            out[row, lanes[own[col]]] = steps[row, own[col]]
        return out


def count(machine: Transducer, texts: list[str | None]) -> np.ndarray:
    """Tokens of each text (null: 0)."""
    sizes = np.array([len(t) if t else 0 for t in texts], np.int64)
    code = np.frombuffer("".join(t for t in texts if t).encode("utf-32-le", "surrogatepass"), np.uint32)
    doc = np.flatnonzero(sizes)
    begin = np.cumsum(sizes[doc] + 1) - sizes[doc] - 1
    total = code.size + doc.size
    place = np.ones(total, bool)
    place[begin] = False
    symbols = np.full(total, machine.start, np.int64)
    symbols[place] = machine.symbol[code]
    out, state = np.zeros(sizes.size, np.int64), 0
    block = max(BLOCK // CHUNK, 1) * CHUNK  # whole chunks, so that only the last block is filled up
    for a in range(0, total, block):
        gained, state = machine.gains(symbols[a:a + block], state)
        sums = np.concatenate([[0], np.cumsum(gained)])
        lo = np.clip(begin - a, 0, gained.size)
        hi = np.clip(begin + sizes[doc] + 1 - a, 0, gained.size)
        out[doc] += sums[hi] - sums[lo]
        if len(machine.keys) > STATES:
            state = machine.reset(machine.keys[state])
    return out


_MACHINES: dict[int, Transducer] = {}


def count_tokens(docs: DataFrame, model: bytes, limit: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: its id, ``n_bytes`` (UTF-8), ``n_tokens`` and ``over_limit`` (more than ``limit`` tokens).

    Tokens are those that the SentencePiece library gives for the whole text, without begin and end. A null text counts as empty, which
    has no tokens. Repeated rows come out as often as they stand there, a null id stays null; other columns are not looked at. A task holds one
    batch of rows and at most ``STATES`` states and those of one block, whatever the length of a text.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model_pieces(model))
    name = zlib.crc32(model)

    def work(batches):
        if name not in _MACHINES:
            _MACHINES.clear()
            _MACHINES[name] = Transducer(shared.value)
        for batch in batches:
            _, offsets = nptext.arrow_bytes(batch.column(1))
            for i, j in nptext.blocks(offsets, BLOCK):
                n = count(_MACHINES[name], batch.column(1).slice(i, j - i).to_pylist())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(np.diff(offsets[i:j + 1])), pa.array(n), pa.array(n > limit)],
                                                 names=[doc_id, "n_bytes", "n_tokens", "over_limit"])

    rows = docs.select(F.col(doc_id).cast("long").alias(doc_id), F.col(text).alias(text))
    return rows.mapInArrow(work, f"`{doc_id}` long, n_bytes long, n_tokens long, over_limit boolean")
