"""Token counts by a transducer compiled from a merge-type vocabulary.

Merging by score has two properties that make it finite-state: a run of tokens
of a text is itself what its characters merge to, and tokens stand side by side
exactly where each two neighbours do. So the last token of every prefix of a
text is the one token that ends there and fits the last token before it, and
the number of tokens changes with each character by an amount that depends only
on the tokens that may still grow. A state of the transducer holds those: for
every place from which a piece may still be completed, the node of the piece
trie reached, the token that ends at the place, and how many tokens lie between
the place and the end. Each transition carries the change of the token count;
what a text emits in all is its number of tokens. States and transitions are compiled
when a text first needs them and kept, in tables that numpy reads for many
characters at once.

Texts are cut into chunks of ``CHUNK`` characters that run side by side. A chunk
maps the state in which it begins to the state in which it ends and a count.
It is run from the starting state first, then from every state in which the
chunk before it may end, until no new state appears; after a space, and mostly
after a few letters, the runs meet and the rest is shared. Pointer doubling over
the chunks of a text (a parallel prefix scan of the maps) gives its total.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from shopflow.llm.bytewords import text_slices

MARK = "▁"
CHUNK = 512
#: Texts of more bytes run through in windows of this size.
WINDOW_BYTES = 1 << 20
#: Transitions held by a worker; beyond it the tables start anew with the next window.
MOST_TRANSITIONS = 1_000_000
#: A place from which at most this many pieces can still be completed is checked against each.
FEW = 16
START = 0
HASH = 0x9E3779B97F4A7C15


class Transducer:
    """Compiled on demand from a sentencepiece model file with byte fallback."""

    def __init__(self, path: str, most: int = MOST_TRANSITIONS):
        import sentencepiece
        lib = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(lib.vocab_size())
        normal = [i for i in ids if not (lib.is_control(i) or lib.is_unknown(i) or lib.is_byte(i))]
        if sum(lib.is_byte(i) for i in ids) != 256:
            raise ValueError("the model has no byte fallback")
        self.score = {lib.id_to_piece(i): lib.get_score(i) for i in normal}
        chars = sorted({c for p in self.score for c in p})
        # classes: unknown characters by their bytes (each byte is a token), then known ones
        self.class_of = np.full(0x110000, 2, np.int32)
        self.class_of[:0x80], self.class_of[0x80:0x800], self.class_of[0x10000:] = 0, 1, 3
        self.char_of = [None] * 4 + chars
        for k, c in enumerate(chars, 4):
            self.class_of[ord(c)] = k
        self.class_of[0x20] = self.class_of[ord(MARK)]
        self.weight = {p: 1 for p in self.score} | {c: len(c.encode()) for c in chars if c not in self.score}
        self.inside = {p[k:k + 2] for p in self.score for k in range(len(p) - 1)}
        self.child: dict[tuple[int, str], int] = {}
        self.token: list[str | None] = [None]
        self.grows = [False]
        for piece in self.weight:
            node = 0
            for c in piece:
                if (node, c) not in self.child:
                    self.child[node, c] = len(self.token)
                    self.grows[node] = True
                    self.token.append(None)
                    self.grows.append(False)
                node = self.child[node, c]
            self.token[node] = piece
        self.history: dict[str, list | None] = {}
        self.below: list[list[str] | None] = [[] for _ in self.token]
        for piece in self.weight:
            node = 0
            for c in piece[:-1]:
                node = self.child[node, c]
                if self.below[node] is not None and self.merges(piece):
                    self.below[node] = [*self.below[node], piece] if len(self.below[node]) < FEW else None
        self.most, self.bits = most, max(16, (2 * most - 1).bit_length())
        self.reset()

    # compiling ---------------------------------------------------------------------
    def reset(self) -> None:
        """Drop all states and transitions."""
        self.fit: dict[tuple[str, str], bool] = {}
        self.states: list[tuple] = [((), None)]  # of each: places that may grow, last token
        self.number = {self.states[0]: START}
        #: Slots of (state and class, next state and change), found by hash and the slots after it.
        self.table = np.full((1 << self.bits, 2), -1, np.int64)
        self.held = 0

    def merges(self, piece: str) -> list[tuple[float, str, str]] | None:
        """(score of the next merge, first part, last part) after each merge of a token's characters, None if other tokens result.

        The adjacent pair of the best score merges first, the leftmost of equals.
        """
        if piece not in self.history:
            parts, score, steps = list(piece), self.score, []
            while True:
                best, at = -np.inf, -1
                for k in range(len(parts) - 1):
                    s = score.get(parts[k] + parts[k + 1], -np.inf)
                    if s > best:
                        best, at = s, k
                steps.append((best, parts[0], parts[-1]))
                if at < 0:
                    break
                parts[at:at + 2] = [parts[at] + parts[at + 1]]
            self.history[piece] = steps if len(parts) == 1 else None
        return self.history[piece]

    def fits(self, left: str | None, right: str) -> bool:
        """Whether two tokens stand side by side in the merged form of their characters.

        Both sides merge by themselves, the better score first, unless at some
        time a merge across them is the best (on the left of equals in ``right``).
        """
        if left is None or left[-1] + right[0] not in self.inside:
            return True
        known = self.fit.get((left, right))
        if known is None:
            ours, theirs, score, i, j = self.merges(left), self.merges(right), self.score, 0, 0
            while True:
                a, _, end = ours[i]
                b, begin, _ = theirs[j]
                across = score.get(end + begin)
                if across is not None and across > a and across >= b:
                    known = False
                    break
                if a == b == -np.inf:
                    known = True
                    break
                if a >= b:
                    i += 1
                else:
                    j += 1
            self.fit[left, right] = known
        return known

    def transition(self, state: int, kind: int) -> tuple[int, int]:
        """(state, change of the token count) after one more character of class ``kind``."""
        if kind < 4:
            return START, kind + 1
        c = self.char_of[kind]
        places, last = self.states[state]
        if last is not None and last[-1] + c not in self.inside:
            places, last = (), None  # no piece spans the two: what comes before is settled
        found, grown = None, []
        for node, before, tokens in (*places, (0, last, 0)):
            node = self.child.get((node, c))
            if node is None:
                continue
            piece = self.token[node]
            if found is None and piece is not None and self.merges(piece) and self.fits(before, piece):
                found, change = piece, tokens + self.weight[piece]
            below = self.below[node]
            if below is not None and before is not None:  # few: see which can still come
                fit = sum(self.fits(before, piece) for piece in below)
                if not fit:
                    continue
                before = before if fit < len(below) else None
            if below is None or below:
                grown.append((node, before, tokens))
        key = (tuple((node, before, tokens - change) for node, before, tokens in grown), found)
        if key not in self.number:
            self.number[key] = len(self.states)
            self.states.append(key)
        return self.number[key], change

    def _slots(self, key: np.ndarray) -> np.ndarray:
        return ((key.view(np.uint64) * np.uint64(HASH)) >> np.uint64(64 - self.bits)).view(np.int64)

    def step(self, state: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Next states and changes of many (state, class) pairs."""
        key = state * len(self.char_of) + kind
        at = self._slots(key)
        slot = self.table.take(at, axis=0)
        wrong = np.flatnonzero(slot[:, 0] != key)
        while len(wrong):
            held = slot[wrong, 0]
            fresh, moved = wrong[held == -1], wrong[held != -1]
            if len(fresh):
                for k in set(key[fresh].tolist()):
                    self._add(k)
                at[fresh] = self._slots(key[fresh])  # look again from the first slot
            at[moved] = (at[moved] + 1) & (len(self.table) - 1)
            slot[wrong] = self.table[at[wrong]]
            wrong = wrong[slot[wrong, 0] != key[wrong]]
        value = slot[:, 1]
        return value >> 8, (value & 0xFF) - 128

    def _add(self, key: int) -> None:
        at = (key * HASH & (1 << 64) - 1) >> 64 - self.bits
        taken = self.table.item(at, 0)
        while taken != -1:
            if taken == key:
                return
            at = (at + 1) & (len(self.table) - 1)
            taken = self.table.item(at, 0)
        if 8 * self.held > 7 * len(self.table):
            raise MemoryError("the transducer's table is full within one window")
        state, change = self.transition(*divmod(key, len(self.char_of)))
        self.table[at] = key, state << 8 | change + 128
        self.held += 1

    # running -----------------------------------------------------------------------
    def chunk_maps(self, kinds: np.ndarray, start: np.ndarray, size: np.ndarray, entry: np.ndarray, first: np.ndarray):
        """Rows (chunk, entry state, exit state, count) of every chunk map, on all states that may occur.

        ``first`` marks chunks that begin a text, entered in ``entry`` only; a
        later chunk may be entered in any state in which the one before it ends.
        """
        n = len(start)
        order = np.argsort(-size, kind="stable")
        state, total = entry[order], np.zeros(n, np.int64)
        begin, lengths = start[order], -size[order]
        trace, so_far = np.zeros(len(kinds), np.int32), np.zeros(len(kinds), np.int16)
        for t, a in enumerate(np.searchsorted(lengths, -np.arange(int(size.max(initial=0)))).tolist()):
            at = begin[:a] + t
            state[:a], change = self.step(state[:a], kinds.take(at))
            total[:a] += change
            trace[at], so_far[at] = state[:a], total[:a]
        exit_, count = np.empty(n, np.int64), np.empty(n, np.int64)
        exit_[order], count[order] = state, total
        rows = [np.stack([np.arange(n), entry, exit_, count], axis=1)]
        known = set(zip(range(n), entry.tolist()))
        new = rows[0]
        while True:
            after = new[new[:, 0] + 1 < n]
            after = after[~first[after[:, 0] + 1]]
            todo = sorted({(k + 1, s) for k, s in after[:, [0, 2]].tolist()} - known)
            if not todo:
                return np.concatenate(rows)
            known.update(todo)
            chunk, begun = (np.array(x) for x in zip(*todo))
            state, total = begun.copy(), np.zeros(len(chunk), np.int64)
            end, live, t = np.zeros((len(chunk), 2), np.int64), np.arange(len(chunk)), 0
            while len(live):
                at = start[chunk[live]] + t
                state[live], change = self.step(state[live], kinds[at])
                total[live] += change
                t += 1
                met = state[live] == trace[at]
                done = met | (size[chunk[live]] == t)
                own = live[done]
                end[own, 0] = np.where(met[done], exit_[chunk[own]], state[own])
                end[own, 1] = total[own] + np.where(met[done], count[chunk[own]] - so_far[at[done]], 0)
                live = live[~done]
            new = np.column_stack([chunk, begun, end])
            rows.append(new)

    def totals(self, kinds: np.ndarray, offsets: np.ndarray, entry: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(token count, exit state) of each text, given as runs of classes, entered in ``entry``."""
        length = np.diff(offsets)
        pieces = np.maximum(1, -(-length // CHUNK))
        text = np.repeat(np.arange(len(length)), pieces)
        opening = np.cumsum(pieces) - pieces
        begin = (np.arange(len(text)) - opening[text]) * CHUNK
        first = begin == 0
        rows = self.chunk_maps(kinds, offsets[text] + begin, np.minimum(CHUNK, length[text] - begin),
                               np.where(first, entry[text], START), first)
        rows = rows[np.lexsort((rows[:, 1], rows[:, 0]))]
        key = rows[:, 0] << 32 | rows[:, 1]
        ends = np.append(first[1:], True)[rows[:, 0]]
        here = np.arange(len(rows))
        follow = np.where(ends, here, np.searchsorted(key, (rows[:, 0] + 1) << 32 | rows[:, 2]))
        count = np.where(ends, 0, rows[:, 3])
        for _ in range(int(pieces.max(initial=1)).bit_length()):  # maps of 1, 2, 4, ... chunks
            count, follow = count + count[follow], follow[follow]
        top = np.searchsorted(key, opening << 32 | entry)
        return count[top] + rows[follow[top], 3], rows[follow[top], 2]

    def count(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Token counts of texts given as UTF-8 bytes with offsets; any length, in windows."""
        out = np.zeros(len(offsets) - 1, np.int64)
        if offsets[-1] - offsets[0] <= WINDOW_BYTES:
            kinds, ends = self._classes(data, offsets, np.diff(offsets) > 0)
            return self.totals(kinds, ends, np.zeros(len(out), np.int64))[0]
        for k, (lo, hi) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
            state, at = START, lo
            while at < hi:
                end = min(at + WINDOW_BYTES, hi)
                while end < hi and data[end] & 0xC0 == 0x80:
                    end += 1
                kinds, ends = self._classes(data[at:end], np.array([0, end - at]), np.array([at == lo]))
                if self.held > self.most and at == lo:
                    self.reset()
                total, left = self.totals(kinds, ends, np.array([state]))
                out[k] += total[0]
                state, at = int(left[0]), end
        return out

    def _classes(self, data: np.ndarray, offsets: np.ndarray, marked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Character classes of texts, a space mark before each of ``marked``."""
        codes = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
        before = np.zeros(len(data) + 1, np.int64)
        np.cumsum((data & 0xC0) != 0x80, out=before[1:])
        ends = before[offsets]
        kinds = np.insert(self.class_of[codes], ends[:-1][marked], self.class_of[0x20])
        return kinds, ends + np.concatenate([[0], np.cumsum(marked)])


@functools.lru_cache(maxsize=1)
def _machine(path: str) -> Transducer:
    return Transducer(path)


def count_tokens(docs: DataFrame, model_path: str) -> DataFrame:
    """``doc_id, n_bytes, n_tokens`` (long) of every row of ``docs`` (needs ``doc_id`` and ``text``).

    Counts are those of the sentencepiece library without begin or end ids. Null
    texts are empty and have no tokens; repeated rows are counted alike; texts
    of any length run in windows of 1 MB; an empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = _machine(model_path)
        for batch in batches:
            for rows, data, offsets in text_slices(batch, "text"):
                if machine.held > machine.most:
                    machine.reset()
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0), pa.array(np.diff(offsets)), pa.array(machine.count(data, offsets))],
                    ["doc_id", "n_bytes", "n_tokens"])

    schema = docs.select("doc_id").schema.add("n_bytes", "long").add("n_tokens", "long")
    return docs.select("doc_id", "text").mapInArrow(run, schema)
