"""SentencePiece encoding and decoding for merge-type (BPE) vocabularies.

Encoding keeps an agenda of adjacent symbol pairs, ordered by the score of the
piece they would form (leftmost first on ties), and merges the best pair until
none is left. No piece of such a vocabulary has a space mark after another
character, so no merge crosses a space and each distinct word of a batch is
segmented once: words of common lengths side by side in numpy, one merge per
word and step, longer ones with a heap. Every word new to a worker is checked
against the sentencepiece library, batch by batch.
"""

from __future__ import annotations

import functools
import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, IntegerType, StringType

from shopflow.llm.bytewords import text_slices
from shopflow.llm.word_cache import WordCache, laid_out

MARK = "▁"
UNKNOWN_SURFACE = " ⁇ "
MATRIX_LENGTH = 48
MATRIX_ROWS = 4096
_NONE = np.float32(-np.inf)


class PieceModel:
    """Vocabulary of a sentencepiece model file, its merges and its byte pieces."""

    def __init__(self, path: str, check: bool = True):
        import sentencepiece
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        lib, n = self.library, self.library.vocab_size()
        self.check = check
        self.pieces = [lib.id_to_piece(i) for i in range(n)]
        special = [lib.is_control(i) or lib.is_unknown(i) or lib.is_byte(i) for i in range(n)]
        self.scores = np.array([lib.get_score(i) for i in range(n)], np.float32)
        normal = {p: i for i, p in enumerate(self.pieces) if not special[i]}
        if any(re.search(f"[^{MARK}]{MARK}", p) for p in normal):
            raise ValueError("pieces that cross a space are not supported")
        self.byte_id = {int(p[3:5], 16): i for i, p in enumerate(self.pieces) if lib.is_byte(i)}

        # symbols: pieces, then characters that only occur inside pieces, then one for all others
        chars = sorted({c for p in normal for c in p} - set(normal))
        symbol = normal | {c: n + k for k, c in enumerate(chars)}
        self.n_symbols = n + len(chars) + 1
        self.symbol_of_char = np.full(0x110000, self.n_symbols - 1, np.int32)
        for c, s in symbol.items():
            if len(c) == 1:
                self.symbol_of_char[ord(c)] = s
        merges = {symbol[p[:k]] * self.n_symbols + symbol[p[k:]]: i for p, i in normal.items()
                  for k in range(1, len(p)) if p[:k] in symbol and p[k:] in symbol}
        self.merges = merges
        self.pair_keys = np.array(sorted(merges), np.int64)
        self.pair_piece = np.array([merges[k] for k in self.pair_keys.tolist()], np.int32)

        surface = [b"" if lib.is_control(i) else bytes([int(p[3:5], 16)]) if lib.is_byte(i)
                   else UNKNOWN_SURFACE.encode() if lib.is_unknown(i) else p.replace(MARK, " ").encode()
                   for i, p in enumerate(self.pieces)]
        self.surface = pa.array(surface, pa.large_binary())
        self.surface_length = np.array([len(s) for s in surface], np.int64)
        self.cache = WordCache(self._segment_words)

    # encoding ------------------------------------------------------------------
    def _merge(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(score, piece) that each symbol pair would form; -inf where none."""
        key = left.astype(np.int64) * self.n_symbols + right
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        found = self.pair_keys[at] == key
        piece = np.where(found, self.pair_piece[at], 0)
        return np.where(found, self.scores[piece], _NONE), piece

    def _agenda_matrix(self, symbols: np.ndarray) -> np.ndarray:
        """Merge rows of symbols (padded with -1) side by side; merged-away symbols become -1."""
        rows, width = symbols.shape
        sym = np.concatenate([symbols, np.full((rows, 1), -1, np.int32)], axis=1)
        after = np.tile(np.arange(1, width + 2, dtype=np.int16), (rows, 1))
        before = np.tile(np.arange(-1, width, dtype=np.int16), (rows, 1))
        score = np.full((rows, width), _NONE, np.float32)
        piece = np.zeros((rows, width), np.int32)
        r, j = np.nonzero((sym[:, 1:] >= 0) & (sym[:, :-1] >= 0))
        score[r, j], piece[r, j] = self._merge(sym[r, j], sym[r, j + 1])
        live = np.arange(rows)
        while len(live):
            j = score[live].argmax(axis=1)
            going = score[live, j] > _NONE
            live, j = live[going], j[going]
            if not len(live):
                break
            right = after[live, j]
            beyond, prior = after[live, right], before[live, j]
            sym[live, j] = piece[live, j]
            sym[live, right] = -1
            score[live, np.minimum(right, width - 1)] = _NONE
            after[live, j] = beyond
            inner = beyond <= width
            before[live[inner], beyond[inner]] = j[inner]
            for row, a, b in ((live, j, np.minimum(beyond, width)), (live, prior, j)):
                ok = a >= 0
                row, a, b = row[ok], a[ok], b[ok]
                s, p = self._merge(sym[row, a], sym[row, b])
                s[sym[row, b] < 0] = _NONE
                score[row, a], piece[row, a] = s, p
        return sym[:, :width]

    def _agenda_heap(self, symbols: list[int]) -> list[int]:
        """Merge one long word with a heap of (negative score, position) entries."""
        sym, n = list(symbols), len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap: list[tuple[float, int, int, int, int]] = []

        def push(a: int, b: int) -> None:
            if a >= 0 and b < n:
                piece = self.merges.get(sym[a] * self.n_symbols + sym[b])
                if piece is not None:
                    heapq.heappush(heap, (-float(self.scores[piece]), a, sym[a], sym[b], piece))

        for k in range(n - 1):
            push(k, k + 1)
        while heap:
            _, a, left, right, piece = heapq.heappop(heap)
            b = after[a]
            if sym[a] != left or b >= n or sym[b] != right:
                continue  # one of the two was merged meanwhile
            sym[a], sym[b] = piece, -1
            after[a] = after[b]
            if after[b] < n:
                before[after[b]] = a
            push(a, after[a])
            push(before[a], a)
        return [s for s in sym if s >= 0]

    def _ids(self, symbols: list[int], text: str) -> list[int]:
        """Ids of merged symbols of ``text``; characters outside the vocabulary become byte pieces."""
        out, at = [], 0
        for s in symbols:
            if s < len(self.pieces):
                out.append(s)
                at += len(self.pieces[s])
            else:
                out += [self.byte_id[b] for b in text[at].encode()]
                at += 1
        return out

    def segment(self, words: list[str]) -> list[np.ndarray]:
        """Ids of each word (space marks in place, no dummy prefix added)."""
        out: list[np.ndarray | None] = [None] * len(words)
        order = sorted((k for k in range(len(words)) if len(words[k]) <= MATRIX_LENGTH), key=lambda k: len(words[k]))
        for lo in range(0, len(order), MATRIX_ROWS):
            part = order[lo:lo + MATRIX_ROWS]
            lengths = np.array([len(words[k]) for k in part])
            codes = np.frombuffer("".join(words[k] for k in part).encode("utf-32-le"), np.uint32)
            symbols = np.full((len(part), int(lengths.max())), -1, np.int32)
            symbols[np.arange(symbols.shape[1]) < lengths[:, None]] = self.symbol_of_char[codes]
            merged = self._agenda_matrix(symbols)
            held = merged >= 0
            flat, ends = merged[held], np.cumsum(held.sum(axis=1))
            odd = (merged >= len(self.pieces)).any(axis=1)
            at = 0
            for k, end, is_odd in zip(part, ends.tolist(), odd.tolist()):
                out[k] = flat[at:end] if not is_odd else np.array(
                    self._ids(flat[at:end].tolist(), words[k]), np.int32)
                at = end
        for k, word in enumerate(words):
            if out[k] is None:
                codes = np.frombuffer(word.encode("utf-32-le"), np.uint32)
                out[k] = np.array(self._ids(self._agenda_heap(self.symbol_of_char[codes].tolist()), word), np.int32)
        return out

    def _segment_words(self, words: list[str]) -> list[bytes]:
        """Segment words given without their first space mark, checked against the library."""
        found = self.segment([MARK + w.replace(" ", MARK) for w in words])
        if self.check:
            for word, ids, want in zip(words, found, self.library.encode(words, num_threads=1)):
                if len(ids) != len(want) or ids.tolist() != want:
                    raise ValueError(f"segmentation of {word!r} differs from the library's")
        return [ids.astype("<i4").tobytes() for ids in found]

    _RUNS = re.compile(r" *[^ ]+| +\Z")

    def encode(self, texts: pa.Array) -> list[bytes]:
        """Little-endian 32-bit ids of each text (strings without nulls), as the library's ``encode`` gives them."""
        texts = pc.replace_substring(texts, MARK, " ")  # both stand for a space
        uneven = np.array(pc.or_(pc.match_substring(texts, "  "), pc.or_(
            pc.starts_with(texts, " "), pc.ends_with(texts, " "))))
        spaced = [self._spaced(text) for text in texts.filter(pa.array(uneven)).to_pylist()]
        split = pc.split_pattern(texts.filter(pa.array(~uneven)), " ")
        coded = split.flatten().dictionary_encode()
        even = laid_out(self.cache.encode(coded.dictionary.to_pylist()), np.array(coded.indices),
                        np.array(split.offsets), "<i4")
        spaced_at, even_at = iter(spaced), iter(even)
        return [next(spaced_at) if odd else next(even_at) for odd in uneven.tolist()]

    def _spaced(self, text: str) -> bytes:
        """Ids of a text with runs of spaces: a word takes the spaces before it, the dummy prefix is one more."""
        runs = self._RUNS.findall(" " + text)
        lone = runs[-1] == " "  # a last space by itself
        words = self.cache.encode([w[1:] for w in (runs[:-1] if lone else runs)])
        return b"".join(words) + (self.segment([MARK])[0].astype("<i4").tobytes() if lone else b"")

    # decoding ------------------------------------------------------------------
    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> list[str]:
        """Texts of id lists laid end to end (``offsets`` has one entry more than there are lists)."""
        joined = np.frombuffer(self.surface.take(pa.array(ids)).buffers()[2] or b"", np.uint8)
        ends = np.concatenate([[0], np.cumsum(self.surface_length[ids])])[offsets]
        out = []
        for lo, hi in zip(ends[:-1].tolist(), ends[1:].tolist()):
            raw = joined[lo:hi].tobytes()
            out.append((raw[1:] if raw[:1] == b" " else raw).decode("utf-8", "replace"))
        return out


@functools.lru_cache(maxsize=2)
def _model(path: str, check: bool) -> PieceModel:
    return PieceModel(path, check)


def encode_decode(docs: DataFrame, model_path: str, check: bool = True) -> DataFrame:
    """``doc_id, ids, decoded`` for every row of ``docs`` (needs ``doc_id`` and ``text``).

    Null texts are empty and give no ids and an empty text. ``decoded`` is the
    text of ``ids``. Without sampling, begin or end ids. ``check`` compares
    every distinct word with the library and raises on a difference.
    Repeated rows are encoded alike; an empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(model_path, check)
        for batch in batches:
            for rows, _, _ in text_slices(batch, "text"):
                bodies = model.encode(rows.column(1).fill_null(""))
                ids = np.frombuffer(b"".join(bodies), "<i4")
                offsets = np.concatenate([[0], np.cumsum([len(b) // 4 for b in bodies])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0), pa.ListArray.from_arrays(offsets, pa.array(ids)),
                     pa.array(model.decode(ids, offsets), pa.string())], ["doc_id", "ids", "decoded"])

    schema = (docs.select("doc_id").schema.add("ids", ArrayType(IntegerType()))
              .add("decoded", StringType()))
    return docs.select("doc_id", "text").mapInArrow(run, schema)
