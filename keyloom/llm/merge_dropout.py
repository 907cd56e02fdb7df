"""Byte-pair encoding with seeded merge dropout, and lossless decoding, with the vocabulary of a SentencePiece BPE model.

Characters are merged in the order of an agenda: the best-scored adjacent pair first, the leftmost among equals.  Each
candidate merge, known by the spans of its two symbols, is skipped if a hash keyed by seed, doc_id, place of the pre-token, pre-token and spans
falls below the dropout rate; a skipped candidate never comes back, while a new pair with a neighbour that has grown is a candidate of
its own.  So each occurrence of a word is cut by itself, always the same for the same seed, whatever the partitioning.  With a rate of 0 the
ids are those of the library's encoder.

As a skip depends on spans and the occurrence's key alone, the agenda of a pre-token is a tree of decisions: at each node the best remaining candidate is merged or
skipped, at each leaf stand the ids.  A pre-token that is met OFTEN in a task gets such a tree, grown where an occurrence first goes, and all occurrences walk their
trees at once in numpy, a hash for each decision.  The agendas of rarer pre-tokens are worked off side by side: numpy holds one row of symbols
a pre-token, and each round merges the best remaining candidate of every row.  Pre-tokens above WIDTH characters take a heap, which numpy fills.  All three give the same ids.

Plan: one Arrow pass, no shuffle; the model is read on the driver and goes to the workers with the function; a worker loads it once.  Only with a rate of 0 are the cuts of a run of pre-tokens made once for each
distinct one.

Defined results: a null text has null ids and tokens and is not lossless (null); an empty text has no ids; a null doc_id counts as 0;
repeated rows are encoded each, alike; the block mark U+2581 in a text is written as its bytes, so that it isn't decoded as a blank;
decode gives null for null ids; other columns are not read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyloom.llm.common import U64, mix64, text_slices, utf8

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SEED, RATE = 20240, 0.1
WIDTH = 32
AT_ONCE, RUN = 1 << 15, 1 << 18
OFTEN, MAX_NODES = 32, 1 << 20
EDGES = (0, 3, 5, 7, 9, 11, 13, 16, 20, 25, WIDTH)
MARK = "▁"
_NONE = np.int64(1) << 40
_loaded: dict[object, Vocabulary] = {}


def model_file(path: str) -> bytes:
    """A model's bytes, which the driver reads and sends to the workers with the function."""
    with open(path, "rb") as f:
        return f.read()


class Vocabulary:
    def __init__(self, model: bytes) -> None:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        n = sp.get_piece_size()
        self.pieces = [sp.id_to_piece(i) for i in range(n)]
        usable = [i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        self.ids = {self.pieces[i]: i for i in usable}
        # priority: smaller merges first; equal scores are equal
        order = {s: k for k, s in enumerate(sorted({sp.get_score(i) for i in usable}, reverse=True))}
        self.priority = np.full(n, len(order), np.int64)
        for i in usable:
            self.priority[i] = order[sp.get_score(i)]
        self.bytes = np.array([sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int32)
        self.character = np.full(0x110000, -1, np.int32)
        for p, i in self.ids.items():
            if len(p) == 1:
                self.character[ord(p)] = i
        # in pre-tokens the mark is written as a blank, so that a mark in a text is a character like any unknown one
        self.character[ord(" ")], self.character[ord(MARK)] = self.character[ord(MARK)], -1
        pairs = [(self.ids[p[:k]] * n + self.ids[p[k:]], i) for p, i in self.ids.items() for k in range(1, len(p)) if p[:k] in self.ids and p[k:] in self.ids]
        pairs.sort()
        self.n = n
        self.pair_keys = np.array([k for k, _ in pairs], np.int64)
        self.pair_ids = np.array([i for _, i in pairs], np.int32)
        self.pairs = dict(pairs)
        # the same in an open table for numpy: a pair lies at its hash or at one of the next few places
        self.table_shift = 64 - max(4, (8 * len(pairs)).bit_length())
        places = np.zeros(len(pairs), np.int64)
        taken: set[int] = set()
        for k, place in enumerate(self._places(self.pair_keys).tolist()):
            while place in taken:
                place += 1
            taken.add(place)
            places[k] = place
        self.reach = int((places - self._places(self.pair_keys)).max(initial=0)) + 1
        self.table_keys = np.full((1 << (64 - self.table_shift)) + self.reach, -1, np.int64)
        self.table_ids = np.full(len(self.table_keys), -1, np.int32)
        self.table_keys[places], self.table_ids[places] = self.pair_keys, self.pair_ids
        raw = [b""] * n
        for p, i in self.ids.items():
            raw[i] = p.replace(MARK, " ").encode()
        for b in range(256):
            raw[self.bytes[b]] = bytes([b])
        self.blob = np.frombuffer(b"".join(raw), np.uint8)
        self.sizes = np.array([len(r) for r in raw], np.int64)
        self.places = np.cumsum(self.sizes) - self.sizes

    def _places(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(U64) * U64(0x9E3779B97F4A7C15)) >> U64(self.table_shift)).astype(np.int64)

    def merged(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The piece that each two symbols make, or -1."""
        key = left.astype(np.int64) * self.n + right
        key[(left < 0) | (right < 0)] = -2
        place = self._places(key)
        out = np.full(len(key), -1, np.int32)
        todo = None
        for _ in range(self.reach):
            there = self.table_keys[place]
            hit = there == key
            if todo is None:
                out[hit] = self.table_ids[place[hit]]
                todo = np.flatnonzero(~hit & (there >= 0))
            else:
                out[todo[hit]] = self.table_ids[place[hit]]
                todo = todo[~hit & (there >= 0)]
            if not len(todo):
                break
            on = ~hit & (there >= 0)
            key, place = key[on], place[on] + 1
        return out


def vocabulary(model: str | bytes) -> Vocabulary:
    """Of a model by its path or its bytes; loaded once in a process."""
    key = model if isinstance(model, str) else xxhash.xxh3_128_digest(model)
    if key not in _loaded:
        _loaded[key] = Vocabulary(model_file(model) if isinstance(model, str) else model)
    return _loaded[key]


def seed_key(seed: int) -> int:
    return xxhash.xxh64_intdigest(str(seed))


def span_hash(begin: np.ndarray, middle: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Of the candidate that joins [begin, middle) and [middle, end) of a pre-token."""
    return mix64(((begin.astype(U64) << U64(32)) | end.astype(U64)) + middle.astype(U64) * U64(0x9E3779B97F4A7C15))


def limit_of(rate: float) -> int:
    return min(int(rate * 2.0**64), 2**64 - 1)


def skipped(unit_keys: np.ndarray, begin: np.ndarray, middle: np.ndarray, end: np.ndarray, rate: float) -> np.ndarray:
    """Whether a candidate is skipped."""
    if rate <= 0:
        return np.zeros(len(unit_keys), bool)
    return mix64(unit_keys ^ span_hash(begin, middle, end)) < U64(limit_of(rate))


_M64 = (1 << 64) - 1


def _mix(x: int) -> int:
    """mix64 of one integer."""
    x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & _M64
    x = (x ^ (x >> 27)) * 0x94D049BB133111EB & _M64
    return x ^ (x >> 31)


def _span_hash(begin: int, middle: int, end: int) -> int:
    return _mix(((begin << 32 | end) + middle * 0x9E3779B97F4A7C15) & _M64)


def agenda(vocab: Vocabulary, unit: str, key: int, rate: float) -> list[int]:
    """One pre-token's symbols after its agenda is worked off, by a heap; symbols outside the vocabulary are -1 - code point."""
    n = len(unit)
    first = first_symbols(vocab, np.frombuffer(unit.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64))
    symbols = first.tolist()
    following, before, end = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
    alive = [True] * n
    limit, pairs, many, priority = limit_of(rate), vocab.pairs, vocab.n, vocab.priority.tolist() if n > 4096 else vocab.priority
    a = np.arange(n - 1)
    made = vocab.merged(first[:-1], first[1:])
    a = a[(made >= 0) & ~skipped(np.full(n - 1, key, U64), a, a + 1, a + 2, rate)]
    heap: list[tuple] = list(zip(vocab.priority[made[a]].tolist(), a.tolist(), (a + 1).tolist(), (a + 2).tolist(), made[a].tolist()))
    heapq.heapify(heap)

    def push(a: int) -> None:
        b = following[a] if a >= 0 else n
        if a < 0 or b >= n or symbols[a] < 0 or symbols[b] < 0:
            return
        piece = pairs.get(symbols[a] * many + symbols[b], -1)
        if piece >= 0 and (rate <= 0 or _mix(key ^ _span_hash(a, b, end[b])) >= limit):
            heapq.heappush(heap, (int(priority[piece]), a, b, end[b], piece))

    while heap:
        _, a, b, to, piece = heapq.heappop(heap)
        if not (alive[a] and alive[b] and following[a] == b and end[b] == to and end[a] == b):
            continue
        symbols[a], alive[b], end[a] = piece, False, to
        following[a] = following[b]
        if following[a] < n:
            before[following[a]] = a
        push(before[a])
        push(a)
    return [s for s, ok in zip(symbols, alive) if ok]


class Trees:
    """The trees of decisions of pre-tokens at one rate above 0. Nodes are numbered; a leaf's children are itself."""

    def __init__(self, vocab: Vocabulary, rate: float) -> None:
        self.vocab, self.limit = vocab, U64(limit_of(rate))
        self.priority = vocab.priority.tolist()
        self.clear()

    def clear(self) -> None:
        self.roots: dict[str, int] = {}
        self.n = 0
        self.spans = np.zeros(1 << 12, U64)
        self.child = np.full((1 << 12, 2), -1, np.int32)  # merged, skipped
        self.place, self.size = np.zeros(1 << 12, np.int64), np.full(1 << 12, -1, np.int32)  # of a leaf's ids; -1 inside
        self.states: list = []
        self.hashes: dict[tuple, int] = {}
        self.ids: list[np.ndarray] = []
        self.n_ids = 0
        self.pool = np.zeros(0, np.int32)

    def _node(self, symbols: tuple, ends: tuple, left: list) -> int:
        """A new node: symbols, where each ends, and the candidates that are left: (priority, begin, middle, end, piece), the best first."""
        if self.n == len(self.spans):
            self.spans = np.concatenate((self.spans, np.zeros_like(self.spans)))
            self.child = np.concatenate((self.child, np.full_like(self.child, -1)))
            self.place = np.concatenate((self.place, np.zeros_like(self.place)))
            self.size = np.concatenate((self.size, np.full_like(self.size, -1)))
        me, self.n = self.n, self.n + 1
        if left:
            span = left[0][1:4]
            if span not in self.hashes:
                self.hashes[span] = _span_hash(*span)
            self.spans[me] = self.hashes[span]
            self.states.append((symbols, ends, left))
        else:
            ids = np.frombuffer(_to_ids(self.vocab, symbols), np.int32)
            self.place[me], self.size[me] = self.n_ids, len(ids)
            self.ids.append(ids)
            self.n_ids += len(ids)
            self.child[me] = me
            self.states.append(None)
        return me

    def root(self, unit: str) -> int:
        if unit not in self.roots:
            n, pairs, many = len(unit), self.vocab.pairs, self.vocab.n
            symbols = tuple(first_symbols(self.vocab, np.array([ord(c) for c in unit], np.int64)).tolist())
            made = [(i, pairs.get(symbols[i] * many + symbols[i + 1])) for i in range(n - 1) if symbols[i] >= 0 and symbols[i + 1] >= 0]
            left = sorted((self.priority[piece], i, i + 1, i + 2, piece) for i, piece in made if piece is not None)
            self.roots[unit] = self._node(symbols, tuple(range(1, n + 1)), left)
        return self.roots[unit]

    def _grow(self, at: int, skip: int) -> None:
        symbols, ends, left = self.states[at]
        if skip:
            made = self._node(symbols, ends, left[1:])
        else:
            _, begin, middle, end, piece = left[0]
            i = ends.index(middle)
            # candidates of the two symbols that are no more
            rest = [c for c in left if c[3] <= begin or c[1] >= end]
            symbols, ends = (*symbols[:i], piece, *symbols[i + 2 :]), (*ends[:i], *ends[i + 1 :])
            for k in (i - 1, i):
                if 0 <= k < len(symbols) - 1 and symbols[k] >= 0 and symbols[k + 1] >= 0:
                    new = self.vocab.pairs.get(symbols[k] * self.vocab.n + symbols[k + 1])
                    if new is not None:
                        rest.append((self.priority[new], ends[k - 1] if k else 0, ends[k], ends[k + 1], new))
            rest.sort()
            made = self._node(symbols, ends, rest)
        self.child[at, skip] = made
        if self.child[at, 1 - skip] >= 0:
            self.states[at] = None

    def leaves(self, nodes: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """The leaf that each occurrence, with a key, comes to from its root."""
        nodes = nodes.copy()
        going = np.flatnonzero(self.size[nodes] < 0)
        while len(going):
            at = nodes[going]
            skip = (mix64(keys[going] ^ self.spans[at]) < self.limit).astype(np.int64)
            to = self.child[at, skip]
            new = to < 0
            if new.any():
                for code in np.unique(2 * at[new] + skip[new]).tolist():
                    self._grow(code >> 1, code & 1)
                to = self.child[at, skip]
            nodes[going] = to
            going = going[self.size[to] < 0]
        return nodes

    def all_ids(self) -> np.ndarray:
        if self.ids:
            self.pool = np.concatenate((self.pool, *self.ids))
            self.ids = []
        return self.pool


def first_symbols(vocab: Vocabulary, points: np.ndarray) -> np.ndarray:
    found = vocab.character[points]
    return np.where(found >= 0, found, -1 - points)


def _side_by_side(vocab: Vocabulary, points: np.ndarray, sizes: np.ndarray, keys: np.ndarray, rate: float) -> tuple[np.ndarray, np.ndarray]:
    """The final symbols of many pre-tokens of at most WIDTH characters, and their number in each; points are all their code points."""
    n, width = len(sizes), int(sizes.max())
    row = np.repeat(np.arange(n), sizes)
    col = np.arange(len(points)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    sym = np.full((n, width + 1), -1, np.int64)
    sym[row, col] = first_symbols(vocab, points)
    alive = np.zeros((n, width + 1), bool)
    alive[row, col] = True
    following = np.tile(np.arange(1, width + 2), (n, 1))
    before = np.tile(np.arange(-1, width), (n, 1))
    end = np.tile(np.arange(1, width + 2), (n, 1))
    # a candidate's agenda key: priority, then place; _NONE where there is no candidate
    best = np.full((n, width + 1), _NONE, np.int64)
    made = np.full((n, width + 1), -1, np.int32)

    def renew(r: np.ndarray, a: np.ndarray) -> None:
        b = following[r, a]
        ok = b < sizes[r]
        best[r[~ok], a[~ok]] = _NONE
        r, a, b = r[ok], a[ok], b[ok]
        piece = vocab.merged(sym[r, a], sym[r, b])
        live = piece >= 0
        live[live] = ~skipped(keys[r[live]], a[live], b[live], end[r[live], b[live]], rate)
        best[r, a] = np.where(live, (vocab.priority[np.maximum(piece, 0)] << 6) | a, _NONE)
        made[r, a] = piece

    renew(row, col)
    rows = np.arange(n)
    while True:
        a = best[rows].argmin(1)
        go = best[rows, a] < _NONE
        rows, a = rows[go], a[go]
        if not len(rows):
            break
        b = following[rows, a]
        sym[rows, a] = made[rows, a]
        alive[rows, b] = False
        best[rows, b] = _NONE
        end[rows, a] = end[rows, b]
        after = following[rows, b]
        following[rows, a] = after
        inside = after <= width
        before[rows[inside], after[inside]] = a[inside]
        renew(rows, a)
        p = before[rows, a]
        has = p >= 0
        renew(rows[has], p[has])
    return sym[alive], alive.sum(1)


def _to_ids(vocab: Vocabulary, symbols: list[int] | tuple) -> bytes:
    out: list[int] = []
    for s in symbols:
        out += [s] if s >= 0 else vocab.bytes[list(chr(-1 - s).encode())].tolist()
    return np.array(out, np.int32).tobytes()


def rows_of_ids(vocab: Vocabulary, units: list[str], lengths: np.ndarray, unit_keys: np.ndarray, rate: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, place, size): the ids of pre-tokens (blanks, then other characters), each of them size[i] from place[i] on."""
    place, size = np.zeros(len(units), np.int64), np.zeros(len(units), np.int64)
    parts: list[np.ndarray] = []
    total = 0

    def add(at: np.ndarray, ids: np.ndarray, n: np.ndarray) -> None:
        nonlocal total
        place[at], size[at] = total + np.cumsum(n) - n, n
        parts.append(ids.astype(np.int32, copy=False))
        total += len(ids)

    def apart(at: np.ndarray, symbols: list[list[int]]) -> None:
        coded = [np.frombuffer(_to_ids(vocab, s), np.int32) for s in symbols]
        if coded:
            add(at, np.concatenate(coded), np.array([len(c) for c in coded], np.int64))

    long = np.flatnonzero(lengths > WIDTH)
    apart(long, [agenda(vocab, units[i], int(unit_keys[i]), rate) for i in long])
    for low, high in zip(EDGES, EDGES[1:]):
        group = np.flatnonzero((lengths > low) & (lengths <= high))
        for s in range(0, len(group), AT_ONCE):
            at = group[s : s + AT_ONCE]
            points = np.frombuffer("".join([units[i] for i in at.tolist()]).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
            symbols, n = _side_by_side(vocab, points, lengths[at], unit_keys[at], rate)
            foreign = np.zeros(len(at), bool)
            if (symbols < 0).any():
                # characters outside the vocabulary become bytes
                of = np.repeat(np.arange(len(at)), n)
                foreign[of[symbols < 0]] = True
                cuts = np.concatenate(([0], np.cumsum(n)))
                apart(at[foreign], [symbols[cuts[k] : cuts[k + 1]].tolist() for k in np.flatnonzero(foreign).tolist()])
                symbols, n = symbols[~foreign[of]], n[~foreign]
            add(at[~foreign], symbols, n)
    return np.concatenate(parts) if parts else np.zeros(0, np.int32), place, size


def encode_units(vocab: Vocabulary, units: list[str], key: int, rate: float) -> list[bytes]:
    """The ids of each pre-token, as bytes of int32, under a key of the pre-token alone."""
    unit_keys = np.array([xxhash.xxh64_intdigest(u.encode(), key) for u in units], U64)
    ids, place, size = rows_of_ids(vocab, units, np.array([len(u) for u in units], np.int64), unit_keys, rate)
    return [ids[a : a + n].tobytes() for a, n in zip(place.tolist(), size.tolist())]


class Encoder:
    """Cuts runs of pre-tokens; keeps the trees of those met often and, at rate 0, nothing."""

    def __init__(self, vocab: Vocabulary, key: int, rate: float) -> None:
        self.vocab, self.key, self.rate = vocab, key, rate
        self.trees = Trees(vocab, rate) if rate > 0 else None
        self.met: dict[str, int] = {}

    def _root(self, unit: str, times: int) -> int:
        """The root of a pre-token's tree, or -1 while it hasn't been met often."""
        root = self.trees.roots.get(unit)
        if root is not None:
            return root
        met = self.met.get(unit, 0) + times
        if met >= OFTEN and len(unit) <= WIDTH // 2:
            self.met.pop(unit, None)
            return self.trees.root(unit)
        self.met[unit] = met
        return -1

    def encode(self, words: list[str], places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of pre-tokens (without their first blanks) one after the other, and how many each has; places: a key of each one's own."""
        code, distinct = pd.factorize(np.array([*words, None], object)[:-1])
        units = [" " + w for w in distinct]
        lengths = np.array(list(map(len, units)), np.int64)
        if self.trees is None:
            # occurrences don't differ
            ids, place, size = rows_of_ids(self.vocab, units, lengths, np.zeros(len(units), U64), 0.0)
            return gathered(ids, place[code], size[code])
        keys = mix64(np.array([xxhash.xxh64_intdigest(u.encode("utf-8", "surrogatepass"), self.key) for u in units], U64)[code] ^ places)
        if len(self.met) > MAX_NODES:
            self.met.clear()
        if self.trees.n > MAX_NODES:
            self.trees.clear()
        root = np.array(list(map(self._root, units, np.bincount(code, minlength=len(units)).tolist())), np.int64)[code]
        place, size = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        grown = np.flatnonzero(root >= 0)
        leaf = self.trees.leaves(root[grown], keys[grown])
        place[grown], size[grown] = self.trees.place[leaf], self.trees.size[leaf]
        rare = np.flatnonzero(root < 0)
        ids, own, size[rare] = rows_of_ids(self.vocab, list(map(units.__getitem__, code[rare].tolist())), lengths[code[rare]], keys[rare], self.rate)
        pool = self.trees.all_ids()
        place[rare] = len(pool) + own
        return gathered(np.concatenate((pool, ids)), place, size)


def gathered(pool: np.ndarray, place: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs of size values of a pool that begin at place, one after the other, and size."""
    return pool[np.repeat(place - (np.cumsum(size) - size), size) + np.arange(size.sum())], size


def pre_tokens(text: str) -> list[str]:
    """Words with the blanks before them, less one blank each: every pre-token starts with one, also the first, before which the encoder puts one.

    Blanks at the end are a pre-token of their own.
    """
    words = text.split(" ")
    if "" not in words:
        return words
    out, blanks = [], 0
    for w in words:
        blanks += 1
        if w:
            out.append(" " * (blanks - 1) + w)
            blanks = 0
    if blanks:
        out.append(" " * (blanks - 1))
    return out


def decode_ids(vocab: Vocabulary, ids: np.ndarray) -> np.ndarray:
    """The bytes of all ids, with the blank before each text."""
    n = vocab.sizes[ids]
    if not len(ids):
        return np.zeros(0, np.uint8)
    return vocab.blob[np.repeat(vocab.places[ids] - (np.cumsum(n) - n), n) + np.arange(n.sum())]


def _encoder(model: bytes, seed: int, rate: float):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(model)
        key = seed_key(seed)
        encoder = Encoder(vocab, key, rate)
        for whole in batches:
            for batch in text_slices(whole, "text", 2 << 20):
                split = [pre_tokens(t) if t else [] for t in batch.column("text").to_pylist()]
                words = [w for own in split for w in own]
                cuts = np.concatenate(([0], np.cumsum([len(own) for own in split])))
                doc_keys = mix64(batch.column("doc_id").fill_null(0).to_numpy().view(U64) ^ U64(key))
                doc = np.repeat(np.arange(len(split)), np.diff(cuts))
                places = doc_keys[doc] ^ mix64((np.arange(len(words)) - cuts[doc]).astype(U64) + U64(1))
                parts, ends = [np.zeros(0, np.int32)], [np.zeros(1, np.int64)]
                for s in range(0, len(words), RUN):
                    part, size = encoder.encode(words[s : s + RUN], places[s : s + RUN])
                    parts.append(part)
                    ends.append(ends[-1][-1] + np.cumsum(size))
                ids = np.concatenate(parts)
                n = np.diff(np.concatenate(ends)[cuts])
                null = batch.column("text").is_null().to_numpy(zero_copy_only=False)
                lossless = _equal(decode_ids(vocab, ids), np.cumsum(np.concatenate(([0], vocab.sizes[ids]))), np.concatenate(([0], np.cumsum(n))), batch.column("text"))
                offsets = pa.array(np.concatenate(([0], np.cumsum(n))).astype(np.int32), mask=np.append(null, False))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), pa.ListArray.from_arrays(offsets, pa.array(ids)), pa.array(n, mask=null), pa.array(lossless, mask=null)],
                    ["doc_id", "ids", "n_tokens", "lossless"],
                )

    return encode


def _equal(decoded: np.ndarray, id_ends: np.ndarray, id_cuts: np.ndarray, texts: pa.Array) -> np.ndarray:
    """Whether each text's decoded bytes, without the blank before, are its own."""
    data, off = utf8(texts)
    cuts = id_ends[id_cuts]
    size = np.diff(cuts)
    out = np.maximum(size - 1, 0) == np.diff(off)
    if out.all():
        keep = np.ones(len(decoded), bool)
        keep[cuts[:-1][size > 0]] = False
        same = decoded[keep] == data
        if same.all():
            return out
    return np.array([bool(ok) and bool((decoded[a + 1 : b] == data[c:d]).all()) for ok, a, b, c, d in zip(out, cuts, cuts[1:], off, off[1:])], bool)


def encode(docs: DataFrame, path: str = MODEL, seed: int = SEED, rate: float = RATE) -> DataFrame:
    """(doc_id, ids, n_tokens, lossless) of each row; lossless says whether decoding gave the text back."""
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        _encoder(model_file(path), seed, rate), "doc_id long, ids array<int>, n_tokens long, lossless boolean"
    )


def _decoder(model: bytes):
    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(model)
        for batch in batches:
            texts = []
            for ids in batch.column("ids"):
                texts.append(None if not ids.is_valid else decode_ids(vocab, ids.values.to_numpy(zero_copy_only=False))[1:].tobytes().decode() if len(ids) else "")
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return decode


def decode(coded: DataFrame, path: str = MODEL) -> DataFrame:
    """(doc_id, text) of (doc_id, ids)."""
    return coded.select(F.col("doc_id").cast("long"), F.col("ids").cast("array<int>")).mapInArrow(_decoder(model_file(path)), "doc_id long, text string")
