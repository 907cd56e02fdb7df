"""Token counts under a unigram model, by dynamic programming over a trie of pre-tokens.

A pre-token is a block mark and a word between white space.  The distinct pre-tokens that a worker meets are put in a trie of bytes;
a node's forward score is the best sum of piece scores that ends there, and the tokens of that best cut are kept with it.  Pre-tokens
with a common beginning share its nodes, so that each beginning is scored once; the counts at the ends of pre-tokens
are stored and added up by document.  The trie is implicit in the sorted pre-tokens: a node at depth d is a run of
pre-tokens with the same first d bytes, and all nodes of one depth are scored at once in numpy.

The public vocabularies are all of the BPE kind, which has ranks and no probabilities, so that a piece's score is the
logarithm of a Zipf law over its rank, in integers of 1e-6 (sums are exact, in any order); a byte outside all pieces scores worse than any
piece.  Among equally good cuts the one with fewer tokens counts.

Plan: one Arrow pass, no shuffle; counts of distinct pre-tokens are kept for a whole task (at most CACHE of them, then it starts
anew, which changes no result).

Defined results: a null text has null counts; empty and all-white-space texts have 0; repeated rows are counted each; a null
doc_id stays null; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyloom.llm.common import U64, text_slices
from keyloom.llm.merge_dropout import MARK, MODEL, model_file

CACHE = 600_000
TRIE_WORDS = 1 << 15
WIDTH = 64
EXACT = 8
SHIFT, UNIT = 2.7, 1_000_000
_BASE = 0x9E3779B97F4A7C15
_loaded: dict[object, Unigrams] = {}


class Unigrams:
    """Pieces as bytes with integer scores; for numpy also sorted by length: up to EXACT bytes as integers, longer ones by hashes, with their bytes to compare."""

    def __init__(self, model: bytes) -> None:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        usable = [i for i in range(sp.get_piece_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        self.scores = self.zipf([sp.id_to_piece(i).encode() for i in usable])
        self.foreign = min(self.scores.values()) - 10 * UNIT
        self.longest = max(map(len, self.scores))
        self.by_length = {}
        for n in range(1, self.longest + 1):
            own = sorted((int.from_bytes(p, "big") if n <= EXACT else piece_hash(p), s, p) for p, s in self.scores.items() if len(p) == n)
            if own or n == 1:
                keys = np.array([k for k, _, _ in own], U64)
                if (keys[1:] == keys[:-1]).any():
                    raise ValueError("two pieces of one length have the same hash")
                letters = np.frombuffer(b"".join([p for _, _, p in own]), np.uint8).reshape(-1, n)
                self.by_length[n] = keys, np.array([s for _, s, _ in own], np.int64), letters

    @staticmethod
    def zipf(pieces: list[bytes]) -> dict[bytes, int]:
        norm = math.log(sum(1 / (r + SHIFT) for r in range(len(pieces))))
        return {p: round(UNIT * (-math.log(r + SHIFT) - norm)) for r, p in enumerate(pieces)}


def piece_hash(piece: bytes) -> int:
    h = 0
    for b in piece:
        h = (h * _BASE + b + 1) & (2**64 - 1)
    return h


def unigrams(model: str | bytes) -> Unigrams:
    """Of a model by its path or its bytes; loaded once in a process."""
    key = model if isinstance(model, str) else xxhash.xxh3_128_digest(model)
    if key not in _loaded:
        _loaded[key] = Unigrams(model_file(model) if isinstance(model, str) else model)
    return _loaded[key]


def one_count(u: Unigrams, word: bytes) -> int:
    """The tokens of one pre-token's best cut, without a trie."""
    best = [(0, 0)]
    for end in range(1, len(word) + 1):
        score, tokens = best[end - 1]
        top = (score + u.scores.get(word[end - 1 : end], u.foreign), tokens - 1)
        for n in range(2, min(u.longest, end) + 1):
            s = u.scores.get(word[end - n : end])
            if s is not None:
                score, tokens = best[end - n]
                top = max(top, (score + s, tokens - 1))
        best.append(top)
    return -best[-1][1]


def trie_counts(u: Unigrams, words: list[bytes]) -> np.ndarray:
    """The tokens of each of some distinct pre-tokens of at most WIDTH bytes."""
    out = np.zeros(len(words), np.int64)
    if not words:
        return out
    order = sorted(range(len(words)), key=words.__getitem__)
    sizes = np.array([len(words[i]) for i in order], np.int64)
    n, width = len(order), int(sizes.max())
    letters = np.zeros((n, width), np.uint8)
    row = np.repeat(np.arange(n), sizes)
    letters[row, np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = np.frombuffer(b"".join([words[i] for i in order]), np.uint8)
    differ = letters[1:] != letters[:-1]
    common = np.where(differ.any(1), differ.argmax(1), width)
    common = np.concatenate(([0], np.minimum(common, np.minimum(sizes[1:], sizes[:-1]))))
    power = np.array([pow(_BASE, k, 1 << 64) for k in range(width + 1)], U64)
    # node[d][i]: the number of word i's node among those at depth d; score and tokens by node; hash of the first d bytes by word
    node = [np.zeros(n, np.int64)]
    score, tokens = [np.zeros(1, np.int64)], [np.zeros(1, np.int64)]
    prefix = [np.zeros(n, U64)]
    recent = np.zeros(n, U64)  # the last eight bytes
    with np.errstate(over="ignore"):
        for d in range(1, width + 1):
            prefix.append(prefix[-1] * U64(_BASE) + letters[:, d - 1].astype(U64) + U64(1))
            recent = (recent << U64(8)) | letters[:, d - 1].astype(U64)
            begins = (common < d) & (sizes >= d)
            first = np.flatnonzero(begins)
            node.append(np.cumsum(begins) - 1)
            best, least = np.full(len(first), np.iinfo(np.int64).min), np.zeros(len(first), np.int64)
            for length, (hashes, scores, pieces) in u.by_length.items():
                if length > d:
                    break
                if length <= EXACT:
                    wanted = recent[first] & U64((1 << 8 * length) - 1)
                else:
                    wanted = prefix[d][first] - prefix[d - length][first] * power[length]
                at = np.minimum(np.searchsorted(hashes, wanted), max(0, len(hashes) - 1))
                hit = hashes[at] == wanted if len(hashes) else np.zeros(len(first), bool)
                here = np.flatnonzero(hit) if length > 1 else np.arange(len(first))
                if length > EXACT and len(here):
                    here = here[(letters[first[here], d - length : d] == pieces[at[here]]).all(1)]
                gain = scores[at[here]] if length > 1 else np.where(hit, scores[at] if len(scores) else 0, u.foreign)
                parent = node[d - length][first[here]]
                s, t = score[d - length][parent] + gain, tokens[d - length][parent] + 1
                better = (s > best[here]) | (s == best[here]) & (t < least[here])
                best[here[better]], least[here[better]] = s[better], t[better]
            score.append(best)
            tokens.append(least)
            terminal = np.flatnonzero(sizes == d)
            out[np.array(order)[terminal]] = least[node[d][terminal]]
    return out


def pre_token_counts(u: Unigrams, words: list[str]) -> list[int]:
    raw = [(MARK + w).encode() for w in words]
    out = np.zeros(len(raw), np.int64)
    short = [i for i, r in enumerate(raw) if len(r) <= WIDTH]
    # consecutive ranges of the sorted pre-tokens make tries, so that common beginnings stay together
    short.sort(key=raw.__getitem__)
    for s in range(0, len(short), TRIE_WORDS):
        at = short[s : s + TRIE_WORDS]
        out[at] = trie_counts(u, [raw[i] for i in at])
    for i, r in enumerate(raw):
        if len(r) > WIDTH:
            out[i] = one_count(u, r)
    return out.tolist()


def _counter(model: bytes):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        u = unigrams(model)
        known: dict[str, int] = {}
        for whole in batches:
            for batch in text_slices(whole, "text"):
                split = [None if t is None else t.split() for t in batch.column("text").to_pylist()]
                distinct = set().union(*filter(None, split))
                new = list(distinct.difference(known))
                if len(known) + len(new) > CACHE:
                    known.clear()
                    new = list(distinct)
                known.update(zip(new, pre_token_counts(u, new)))
                words = pa.array([None if w is None else len(w) for w in split], pa.int64())
                tokens = pa.array([None if w is None else sum(map(known.__getitem__, w)) for w in split], pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), words, tokens], ["doc_id", "n_pre_tokens", "n_tokens"])

    return count


def count_tokens(docs: DataFrame, path: str = MODEL) -> DataFrame:
    """(doc_id, n_pre_tokens, n_tokens) of each row."""
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_counter(model_file(path)), "doc_id long, n_pre_tokens long, n_tokens long")
