"""Vector best-fit packing of documents into training sequences.

A bin has three capacities: tokens, documents, and attention cost (the sum of squared lengths, which is what attention within
documents costs).  Items are taken from the longest down; an item goes to an open bin that can hold it in all three, chosen by the
rule "dot" (the largest weighted dot product of demand and residual) or "norm" (the smallest weighted norm of the
residual that remains), else to a new bin.  A document above the longest length that fits an empty bin is cut into pieces of at most that length.

Lengths are the pieces of a SentencePiece BPE model (those of op10 without dropout), counted once for each distinct pre-token of a task, and documents are cut between
pre-tokens, or, where one is longer than a bin, between its characters; or,
without a model, white-space-separated words: a bin then holds some two and a half times as many real tokens, and a text without white space is one word.

Plan: documents fall by a hash of doc_id into shards of about SHARD_DOCS documents, whose number comes from a count (of
Parquet footers); lengths are computed before (pieces in an Arrow pass, words by Spark), so that only (doc_id, length) is shuffled, and the texts too only where the
result is to hold them (pack_texts); each shard is packed by
itself, in numpy over its open bins.  A shard's size doesn't depend on the input's, and of its bins only the last few stay unfilled.  The model is read on the driver and goes to the
workers with the function.

Defined results: null texts and texts without tokens are not packed; rows with a null doc_id are packed with a null doc_id;
repeated rows are packed each; ties in length go by doc_id (null first), ties between bins to the oldest; an empty table gives no bins; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyloom.llm.common import text_slices
from keyloom.llm.merge_dropout import MARK, MODEL, encode_units, model_file, pre_tokens, vocabulary

MAX_TOKENS = 4096
MAX_DOCS = 64
MAX_ATTENTION = MAX_TOKENS * MAX_TOKENS * 3 // 4
WEIGHTS = (1.0, 0.25, 0.5)
RULE = "norm"
SHARD_DOCS = 4096
CACHE = 600_000
SLICE = 2 << 20
SCHEMA = "bin_id long, position int, doc_id long, piece int, first_token long, n_tokens long"


def word_tokens(text: Column) -> Column:
    """The white-space-separated words of a text."""
    trimmed = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(trimmed == "", 0).otherwise(F.length(trimmed) - F.length(F.replace(trimmed, F.lit(" "), F.lit(""))) + 1).cast("long")


def _unit_cuts(model: bytes, unit: str, room: int) -> list[tuple[int, int]]:
    """(tokens, characters) of the parts of a pre-token, with its blank, of at most room tokens each that end between characters."""
    vocab = vocabulary(model)
    ids = np.frombuffer(encode_units(vocab, [" " + unit], 0, 0.0)[0], np.int32)
    ends = np.cumsum(vocab.sizes[ids])
    raw = (" " + unit).encode()
    whole = np.append(np.frombuffer(raw, np.uint8) & 0xC0 != 0x80, True)
    letters = np.cumsum(whole) - 1  # characters before each byte
    parts, done, at = [], 0, 0
    while done < len(ids):
        to = min(done + room, len(ids))
        while to > done + 1 and not whole[ends[to - 1]]:
            to -= 1
        end = int(letters[ends[to - 1]]) if to < len(ids) else len(unit) + 1
        parts.append((to - done, end - at))
        done, at = to, end
    return parts


def text_cuts(model: bytes, units: list[str], sizes: list[int], longest: int) -> tuple[list[int], list[int]]:
    """(first token, first character) of each piece of a text that is cut between its pre-tokens where it can be."""
    firsts, places = [0], [0]
    token = place = 0  # of the next part
    for unit, size in zip(units, sizes):
        parts = [(size, len(unit) + 1)] if size <= longest else _unit_cuts(model, unit, longest)
        for n, letters in parts:
            if token + n - firsts[-1] > longest:
                firsts.append(token)
                # the blank before the first pre-token isn't in the text
                places.append(max(0, place - 1))
            token, place = token + n, place + letters
    return firsts, places


def _counter(model: bytes, longest: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        known: dict[str, int] = {}

        def learn(words: list[str]) -> None:
            known.update(zip(words, map(len, sp.encode(words, num_threads=1))))
            # op10 writes a mark in a text as its bytes, and the library drops the blank of an empty pre-token
            marked = [w for w in words if MARK in w or not w]
            if marked:
                known.update(zip(marked, (len(ids) // 4 for ids in encode_units(vocabulary(model), [" " + w for w in marked], 0, 0.0))))

        for whole in batches:
            for batch in text_slices(whole, "text", SLICE):
                split = [pre_tokens(t) if t else [] for t in batch.column("text").to_pylist()]
                distinct = set().union(*split)
                new = list(distinct.difference(known))
                if len(known) + len(new) > CACHE:
                    known.clear()
                    new = list(distinct)
                if new:
                    learn(new)
                n = [sum(map(known.__getitem__, w)) for w in split]
                cuts = [text_cuts(model, w, list(map(known.__getitem__, w)), longest) if size > longest else (None, None) for w, size in zip(split, n)]
                firsts, places = zip(*cuts)
                columns = [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(firsts, pa.list_(pa.int64())), pa.array(places, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays([*columns, *batch.columns[2:]], ["doc_id", "n_tokens", "firsts", "places", *batch.schema.names[2:]])

    return count


_LENGTHS = "doc_id long, n_tokens long, firsts array<long>, places array<long>"


def piece_lengths(docs: DataFrame, path: str = MODEL, longest: int = 1 << 62, body: bool = False) -> DataFrame:
    """(doc_id, n_tokens, firsts, places) of each row: the model's pieces, 0 for null, and where a text with more than longest begins anew; with body its text too."""
    text = F.col("text").cast("string")
    wanted = docs.select(F.col("doc_id").cast("long"), text.alias("text"), *([text.alias("body")] if body else []))
    return wanted.mapInArrow(_counter(model_file(path), longest), _LENGTHS + ", body string" * body)


def cut(sizes: np.ndarray, longest: int) -> list[list[int] | None]:
    """The first tokens of the pieces of documents with sizes above the longest."""
    return [None if n <= longest else list(range(0, n, longest)) for n in sizes.tolist()]


def pieces(sizes: np.ndarray, firsts: list[list[int] | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, piece, first token, tokens) of all pieces."""
    own = [f or [0] for f in firsts]
    n = np.array([len(f) for f in own], np.int64)
    doc = np.repeat(np.arange(len(sizes)), n)
    piece = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
    first = np.array([x for f in own for x in f], np.int64)
    last = np.append(piece[1:] == 0, True) if len(doc) else np.zeros(0, bool)
    return doc, piece, first, np.where(last, sizes[doc], np.append(first[1:], 0)) - first


def best_fit(lengths: np.ndarray, capacities: tuple[int, int, int], weights: tuple[float, float, float], rule: str) -> np.ndarray:
    """The bin of each item, items in the order given; each item fits an empty bin."""
    cap = np.array(capacities, np.float64)
    w = np.array(weights) / cap**2
    residual = np.zeros((1024, 3))
    open_bins = np.zeros(1024, np.int64)
    opened = n_open = 0
    out = np.empty(len(lengths), np.int64)
    smallest = int(lengths.min()) if len(lengths) else 0
    for i, size in enumerate(lengths.tolist()):
        demand = np.array((size, 1.0, float(size) * size))
        left = residual[:n_open] - demand
        fits = np.flatnonzero((left >= 0).all(1))
        if len(fits):
            if rule == "dot":
                k = fits[np.argmax(residual[fits] @ (w * demand))]
            else:
                k = fits[np.argmin((left[fits] ** 2) @ w)]
            residual[k] = left[k]
        else:
            if n_open == len(residual):
                residual = np.concatenate((residual, np.zeros_like(residual)))
                open_bins = np.concatenate((open_bins, np.zeros_like(open_bins)))
            k = n_open
            residual[k], open_bins[k] = cap - demand, opened
            n_open += 1
            opened += 1
        out[i] = open_bins[k]
        if residual[k][0] < smallest or residual[k][1] < 1 or residual[k][2] < smallest * smallest:
            # nothing fits any more: close it, keeping the order of the others
            residual[k : n_open - 1] = residual[k + 1 : n_open].copy()
            open_bins[k : n_open - 1] = open_bins[k + 1 : n_open].copy()
            n_open -= 1
    return out


def _packer(capacities: tuple[int, int, int], weights: tuple[float, float, float], rule: str):
    longest = longest_piece(capacities)

    def pack(table: pa.Table) -> pa.Table:
        shard = table.column("shard")[0].as_py()
        ids = table.column("doc_id")
        null = ids.is_null().to_numpy(zero_copy_only=False)
        keys = ids.fill_null(0).to_numpy()
        sizes = table.column("n_tokens").to_numpy()
        known = table.column("firsts").to_pylist() if "firsts" in table.column_names else cut(sizes, longest)
        # equal lengths and ids differ only in their texts, if at all
        texts = table.column("body").to_pylist() if "body" in table.column_names else None
        order = np.lexsort((keys, ~null)) if texts is None else np.array(sorted(range(len(keys)), key=lambda i: (not null[i], keys[i], texts[i])), np.int64)
        doc, piece, first, n = pieces(sizes[order], [known[i] for i in order])
        turn = np.lexsort((piece, doc, -n))
        doc, piece, first, n = order[doc[turn]], piece[turn], first[turn], n[turn]
        bins = best_fit(n, capacities, weights, rule)
        by_bin = np.argsort(bins, kind="stable")
        begins = np.concatenate(([True], bins[by_bin][1:] != bins[by_bin][:-1]))
        at = np.arange(len(bins))
        position = at - np.maximum.accumulate(np.where(begins, at, 0))
        doc, piece, first, n, bins = doc[by_bin], piece[by_bin], first[by_bin], n[by_bin], bins[by_bin]
        columns = [pa.array((shard << 32) + bins), pa.array(position.astype(np.int32)), ids.combine_chunks().take(pa.array(doc)), pa.array(piece.astype(np.int32)), pa.array(first), pa.array(n)]
        names = ["bin_id", "position", "doc_id", "piece", "first_token", "n_tokens"]
        if texts is None:
            return pa.table(columns, names=names)
        places = table.column("places").to_pylist()

        def part(d: int, k: int) -> str:
            own = places[d]
            return texts[d] if own is None else texts[d][own[k] : own[k + 1] if k + 1 < len(own) else None]

        return pa.table([*columns, pa.array(map(part, doc.tolist(), piece.tolist()), pa.string())], names=[*names, "text"])

    return pack


def longest_piece(capacities: tuple[int, int, int]) -> int:
    return min(capacities[0], math.isqrt(capacities[2]))


def _in_shards(lengths: DataFrame, shards: int) -> DataFrame:
    return lengths.where("n_tokens > 0").withColumn("shard", F.pmod(F.xxhash64("doc_id", F.when(F.col("doc_id").isNull(), F.col("n_tokens"))), F.lit(shards)))


def _checked(capacities: tuple[int, int, int], rule: str) -> None:
    if rule not in ("dot", "norm") or min(capacities) < 1:
        raise ValueError("rule is dot or norm, capacities are 1 or more")


def pack_documents(
    docs: DataFrame,
    tokens: Column | None = None,
    capacities: tuple[int, int, int] = (MAX_TOKENS, MAX_DOCS, MAX_ATTENTION),
    weights: tuple[float, float, float] = WEIGHTS,
    rule: str = RULE,
    shard_docs: int = SHARD_DOCS,
    model: str | None = None,
) -> DataFrame:
    """(bin_id, position, doc_id, piece, first_token, n_tokens): where each piece of each document lies. A document's length is tokens, or its pieces under model, or its words."""
    _checked(capacities, rule)
    shards = max(1, -(-docs.count() // shard_docs))
    if tokens is None and model is not None:
        lengths = piece_lengths(docs, model, longest_piece(capacities)).drop("places")
    else:
        lengths = docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            (word_tokens(F.col("text").cast("string")) if tokens is None else tokens.cast("long")).alias("n_tokens"),
        )
    return _in_shards(lengths, shards).groupBy("shard").applyInArrow(_packer(capacities, weights, rule), SCHEMA)


def pack_texts(
    docs: DataFrame,
    capacities: tuple[int, int, int] = (MAX_TOKENS, MAX_DOCS, MAX_ATTENTION),
    weights: tuple[float, float, float] = WEIGHTS,
    rule: str = RULE,
    shard_docs: int = SHARD_DOCS,
    model: str = MODEL,
) -> DataFrame:
    """As pack_documents by the model's pieces, with the text of each piece; a document's pieces, one after the other, are its text."""
    _checked(capacities, rule)
    shards = max(1, -(-docs.count() // shard_docs))
    lengths = piece_lengths(docs, model, longest_piece(capacities), body=True)
    return _in_shards(lengths, shards).groupBy("shard").applyInArrow(_packer(capacities, weights, rule), SCHEMA + ", text string")
