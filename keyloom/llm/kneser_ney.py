"""Quality classifier: interpolated modified Kneser-Ney model of trusted text, per language, over UTF-8 bytes.

The tokens are bytes (order 5, four start symbols before each text): alphabets of any language fit, no word is out of
vocabulary, and an n-gram is an exact 40-bit integer.  Lower orders use continuation counts; every order has the three
discounts of modified Kneser-Ney, from its own counts of counts; the base is uniform over the 256 bytes.  A discount that these counts
put outside (0, count) gives way to the single discount n1 / (n1 + 2 n2), or one half, so that every order leaves some weight
to the one below and no probability is 0.  Log probabilities are summed as integers of 2^-20, exactly, whatever the order and the partitions.

Plan.  (1) Training: trusted documents (labels with quality 1 and toxic 0) lose a hashed share that is held out; Arrow
tasks count the n-grams of their slice and send them, packed, to shards of the hash of (language, last two context
bytes).  All n-grams, suffixes and contexts of orders 3 to 5 that one probability needs lie in one shard, so a shard
derives its lower orders by itself (a pair of bytes has at most 256^3 n-grams).  Only counts of counts and the continuation counts of byte pairs, which are no more
than 65,536 a language whatever the input, come to the driver.
(2) Scoring: documents are shuffled once into blocks; a block asks for its distinct n-grams, packed by shard.  A shard's model and the requests for it
lie in one partition, the model first, and the requests are streamed past it (the count join), so that memory holds one shard and one batch; the answers are
cogrouped with the block's texts, whose exchange Spark reuses.  Requests are distinct n-grams of a block, not occurrences, so they are a small part of the text, and both sides grow
with the input.  A block holds about BLOCK_TEXT bytes of text and is a task of its own; shards are
as many as blocks up to MAX_SHARDS (there are few thousand pairs of bytes to divide by), so that a block's requests are a bounded number of rows.
(3) A document is rejected if its per-byte perplexity exceeds a quantile of its language among held-out trusted documents (the value of that rank, found by a
histogram and an exact rank within one of its cells); a language with fewer than MIN_HELD of these takes the larger of its own quantile and that of all.

The trusted ids are broadcast only up to BROADCAST_IDS of them (their number is counted first); beyond that the join
shuffles.

Defined results: null and empty texts have a null perplexity and are rejected; a null language is a language of its own
("und"); a null or unknown label is not trusted; every row of documents is scored by itself, also rows that share a doc_id or have none; repeated rows of labels count
once and a document with conflicting labels is not trusted; a language without any trusted text can't be judged: every perplexity is 256 (the uniform
base) and its documents with text are kept; columns other than doc_id, lang and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keyloom.llm.common import blocks_for, mix64, packed_by_block, read_blocks, utf8
from keyloom.session import checkpoint

ORDER = 5
PAD = b"\xff" * (ORDER - 1)
HOLD_OUT = 8
QUANTILE = 0.995
MIN_HELD = 20
BROADCAST_IDS = 4_000_000
BLOCK_TEXT = 16 << 20
MAX_SHARDS = 1024
UNIT = 1 << 20
CELLS = 4096
TRAIN_SLICE = 16 << 20
PIECE = 1 << 20
U64 = np.uint64


def grams_of(buffer: np.ndarray) -> np.ndarray:
    """The n-gram that ends at each byte from the ORDERth on."""
    n = len(buffer) - ORDER + 1
    if n <= 0:
        return np.zeros(0, U64)
    g = np.zeros(n, U64)
    for j in range(ORDER):
        g <<= U64(8)
        g |= buffer[j : j + n]
    return g


def padded(texts: list[bytes]) -> np.ndarray:
    return np.frombuffer(PAD + PAD.join(texts), np.uint8)


def counted(buffer: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of a padded buffer in ascending order, and how often each occurs; taken piece by piece."""
    keys, counts = [], []
    for s in range(0, max(1, len(buffer) - ORDER + 1), PIECE):
        part = buffer[s : s + PIECE + ORDER - 1]
        g = grams_of(part)
        g = g[part[ORDER - 1 :] != 255]
        if len(g):
            k, c = distinct(g)
            keys.append(k)
            counts.append(c)
    return summed(keys, counts)


def distinct(g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    g = np.sort(g)
    first = np.flatnonzero(np.concatenate(([True], g[1:] != g[:-1])))
    return g[first], np.diff(np.append(first, len(g)))


def summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    if not keys:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    if len(keys) == 1:
        return keys[0], counts[0].astype(np.int64)
    k, c = np.concatenate(keys), np.concatenate(counts).astype(np.int64)
    order = np.argsort(k, kind="stable")
    k, c = k[order], c[order]
    first = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1]))) if len(k) else np.zeros(0, np.int64)
    return k[first], np.add.reduceat(c, first) if len(first) else c


def shard_of(grams: np.ndarray, lang: str, shards: int) -> np.ndarray:
    pair = (grams >> U64(8)) & U64(0xFFFF)
    return (mix64(pair + U64(xxhash.xxh64_intdigest(lang.encode()) & ~0xFFFF & (2**64 - 1))) % U64(shards)).astype(np.int64)


def pack(a: np.ndarray) -> bytes:
    """Sorted integers by byte planes, compressed: the high planes nearly vanish."""
    planes = np.ascontiguousarray(a.astype(U64).view(np.uint8).reshape(-1, 8).T)
    return zstandard.compress(planes.tobytes(), 1)


def unpack(b: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(b), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view(U64).ravel()


def by_shard(grams: np.ndarray, lang: str, shards: int) -> Iterator[tuple[int, np.ndarray]]:
    """The positions of grams by shard, ascending in each."""
    s = shard_of(grams, lang, shards)
    order = np.argsort(s, kind="stable")
    cuts = np.flatnonzero(np.concatenate(([True], s[order][1:] != s[order][:-1]))) if len(s) else np.zeros(0, np.int64)
    for a, b in zip(cuts, np.append(cuts[1:], len(s))):
        yield int(s[order[a]]), order[a:b]


# training


def _counter(shards: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts: dict[str, list[bytes]] = {}
        held: dict[str, tuple[list, list]] = {}
        size = 0

        def absorb() -> None:
            for lang, own in texts.items():
                k, c = counted(padded(own))
                known = held.setdefault(lang, ([], []))
                known[0].append(k)
                known[1].append(c)
                if len(known[0]) >= 4:
                    k, c = summed(*known)
                    held[lang] = ([k], [c])
            texts.clear()

        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                raw = text.encode()
                texts.setdefault(lang, []).append(raw)
                size += len(raw)
                if size > TRAIN_SLICE:
                    absorb()
                    size = 0
        absorb()
        rows: tuple[list, list, list, list] = ([], [], [], [])
        for lang, known in held.items():
            k, c = summed(*known)
            for shard, at in by_shard(k, lang, shards):
                for column, value in zip(rows, (shard, lang, pack(k[at]), pack(c[at]))):
                    column.append(value)
        yield pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int32()), pa.array(rows[1], pa.string()), pa.array(rows[2], pa.binary()), pa.array(rows[3], pa.binary())], ["shard", "lang", "grams", "counts"])

    return count


def lower(grams: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct suffixes of distinct n-grams, and how many n-grams end in each: continuation counts."""
    return distinct(grams & U64((1 << bits) - 1)) if len(grams) else (grams, np.zeros(0, np.int64))


def counts_of_counts(c: np.ndarray) -> list[int]:
    return [int((c == i).sum()) for i in (1, 2, 3, 4)]


def _merge_shard(table: pa.Table) -> pa.Table:
    """One shard's model rows: for each language its n-grams with their counts, and what the whole model needs of it."""
    out: dict[str, list] = {n: [] for n in ("shard", "lang", "grams", "counts", "stats", "pairs", "pair_counts")}
    langs = table.column("lang").to_pylist()
    for lang in sorted(set(langs)):
        mine = [i for i, x in enumerate(langs) if x == lang]
        k, c = summed([unpack(table.column("grams")[i].as_py()) for i in mine], [unpack(table.column("counts")[i].as_py()).astype(np.int64) for i in mine])
        k4, c4 = lower(k, 32)
        k3, c3 = lower(k4, 24)
        k2, c2 = lower(k3, 16)
        stats = [x for c_ in (c, c4, c3) for x in counts_of_counts(c_)]
        for name, value in zip(out, (table.column("shard")[0].as_py(), lang, pack(k), pack(c), stats, k2.astype(np.int64).tolist(), c2.tolist())):
            out[name].append(value)
    return pa.table([pa.array(out["shard"], pa.int32()), pa.array(out["lang"], pa.string()), pa.array(out["grams"], pa.binary()), pa.array(out["counts"], pa.binary()), pa.array(out["stats"], pa.list_(pa.int64())), pa.array(out["pairs"], pa.list_(pa.int64())), pa.array(out["pair_counts"], pa.list_(pa.int64()))], names=list(out))


MODEL = "shard int, lang string, grams binary, counts binary, stats array<long>, pairs array<long>, pair_counts array<long>"


def discounts(n: list[int]) -> np.ndarray:
    """The discounts of counts 0, 1, 2 and 3 or more, from the numbers of n-grams with counts 1 to 4; each lies inside (0, count)."""
    n1, n2, n3, n4 = n
    single = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
    d = [0.0]
    for i, (low, high) in enumerate(((n1, n2), (n2, n3), (n3, n4)), 1):
        own = i - (i + 1) * single * high / low if low else 0.0
        d.append(own if high and 0 < own < i else single)
    return np.array(d)


def interpolated(count: np.ndarray, at: np.ndarray, contexts: tuple, context_at: np.ndarray, d: np.ndarray, below: np.ndarray) -> np.ndarray:
    """One order's probabilities. count[at] (0 where at < 0) in context number context_at (unseen where < 0), over the order below."""
    total, gamma = contexts
    seen = context_at >= 0
    c = np.where(at >= 0, count[np.maximum(at, 0)] if len(count) else 0, 0).astype(np.float64)
    c -= d[np.minimum(c, 3).astype(np.int64)]
    i = np.maximum(context_at, 0)
    if not len(total):
        return below
    return np.where(seen, c / total[i] + gamma[i] * below, below)


def context_table(keys: np.ndarray, counts: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray]]:
    """Contexts of sorted n-grams: their keys, and the total and the weight of the order below of each."""
    h = keys >> U64(8)
    if not len(h):
        return h, (np.zeros(0), np.zeros(0))
    first = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
    total = np.add.reduceat(counts, first).astype(np.float64)
    # how many of a context's n-grams (256 at most) have count 1, 2, and 3 or more, side by side in one integer
    kinds = np.add.reduceat(np.left_shift(1, 20 * (np.minimum(counts, 3) - 1)), first)
    taken = (kinds & 0xFFFFF) * d[1] + (kinds >> 20 & 0xFFFFF) * d[2] + (kinds >> 40) * d[3]
    return h[first], (total, taken / total)


def find(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    if not len(keys):
        return np.full(len(wanted), -1)
    i = np.searchsorted(keys, wanted)
    i[i == len(keys)] = 0
    return np.where(keys[i] == wanted, i, -1)


def pair_model(pairs: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Probabilities of the second byte after the first, a 256 x 256 array, from continuation counts of byte pairs."""
    k, c = summed([pairs.astype(U64)], [counts]) if not len(pairs) else summed([pairs.astype(U64), pairs[:0].astype(U64)], [counts, counts[:0]])
    uniform = np.full(256, 1 / 256)
    single = np.bincount((k & U64(255)).astype(np.int64), minlength=256)
    d1 = discounts(counts_of_counts(single))
    one = (single - d1[np.minimum(single, 3)]) / single.sum() + d1[np.minimum(single, 3)].sum() / single.sum() * uniform if len(k) else uniform
    two = np.zeros((256, 256), np.int64)
    two.ravel()[k.astype(np.int64)] = c
    d2 = discounts(counts_of_counts(c))
    total = two.sum(1, keepdims=True)
    cut = d2[np.minimum(two, 3)]
    with np.errstate(divide="ignore", invalid="ignore"):
        p = (two - cut) / total + cut.sum(1, keepdims=True) / total * one
    return np.where(total > 0, p, one)


class Model:
    """What every shard needs besides its own n-grams: discounts of orders 5, 4, 3 and byte-pair probabilities, by language."""

    def __init__(self, rows: list) -> None:
        stats: dict[str, np.ndarray] = {}
        pairs: dict[str, list] = {}
        for r in rows:
            stats[r.lang] = stats.get(r.lang, 0) + np.array(r.stats)
            pairs.setdefault(r.lang, []).append((np.array(r.pairs, np.int64), np.array(r.pair_counts, np.int64)))
        self.discounts = {lang: [discounts([int(x) for x in s[4 * i : 4 * i + 4]]) for i in range(3)] for lang, s in stats.items()}
        self.pairs = {lang: pair_model(np.concatenate([p for p, _ in own]), np.concatenate([c for _, c in own])) for lang, own in pairs.items()}

    def orders(self, lang: str, k5: np.ndarray, c5: np.ndarray) -> list[tuple]:
        """A shard's n-grams of orders 3, 4 and 5 of a language with what their contexts leave, ready for log_probabilities."""
        if lang not in self.pairs:
            return []
        k4, c4 = lower(k5, 32)
        k3, c3 = lower(k4, 24)
        d5, d4, d3 = self.discounts[lang]
        return [(keys, counts, d, bits, *context_table(keys, counts, d)) for keys, counts, d, bits in ((k3, c3, d3, 24), (k4, c4, d4, 32), (k5, c5, d5, 40))]

    def log_probabilities(self, wanted: np.ndarray, lang: str, k5: np.ndarray, c5: np.ndarray) -> np.ndarray:
        return self.logs(wanted, lang, self.orders(lang, k5, c5))

    def logs(self, wanted: np.ndarray, lang: str, orders: list[tuple]) -> np.ndarray:
        if lang not in self.pairs:
            return np.full(len(wanted), -np.log(256.0))
        p = self.pairs[lang].ravel()[(wanted & U64(0xFFFF)).astype(np.int64)]
        for keys, counts, d, bits, h, contexts in orders:
            w = wanted & U64((1 << bits) - 1)
            p = interpolated(counts, find(keys, w), contexts, find(h, w >> U64(8)), d, p)
        return np.log(p)


def train(trusted: DataFrame, shards: int) -> tuple[DataFrame, Model]:
    """The sharded counts of trusted (lang, text), written to the shared folder, and the model's common part."""
    counts = trusted.select("lang", "text").mapInArrow(_counter(shards), "shard int, lang string, grams binary, counts binary")
    model = checkpoint(counts.groupBy("shard").applyInArrow(_merge_shard, MODEL))
    bounded = (
        model.select("lang", "stats", F.posexplode("pairs").alias("i", "pair"), "pair_counts")
        .select("lang", "pair", F.expr("pair_counts[i]").alias("n"))
        .groupBy("lang", "pair").agg(F.sum("n").alias("n"))
        .groupBy("lang").agg(F.collect_list("pair").alias("pairs"), F.collect_list("n").alias("pair_counts"))
    )
    stats = model.groupBy("lang").agg(F.array(*[F.sum(F.col("stats")[i]) for i in range(12)]).alias("stats"))
    return model.select("shard", "lang", "grams", "counts"), Model(bounded.join(stats, "lang").collect())


# scoring


def row_key() -> Column:
    """What tells rows of one doc_id apart: a 64-bit hash of language and text."""
    return F.xxhash64(F.coalesce(F.col("lang").cast("string"), F.lit("und")), F.col("text").cast("string"))


def doc_blocks(docs: DataFrame, blocks: int) -> DataFrame:
    """(block, body): documents by the hash of doc_id and text, compressed."""
    keyed = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        row_key().alias("row_key"),
        F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"),
        F.col("text").cast("string").alias("text"),
    )
    return keyed.select(F.pmod(F.xxhash64("doc_id", "row_key"), F.lit(blocks)).cast("int").alias("block"), "*").mapInArrow(packed_by_block, "block int, body binary")


def _by_lang(batch: pa.RecordBatch) -> Iterator[tuple[str, np.ndarray, list[bytes]]]:
    langs = np.array(batch.column("lang").to_pylist(), object)
    data, off = utf8(batch.column("text"))
    raw = data.tobytes()
    for lang in sorted(set(langs)):
        at = np.flatnonzero(langs == lang)
        yield lang, at, [raw[off[i] : off[i + 1]] for i in at]


def _requests(shards: int):
    def ask(table: pa.Table) -> pa.Table:
        block = table.column("block")[0].as_py()
        found: dict[str, tuple[list, list]] = {}
        for batch in read_blocks(table.column("body")):
            for lang, _, texts in _by_lang(batch):
                k, _ = counted(padded(texts))
                own = found.setdefault(lang, ([], []))
                own[0].append(k)
                own[1].append(np.ones(len(k), np.int64))
                if len(own[0]) >= 8:
                    k, c = summed(*own)
                    found[lang] = ([k], [c])
        rows: list[tuple] = []
        for lang, own in found.items():
            k, _ = summed(*own)
            rows += [(shard, block, lang, pack(k[at])) for shard, at in by_shard(k, lang, shards)]
        cols = list(zip(*rows)) or [[]] * 4
        return pa.table([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.string()), pa.array(cols[3], pa.binary())], names=["shard", "block", "lang", "grams"])

    return ask


def _answers(model: Model):
    """Requests sorted by shard, each shard's model rows (with a null block) before them."""

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, known = None, {}
        for batch in batches:
            shards, blocks, langs, grams, counts = (batch.column(n).to_pylist() for n in ("shard", "block", "lang", "grams", "counts"))
            asked: dict[tuple[int, str], list[int]] = {}
            out: list[bytes] = [b""] * len(shards)

            def settle() -> None:
                for (_, lang), own in asked.items():
                    wanted_of = [unpack(grams[i]) for i in own]
                    wanted = distinct(np.concatenate(wanted_of))[0]
                    logs = np.rint(model.logs(wanted, lang, known.get(lang, [])) * UNIT).astype(np.int32)
                    for i, w in zip(own, wanted_of):
                        out[i] = logs[np.searchsorted(wanted, w)].tobytes()
                asked.clear()

            for i, (s, block, lang) in enumerate(zip(shards, blocks, langs)):
                if s != shard:
                    settle()
                    shard, known = s, {}
                if block is None:
                    known[lang] = model.orders(lang, unpack(grams[i]), unpack(counts[i]).astype(np.int64))
                else:
                    asked.setdefault((s, lang), []).append(i)
            settle()
            told = [i for i, block in enumerate(blocks) if block is not None]
            rows = batch.select(["block", "lang", "grams"]).take(pa.array(told, pa.int64()))
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array([out[i] for i in told], pa.binary())], ["block", "lang", "grams", "logs"])

    return answer


def document_sums(texts: list[bytes], keys: np.ndarray, logs: np.ndarray) -> np.ndarray:
    """The sum of the logs (integers) of each text's bytes; keys holds all their n-grams."""
    buffer = padded(texts)
    sizes = np.array([len(t) for t in texts], np.int64)
    begins = np.cumsum(sizes + ORDER - 1) - sizes  # where each text's bytes begin, and so the places of their n-grams' last bytes
    out = np.zeros(len(texts), np.int64)
    for s in range(0, len(buffer) - ORDER + 1, PIECE):
        part = buffer[s : s + PIECE + ORDER - 1]
        g = grams_of(part)
        ok = part[ORDER - 1 :] != 255
        a = np.minimum(np.searchsorted(keys, g), max(0, len(keys) - 1))
        running = np.zeros(len(g) + 1, np.int64)
        if len(keys):
            np.cumsum(np.where(ok, logs[a], 0), out=running[1:])
        lo = np.clip(begins - (ORDER - 1) - s, 0, len(g))
        hi = np.clip(begins + sizes - (ORDER - 1) - s, 0, len(g))
        out += running[hi] - running[lo]
    return out


def _scores(blocks: pa.Table, answers: pa.Table) -> pa.Table:
    known: dict[str, tuple[list, list]] = {}
    for lang, grams, logs in zip(answers.column("lang").to_pylist(), answers.column("grams").to_pylist(), answers.column("logs").to_pylist()):
        own = known.setdefault(lang, ([], []))
        own[0].append(unpack(grams))
        own[1].append(np.frombuffer(logs, np.int32))
    tables = {}
    for lang, (k, p) in known.items():
        keys = np.concatenate(k)
        order = np.argsort(keys)
        tables[lang] = keys[order], np.concatenate(p)[order].astype(np.int64)
    none = (np.zeros(0, U64), np.zeros(0, np.int64))
    ids, row_keys, langs, sizes, sums = [], [], [], [], []
    for batch in read_blocks(blocks.column("body")):
        for lang, at, texts in _by_lang(batch):
            ids.append(batch.column("doc_id").take(pa.array(at)))
            row_keys.append(batch.column("row_key").take(pa.array(at)))
            langs += [lang] * len(at)
            sizes += [len(t) for t in texts]
            sums.append(document_sums(texts, *tables.get(lang, none)))
    total, n = np.concatenate(sums) if sums else np.zeros(0, np.int64), np.array(sizes, np.int64)
    ppl = np.exp(-total / UNIT / np.maximum(n, 1))
    if not np.isfinite(ppl).all():
        raise ArithmeticError("a perplexity isn't finite")
    return pa.table([pa.chunked_array(ids, pa.int64()), pa.chunked_array(row_keys, pa.int64()), pa.array(langs, pa.string()), pa.array(n), pa.array(ppl, mask=n == 0)], names=["doc_id", "row_key", "lang", "n_bytes", "perplexity"])


def block_number(docs: DataFrame) -> int:
    """Blocks of about BLOCK_TEXT bytes of text."""
    size = docs.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0
    return blocks_for(size, BLOCK_TEXT, docs.sparkSession.sparkContext.defaultParallelism)


def score(docs: DataFrame, model: DataFrame, common: Model, shards: int, blocks: int | None = None) -> DataFrame:
    """(doc_id, row_key, lang, n_bytes, perplexity) of each document."""
    blocks = blocks or block_number(docs)
    bodies = doc_blocks(docs, blocks).repartitionById(blocks, "block")
    requests = bodies.groupBy("block").applyInArrow(_requests(shards), "shard int, block int, lang string, grams binary")
    both = model.select("shard", F.lit(None).cast("int").alias("block"), "lang", "grams", "counts").unionByName(requests.withColumn("counts", F.lit(None).cast("binary")))
    # model rows first in each shard
    by_shard = both.repartitionById(shards, "shard").sortWithinPartitions("shard", F.col("block").asc_nulls_first())
    answers = by_shard.mapInArrow(_answers(common), "block int, lang string, grams binary, logs binary").repartitionById(blocks, "block")
    return bodies.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_scores, "doc_id long, row_key long, lang string, n_bytes long, perplexity double")


def trusted_ids(labels: DataFrame) -> DataFrame:
    """doc_id of documents all of whose labels say quality 1 and toxic 0."""
    good = F.coalesce((F.col("quality") == 1) & (F.col("toxic") == 0), F.lit(False))
    return labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(good.cast("int")).alias("good")).where("good = 1").select("doc_id")


def quantiles(values: DataFrame, q: float) -> list:
    """(lang, n, high) of each language, and of all under a null lang: the smallest perplexity that at least a share q of n values doesn't exceed.

    A histogram finds the cell of each quantile, and only the values of that cell are ranked.
    """
    spread = values.select(F.explode(F.array("lang", F.lit(None).cast("string"))).alias("lang"), "perplexity").withColumn("cell", F.floor(F.log("perplexity") * CELLS))
    cells = spread.groupBy("lang", "cell").agg(F.count(F.lit(1)).alias("m"))
    own = Window.partitionBy("lang")
    upto = cells.select("lang", "cell", "m", F.sum("m").over(own.orderBy("cell")).alias("upto"), F.sum("m").over(own).alias("n"))
    wanted = F.ceil(F.col("n") * F.lit(q))
    cell = upto.where((F.col("upto") >= wanted) & (F.col("upto") - F.col("m") < wanted)).select(F.col("lang").alias("__lang"), F.col("cell").alias("__cell"), "n", (wanted - F.col("upto") + F.col("m")).alias("turn"))
    there = spread.join(cell, spread.lang.eqNullSafe(F.col("__lang")) & (F.col("cell") == F.col("__cell")))
    ranked = there.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("perplexity")))
    return ranked.where("rank = turn").select("lang", "n", F.col("perplexity").alias("high")).collect()


def thresholds(found: list, langs: list[str]) -> list[tuple[str, float]]:
    """(lang, high) of each language with a model."""
    by = {r.lang: r for r in found}
    whole = by[None].high if None in by else float("inf")
    return [(lang, whole if lang not in by else by[lang].high if by[lang].n >= MIN_HELD else max(whole, by[lang].high)) for lang in langs]


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, row_key, lang, n_bytes, perplexity, keep) of each document."""
    spark = docs.sparkSession
    blocks = block_number(docs)
    ids = trusted_ids(labels)
    if ids.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text"))
    is_held = F.pmod(F.xxhash64("doc_id", F.lit("held out")), F.lit(HOLD_OUT)) == 0
    trusted = named.where("length(text) > 0").where(~is_held).join(ids, "doc_id", "left_semi")
    shards = min(blocks, MAX_SHARDS)
    model, common = train(trusted, shards)
    scored = checkpoint(score(docs, model, common, shards, blocks))
    langs = sorted(common.pairs)
    held = scored.where(is_held).where("perplexity is not null").where(F.col("lang").isin(langs)).join(ids, "doc_id", "left_semi")
    high = spark.createDataFrame(thresholds(quantiles(held.select("lang", "perplexity"), QUANTILE), langs), "lang string, high double")
    keep = F.coalesce(F.col("perplexity") <= F.coalesce("high", F.lit(float("inf"))), F.lit(False))
    return scored.join(high, "lang", "left").select("doc_id", "row_key", "lang", "n_bytes", "perplexity", keep.alias("keep"))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, lang, n_bytes, perplexity, keep) of each row."""
    return judged(docs, labels).drop("row_key")


def keep_trusted_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without the rows that are rejected, all columns as they are; a row is known by doc_id (which may be null), language and text."""
    kept = judged(docs, labels).where("keep").select(F.col("doc_id").alias("__kept"), F.col("row_key").alias("__row")).distinct()
    return docs.join(kept, F.col("doc_id").cast("long").eqNullSafe(F.col("__kept")) & (row_key() == F.col("__row")), "left_semi")
