"""Exact document fingerprints: a wide digest of the canonical text, with byte comparison inside equal buckets.

The canonical text is NFKC-normalised, case-folded, normalised again (folding may undo NFKC) and has every run of
white space replaced by one blank, with none at either end.  Its 128-bit xxHash3 is the bucket; inside a bucket texts are compared byte by
byte, on their lossless compressed form (equal canonical texts and only they compress to equal bytes), so that a
collision of digests can't join two documents.

Plan: a first Arrow pass gives (doc_id, digest), kept in the shared folder; digests are counted with map-side combination, so that a text of any number of copies is no
large group.  Only rows whose digest occurs twice meet again with their bodies: these digests are joined to a second pass over the texts (broadcast up to BROADCAST_DIGESTS of them, which are counted first; beyond that the join shuffles
bodies), and (digest, body) is grouped, again with map-side combination.  A digest with one body is a group; should one have several, its rows are joined by body as well.
Nothing is collected.

Defined results: a null text has no digest and is a group of its own; empty and all-white-space texts share one group;
rows with a null doc_id take part, and a group of only such rows has a null canonical_id; a repeated row counts again
in n_copies; ties go to the smallest doc_id; other columns are not read, whatever they are called.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyloom.llm.common import text_slices
from keyloom.session import checkpoint

BROADCAST_DIGESTS = 1_000_000


def canonical(text: str) -> str:
    if text.isascii():
        return " ".join(text.lower().split())
    folded = unicodedata.normalize("NFKC", text).casefold()
    return " ".join(unicodedata.normalize("NFKC", folded).split())


def _canonical(batches: Iterator[pa.RecordBatch], bodies: bool) -> Iterator[pa.RecordBatch]:
    pack = zstandard.ZstdCompressor(level=3, write_checksum=False).compress
    for whole in batches:
        for batch in text_slices(whole, "text"):
            raw = [None if t is None else canonical(t).encode("utf-8", "surrogatepass") for t in batch.column("text").to_pylist()]
            columns = [batch.column("doc_id"), pa.array([None if r is None else xxhash.xxh3_128_digest(r) for r in raw], pa.binary())]
            if bodies:
                columns.append(pa.array([None if r is None else pack(r) for r in raw], pa.binary()))
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "digest", "body"][: len(columns)])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield from _canonical(batches, False)


def _bodies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield from _canonical(batches, True)


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))


def canonical_digest(docs: DataFrame) -> DataFrame:
    """(doc_id, digest, body) of each row: the 16-byte digest and the compressed canonical text."""
    return _texts(docs).mapInArrow(_bodies, "doc_id long, digest binary, body binary")


def exact_groups(docs: DataFrame) -> DataFrame:
    """(doc_id, canonical_id, n_copies): the smallest doc_id of the documents with the same canonical text, and their number."""
    return groups(checkpoint(_texts(docs).mapInArrow(_digests, "doc_id long, digest binary")), canonical_digest(docs))


def groups(known: DataFrame, full: DataFrame) -> DataFrame:
    """exact_groups of (doc_id, digest) and the same rows with their bodies."""
    twice = checkpoint(known.where("digest is not null").groupBy("digest").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("digest"))
    member = full.join(F.broadcast(twice) if twice.count() <= BROADCAST_DIGESTS else twice, "digest", "left_semi")
    by_body = checkpoint(member.groupBy("digest", "body").agg(F.min("doc_id").alias("canonical_id"), F.count(F.lit(1)).alias("n_copies")))
    bodies = by_body.groupBy("digest").agg(F.count(F.lit(1)).alias("bodies"), F.min("canonical_id").alias("canonical_id"), F.min("n_copies").alias("n_copies"))
    single = F.coalesce(F.col("bodies"), F.lit(1)) == 1
    # a digest that occurs once is a group of its own, as a null text is
    joined = known.join(bodies, "digest", "left").where(single)
    plain = joined.select("doc_id", F.when(F.col("bodies").isNull(), F.col("doc_id")).otherwise(F.col("canonical_id")).alias("canonical_id"), F.coalesce("n_copies", F.lit(1)).cast("long").alias("n_copies"))
    collided = by_body.join(bodies.where("bodies > 1").select("digest"), "digest", "left_semi")
    apart = member.join(collided, ["digest", "body"]).select("doc_id", "canonical_id", "n_copies")
    return plain.unionByName(apart)
