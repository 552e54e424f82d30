"""SimHash near-duplicates by multi-index hashing.

A fingerprint is cut into two 32-bit segments. If two fingerprints differ in at
most two bits, one of their segments differs in at most one bit. So each
fingerprint looks up, per segment, the 33 values of the Hamming ball of radius
one in the table of all segments; the complete distance is the join condition.
Only distinct fingerprints take part, so copies never make pairs. Links are
joined into components by minimum labels with pointer jumping, each round
written to the shared folder.

Edge cases: null text counts as empty; texts without words have fingerprint
zero, which links like any other; repeated rows stay repeated; rows with a null
doc_id belong to their fingerprint's group but never name a component; an empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, keep_only, python_ready, stored, text_digest

SHINGLE_WORDS = 3
MAX_BITS = 2
SEED = 42


def fingerprint(text: str | None) -> int:
    """Unsigned 64-bit SimHash of the word shingles of one whole text."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    n = len(words) - SHINGLE_WORDS + 1
    if not words:
        return 0
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if n < 2:
        return digest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts[:n].tolist(), ends[SHINGLE_WORDS - 1 :].tolist())], dtype=np.uint64)
    ones = np.zeros(64, dtype=np.int64)
    for part in range(0, n, 1 << 16):  # bounded memory for very long texts
        ones += np.unpackbits(hashes[part : part + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view(np.uint64)[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        made = np.array([fingerprint(t) for t in batch.column(1).to_pylist()], dtype=np.uint64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made.view(np.int64), pa.int64()), *batch.columns[2:]], ["doc_id", "fp", *batch.schema.names[2:]])


def fingerprints(docs: DataFrame, digest: bool = False) -> DataFrame:
    """(doc_id, fp long) for each row of ``docs``; with its text's ``digest`` if asked."""
    python_ready(docs.sparkSession)
    more = [text_digest().alias("digest")] if digest else []
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"), *more).mapInArrow(_fingerprints, "doc_id long, fp long" + ", digest binary" * digest)


def links(distinct: DataFrame) -> DataFrame:
    """(a, b), a < b: the pairs of distinct fingerprints at most two bits apart."""
    low, high = F.col("fp").bitwiseAND(0xFFFFFFFF), F.shiftrightunsigned("fp", 32)
    second = 1 << 32  # tells the second segment's keys from the first's
    balls = F.array(F.lit(0).cast("long"), *[F.lit(1 << i).cast("long") for i in range(32)])
    found = distinct.select(F.col("fp").alias("b"), F.explode(F.array(low, high.bitwiseOR(second))).alias("key"))
    asked = distinct.select(F.col("fp").alias("a"), F.explode(F.array(low, high.bitwiseOR(second))).alias("segment"))
    asked = asked.select("a", F.explode(F.transform(balls, lambda m: m.bitwiseXOR(F.col("segment")))).alias("key"))
    close = (F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= MAX_BITS)
    return asked.join(found, (asked["key"] == found["key"]) & close).select("a", "b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node reachable, for every node that has an edge.

    Each round takes the smallest label among a node and its neighbours, then
    the label of that label; it ends when no label changes.
    """
    both = stored(edges.select(F.col("a").alias("node"), F.col("b").alias("other")).union(edges.select(F.col("b"), F.col("a"))), "edges")
    labels = stored(both.groupBy("node").agg(F.least(F.min("other"), F.col("node")).alias("root"), F.lit(True).alias("moved")), "labels")
    while not labels.where("moved").isEmpty():
        near = both.join(labels.select(F.col("node").alias("other"), "root"), "other").groupBy("node").agg(F.min("root").alias("near"))
        hop = labels.select("node", F.col("root").alias("old")).join(near, "node").select("node", "old", F.least("old", "near").alias("mid"))
        jump = labels.select(F.col("node").alias("mid"), F.col("root").alias("far"))
        labels = stored(hop.join(jump, "mid").select("node", F.least("mid", "far").alias("root"), (F.least("mid", "far") < F.col("old")).alias("moved")), "labels", instead_of=labels)
    forget(both)
    return labels.select("node", "root")


def _grouped(marked: DataFrame) -> DataFrame:
    """(of, root, component_id, n_links) of each distinct fingerprint of ``marked``."""
    distinct = stored(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    edges = stored(links(distinct), "links")
    roots = components(edges)
    degree = edges.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("n_links"))
    linked = distinct.join(roots.join(degree, "node").withColumnRenamed("node", "fp"), "fp", "left")
    linked = stored(linked.select("fp", "least", F.coalesce("root", "fp").alias("root"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links")), "linked")
    least = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    return stored(linked.join(least, "root").select(F.col("fp").alias("of"), "root", "component_id", "n_links"), "components")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, fingerprint, component_id, n_links.

    n_links is the number of other fingerprints within two bits.
    """
    marked = stored(fingerprints(docs), "fingerprints")
    of = _grouped(marked)
    return marked.join(of, marked["fp"] == of["of"]).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "n_links"
    )


def one_of_each(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each component, that of the smallest doc_id;
    a null doc_id stays only where its component has no other."""
    marked = stored(fingerprints(docs, digest=True), "fingerprints")
    of = _grouped(marked)
    least = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "digest")).alias("least")
    keep = marked.join(of, marked["fp"] == of["of"]).groupBy("root").agg(least)
    return keep_only(docs, keep.select("least.doc_id", "least.digest"), text_digest())
