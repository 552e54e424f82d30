"""Benchmark decontamination by spaced-seed hashing, in DataFrame code only.

A fixed mask selects some token positions of a window and ignores the others, so
that a substituted word at an ignored position doesn't change the window's hash.
The hashed windows of test items and documents are joined; around each hit the
two token sequences are aligned and the overlap verified: a stretch of
``STRETCH`` words (or the whole item, if shorter) of which at least ``SIMILAR``
are equal at their positions.

Every overlap that the verification accepts has a seed. The mask 11010011 meets
13 words of which any two differ at some place where none of its five positions
does. Items under 13 words have masks of their own, which only cost documents
further windows if the benchmark holds such items: of four words for all of 4 to
12 words, whole items of one to three words.

A diagonal is one way to lay an item over a document. Windows carry keys and
places only; the words around a hit are cut out of the document for the distinct
diagonals alone, so time is linear in a text's length. Test windows are broadcast
only if their number is at most ``MAX_BROADCAST`` (counted; it bounds the items'
words as well), otherwise both sides are shuffled by hash.

Edge cases: null texts count as empty and overlap nothing; rows are told apart by
doc_id and text, so a null or repeated doc_id is judged by its own text; a null
item_id is reported as null; repeated rows give one result; empty tables give an
empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored, within, without_rows

STRETCH = 13
SIMILAR = 0.8
MAX_BROADCAST = 500_000
#: Masks, each with the item lengths it is for (13: that and more).
MASKS = {"11010011": (13,), "11101": (5, 6, 7, 8, 9, 10, 11, 12), "10111": (5, 6, 7), "1111": (4, 5, 10), "11011": (5,), "111": (3,), "11": (2,), "1": (1,)}


def token_hashes(text: Column) -> Column:
    parts = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda t: t != "")
    return F.transform(parts, lambda t: F.xxhash64(t))


def _seed(mask: str, h: Column) -> Callable[[Column], Column]:
    chosen = [k for k, c in enumerate(mask) if c == "1"]
    return lambda i: F.struct(F.xxhash64(F.lit(mask), *[F.get(h, i + k) for k in chosen]).alias("key"), i.alias("at"))


def _once(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)`` where ``value`` is worked out once per row, however often ``then`` names it."""
    return F.element_at(F.transform(F.array(value), then), 1)


def row_key() -> Column:
    """Tells rows of one doc_id apart by their text."""
    return F.xxhash64(F.coalesce("text", F.lit("")))


def windows(rows: DataFrame, keep: list[str], tokens: Column, masks: tuple[str, ...], items: bool = False) -> DataFrame:
    """One row per mask and window of ``tokens``: key, at, and ``keep``.

    Of ``items`` only those windows that their length calls for.
    """

    def made(h: Column) -> Column:
        parts = []
        for mask in masks:
            fits = F.size(h) >= len(mask)
            if items:
                fits = fits & F.least(F.size(h), F.lit(STRETCH)).isin(*MASKS[mask])
            starts = F.when(fits, F.sequence(F.lit(0), F.size(h) - len(mask))).otherwise(F.array().cast("array<int>"))
            parts.append(F.transform(starts, _seed(mask, h)))
        return F.concat(*parts)

    return rows.select(*keep, F.explode(_once(tokens, made)).alias("w")).select(*keep, "w.key", "w.at")


def _shape(items: DataFrame) -> tuple[tuple[str, ...], int]:
    """The masks that the lengths of ``items`` call for, and the greatest length."""
    n = F.size("b")
    row = items.agg(F.collect_set(F.least(n, F.lit(STRETCH))).alias("lengths"), F.max(n).alias("longest")).first()
    return tuple(mask for mask, of in MASKS.items() if set(row["lengths"]) & set(of)) or ("1",), row["longest"] or 1


def verified(diagonals: DataFrame) -> DataFrame:
    """Diagonals (piece, base, b) with the best stretch of each that has one:
    matched, stretch and ``first``, where in the item the first accepted stretch begins.

    ``piece`` is the part of the document that lies along the item ``b`` from its word ``base`` on.
    """
    need = F.least(F.size("b"), F.lit(STRETCH))
    equal = F.transform("piece", lambda word, i: F.coalesce(word == F.get("b", i + F.col("base")), F.lit(False)).cast("int"))
    rows = diagonals.withColumn("stretch", need).where(F.size("piece") >= F.col("stretch")).withColumn("equal", equal)
    sums = F.transform(F.sequence(F.lit(0), F.size("equal") - F.col("stretch")), lambda j: F.aggregate(F.slice("equal", j + 1, F.col("stretch")), F.lit(0), lambda s, x: s + x))
    rows = rows.withColumn("sums", sums).withColumn("matched", F.array_max("sums")).where(F.col("matched") >= F.ceil(F.col("stretch") * SIMILAR))
    at = F.filter(F.transform("sums", lambda s, j: F.when(s >= F.ceil(F.col("stretch") * SIMILAR), j)), lambda j: j.isNotNull())
    return rows.withColumn("first", F.col("base") + F.element_at(at, 1))


def _found(docs: DataFrame, tests: DataFrame, max_broadcast: int) -> DataFrame:
    """doc_id, row, item_id, matched, stretch, near_word; one row per document row and item."""
    items = tests.select(F.col("item_id").cast("long").alias("item_id"), token_hashes(F.col("text")).alias("b")).distinct()
    items = items.where(F.size("b") > 0).withColumn("item", F.xxhash64("item_id", "b"))
    masks, longest = _shape(items)
    sought = windows(items, ["item"], F.col("b"), masks, items=True).withColumnsRenamed({"at": "p", "key": "sought"})
    small = within(sought, max_broadcast)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key().alias("row"), "text")
    made = windows(texts, ["doc_id", "row"], token_hashes(F.col("text")), masks)
    hits = made.join(F.broadcast(sought) if small else sought, F.col("key") == F.col("sought"))
    hits = stored(hits.select("doc_id", "row", "item", (F.col("at") - F.col("p")).alias("shift")).distinct(), "hits")
    # Only texts that have a hit are cut into words again.
    hit = hits.select(F.col("doc_id").alias("hit_id"), F.col("row").alias("hit_row")).distinct()
    held = texts.join(hit, F.col("doc_id").eqNullSafe(F.col("hit_id")) & (F.col("row") == F.col("hit_row")), "left_semi")
    # In chunks, so that a diagonal takes along the words near it, not the whole text.
    step = max(64, longest)
    cut = lambda h: F.transform(F.sequence(F.lit(0), F.floor((F.size(h) - 1) / step).cast("int")), lambda k: F.slice(h, k * step + 1, step + longest))
    chunks = F.posexplode(_once(token_hashes(F.col("text")), cut)).alias("of_chunk", "h")
    held = held.select(F.col("doc_id").alias("of_id"), F.col("row").alias("of_row"), chunks).distinct()
    words = items.withColumnRenamed("item", "of_item")
    laid = hits.join(F.broadcast(words) if small else words, F.col("item") == F.col("of_item"))
    begin = F.greatest(F.lit(0), F.col("shift"))
    laid = laid.withColumn("chunk", F.floor(begin / step).cast("int"))
    laid = laid.join(held, F.col("doc_id").eqNullSafe(F.col("of_id")) & (F.col("row") == F.col("of_row")) & (F.col("chunk") == F.col("of_chunk")))
    piece = F.slice("h", begin - F.col("chunk") * step + 1, F.greatest(F.lit(0), F.col("shift") + F.size("b") - begin))
    laid = laid.select("doc_id", "row", "item_id", "shift", "b", (begin - F.col("shift")).alias("base"), piece.alias("piece"))
    best = verified(laid).groupBy("doc_id", "row", "item_id")
    return best.agg(F.max("matched").alias("matched"), F.max("stretch").alias("stretch"), F.min(F.col("shift") + F.col("first")).alias("near_word"))


def overlaps(docs: DataFrame, tests: DataFrame, max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """One row per doc_id and item_id that overlap: doc_id, item_id, matched (equal
    words of the best stretch), stretch, near_word (where in the document the first
    accepted stretch begins)."""
    found = _found(docs, tests, max_broadcast).groupBy("doc_id", "item_id")
    return found.agg(F.max("matched").alias("matched"), F.max("stretch").alias("stretch"), F.min("near_word").alias("near_word"))


def decontaminated(docs: DataFrame, tests: DataFrame, max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """``docs`` without the rows whose text overlaps a test item."""
    return without_rows(docs, stored(_found(docs, tests, max_broadcast).select("doc_id", "row").distinct(), "leaks"), row_key())
