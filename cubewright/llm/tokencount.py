"""Token counts by heap-and-linked-list byte-pair merging.

The vocabulary file gives merges by rank. A word's symbols form a linked list
and its adjacent pairs a heap; the lowest-rank pair is popped and merged until
none is left. The count is initial symbols minus merges: no identifiers are
made. Words repeat, so each task keeps the counts of the words it has seen.

Edge cases: null text counts as empty; empty text has no tokens; special strings
inside a text are single tokens, as the library does by default; repeated rows
stay; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import json
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import python_ready

#: Distinct words whose counts a worker keeps at most (it starts again beyond).
CACHE_WORDS = 1_000_000
LIMIT = 2048
#: What the library's newer tables lower-case beside Python's (capital rams horn, lambda with stroke).
NEWER_LOWER = {0xA7CB: 0x0264, 0xA7DC: 0x019B}


def merged_size(n_symbols: int, symbols: list[int], pairs: dict[tuple[int, int], tuple[int, int]]) -> int:
    """How many symbols are left of ``symbols``; ``pairs``: pair -> (rank, merged)."""
    after = list(range(1, n_symbols)) + [-1]
    before = list(range(-1, n_symbols - 1))
    alive = list(symbols)
    heap = [(pairs[p][0], i, p) for i, p in enumerate(zip(alive, alive[1:])) if p in pairs]
    heapq.heapify(heap)
    left = n_symbols
    while heap:
        _, i, pair = heapq.heappop(heap)
        j = after[i] if alive[i] is not None else -1
        if j < 0 or (alive[i], alive[j]) != pair:
            continue  # one of the two was merged meanwhile
        alive[i], alive[j] = pairs[pair][1], None
        after[i] = k = after[j]
        left -= 1
        if k >= 0:
            before[k] = i
            if (new := (alive[i], alive[k])) in pairs:
                heapq.heappush(heap, (pairs[new][0], i, new))
        if (h := before[i]) >= 0 and (new := (alive[h], alive[i])) in pairs:
            heapq.heappush(heap, (pairs[new][0], h, new))
    return left


class WordBpe:
    """A byte-level BPE with word ends, read from a tokenizer file."""

    def __init__(self, path: str) -> None:
        spec = json.loads(Path(path).read_text(encoding="utf-8"))
        model = spec["model"]
        steps = spec["normalizer"]["normalizers"]
        kinds = [s["type"] for s in steps]
        split, byte_level = spec["pre_tokenizer"]["pretokenizers"]
        if kinds != ["NFC", "Replace", "Lowercase"] or split["behavior"] != "Removed" or not split["invert"] or byte_level["use_regex"] or byte_level["add_prefix_space"]:
            raise ValueError("not a tokenizer of the kind that this counter knows")
        self.space = regex.compile(steps[1]["pattern"]["Regex"])
        self.by = steps[1]["content"]
        self.piece = regex.compile(split["pattern"]["Regex"])
        self.end = model["end_of_word_suffix"]
        self.special = regex.compile("|".join(regex.escape(t["content"]) for t in spec["added_tokens"]) or r"(?!)")
        ids: dict[str, int] = {}
        number = lambda s: ids.setdefault(s, len(ids))
        self.pairs = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.pairs.setdefault((number(a), number(b)), (rank, number(a + b)))
        self.number = number
        # Printable bytes stand for themselves, the others for code points from 256 on.
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = iter(range(256, 512))
        self.chars = [chr(b) if b in printable else chr(next(rest)) for b in range(256)]
        self.known = set(model["vocab"])
        self.counts: dict[str, int] = {}

    def word(self, word: str) -> int:
        chars = [self.chars[b] for b in word.encode("utf-8", "surrogatepass")]
        chars[-1] += self.end
        # A symbol outside the vocabulary is dropped where there is no unknown token.
        symbols = [self.number(c) for c in chars if c in self.known]
        return merged_size(len(symbols), symbols, self.pairs) if symbols else 0

    def _plain(self, text: str) -> int:
        import unicodedata

        text = self.space.sub(self.by, unicodedata.normalize("NFC", text)).translate(NEWER_LOWER).lower()
        total, counts = 0, self.counts
        for word, n in Counter(self.piece.findall(text)).items():
            made = counts.get(word)
            if made is None:
                if len(counts) >= CACHE_WORDS:
                    counts.clear()
                made = self.word(word)
                if len(word) <= 64:
                    counts[word] = made
            total += n * made
        return total

    def count(self, text: str | None) -> int:
        text = text or ""
        if "<|" not in text:
            return self._plain(text)
        parts = self.special.split(text)
        return len(parts) - 1 + sum(map(self._plain, parts))


@lru_cache(maxsize=4)
def tokenizer(path: str) -> WordBpe:
    return WordBpe(path)


def token_counts(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_tokens, over_limit."""
    python_ready(docs.sparkSession)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(path)
        for batch in batches:
            made = [bpe.count(t) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(made, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"))
    return rows.mapInArrow(counted, "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
