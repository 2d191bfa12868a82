"""Benchmark decontamination with an FM-index for each training shard.

A shard is a bounded run of documents within a task. Its words become symbols: those of the test phrases get a number
each, all others are one separator, and runs of numbered words shorter than the shortest phrase, which hold no
occurrence, become a separator too. Over the symbols' suffix array the Burrows-Wheeler transform is kept as a wavelet
matrix (one ranked bit vector for each bit of the symbol number). Phrases are searched backwards, all at once, by two
ranks a step; occurrences are located by walking to the next sampled suffix position; their spans are merged by document.

The phrases are broadcast in blocks of about BLOCK_WORDS words, one block at a time: what a block finds is written to the
shared folder, spans and items by a key of the text, before the next block is built and sent. So what is sent, and a worker's memory, is
bounded for a benchmark of any size, and texts are read once a block but never written. With one block nothing is shuffled; with more, the
documents once, to meet their hits. Batches are cut by bytes of text.

Defined results: a null or empty text has no words and is not contaminated; an item without words has no phrase; an item
with a null id takes part in hits and counts as one item with the empty id; equal items count by id, once each; repeated
documents each get their row; empty tables give an empty result or no hits; a text of any length is looked at whole. Other
columns, whatever their names, pass through `find_leaks`.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowfeed.llm.common import ALNUM_LOWER, Workspace, alnum_words, fresh, keep_only, prepare, size_slices

WINDOW = 13
BLOCK_WORDS = 1_000_000
#: Bytes of a shard's texts (a longer text is alone); symbols indexed at once, and the distance of sampled suffix positions.
SHARD_BYTES, SHARD_SYMBOLS, SAMPLE = 12 << 20, 2_000_000, 16


class RankedBits:
    """Bits with the number of ones before any place: counts before each 64-bit word, and a popcount inside."""

    def __init__(self, bits: np.ndarray) -> None:
        n = len(bits)
        padded = np.zeros((n // 64 + 1) * 64, bool)
        padded[:n] = bits
        self.words = np.packbits(padded, bitorder="little").view("<u8")
        self.before = np.zeros(len(self.words), np.int64)
        np.cumsum(np.bitwise_count(self.words[:-1]), out=self.before[1:])

    def rank(self, i: np.ndarray) -> np.ndarray:
        word, bit = i >> 6, (i & 63).astype(np.uint64)
        return self.before[word] + np.bitwise_count(self.words[word] & ((np.uint64(1) << bit) - np.uint64(1)))

    def get(self, i: np.ndarray) -> np.ndarray:
        return (self.words[i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1) == 1


class WaveletMatrix:
    def __init__(self, symbols: np.ndarray, bits: int) -> None:
        self.levels = []
        for level in reversed(range(bits)):
            ones = (symbols >> level) & 1 == 1
            self.levels.append((level, RankedBits(ones), len(symbols) - int(ones.sum())))
            symbols = np.concatenate([symbols[~ones], symbols[ones]])

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Occurrences of each symbol before each place."""
        start = np.zeros_like(i)
        for level, bits, zeros in self.levels:
            one = (symbol >> level) & 1 == 1
            a, b = bits.rank(start), bits.rank(i)
            start, i = np.where(one, zeros + a, start - a), np.where(one, zeros + b, i - b)
        return i - start

    def access(self, i: np.ndarray) -> np.ndarray:
        symbol = np.zeros_like(i)
        for level, bits, zeros in self.levels:
            one, a = bits.get(i), bits.rank(i)
            symbol |= one.astype(np.int64) << level
            i = np.where(one, zeros + a, i - a)
        return symbol


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Prefix doubling; the last symbol is smaller than all others."""
    n, step = len(text), 1
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
    while True:
        key = rank * (n + 1)
        key[: n - step] += rank[step:] + 1
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        fresh = np.empty(n, np.int64)
        fresh[order] = np.concatenate([[0], np.cumsum(ordered[1:] != ordered[:-1])])
        rank = fresh
        if rank[order[-1]] == n - 1:
            return order
        step *= 2


class FmIndex:
    """symbols: numbers of at least 1."""

    def __init__(self, symbols: np.ndarray, largest: int) -> None:
        text = np.append(symbols, 0)
        n = len(text)
        places = suffix_array(text)
        bwt = text[places - 1]  # the place before 0 is the last
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=largest + 1))])
        self.tree = WaveletMatrix(bwt, max(1, int(largest).bit_length()))
        sampled = places % SAMPLE == 0
        self.marks, self.samples, self.n = RankedBits(sampled), places[sampled], n

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix ranges of phrases, which are rows of symbols, right-aligned."""
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        for back in range(1, phrases.shape[1] + 1):
            on = np.flatnonzero((lengths >= back) & (low < high))
            c = phrases[on, -back].astype(np.int64)
            low[on], high[on] = self.first[c] + self.tree.rank(c, low[on]), self.first[c] + self.tree.rank(c, high[on])
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text places of suffix rows."""
        out, at, todo, steps = np.zeros_like(rows), rows.copy(), np.arange(len(rows)), 0
        while len(todo):
            here = self.marks.get(at)
            out[todo[here]] = self.samples[self.marks.rank(at[here])] + steps
            at, todo = at[~here], todo[~here]
            c = self.tree.access(at)
            at = self.first[c] + self.tree.rank(c, at)
            steps += 1
        return out


class Phrases:
    """Distinct windows of benchmark items, with the items of each, as arrays: 4 bytes a word of a window."""

    def __init__(self, items: list[tuple[str, str | None]], window: int = WINDOW) -> None:
        self.names = sorted({name for name, _ in items})
        number = {x: i for i, x in enumerate(self.names)}
        #: Symbol 0 ends a text, 1 separates.
        self.vocabulary: dict[bytes, int] = {}
        rows, lengths, owners = [np.zeros((0, window), np.int32)], [np.zeros(0, np.int32)], [np.zeros(0, np.int32)]
        for name, text in items:
            words = alnum_words(text)
            if not words:
                continue
            codes = np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 2) for w in words], np.int32)
            size = min(len(codes), window)
            mine = np.zeros((len(codes) - size + 1, window), np.int32)  # right-aligned
            mine[:, window - size :] = np.lib.stride_tricks.sliding_window_view(codes, size)
            rows.append(mine)
            lengths.append(np.full(len(mine), size, np.int32))
            owners.append(np.full(len(mine), number[name], np.int32))
        self.rows, first, of = np.unique(np.concatenate(rows), axis=0, return_index=True, return_inverse=True)
        self.lengths = np.concatenate(lengths)[first].astype(np.int64)
        pairs = np.unique(np.stack([of.ravel().astype(np.int64), np.concatenate(owners)], 1), axis=0)
        self.starts = np.searchsorted(pairs[:, 0], np.arange(len(self.rows) + 1))
        self.owners = pairs[:, 1].astype(np.int32)
        self.shortest = int(self.lengths.min(initial=window))

    def items(self, phrases: np.ndarray) -> list[str]:
        """Names of the items with any of the phrases, sorted."""
        found = [self.owners[self.starts[p] : self.starts[p + 1]] for p in phrases]
        return [self.names[i] for i in np.unique(np.concatenate(found))]

    def project(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols without what can't be in an occurrence, and each one's place in `symbols`."""
        edge = np.flatnonzero(np.diff(np.concatenate([[0], symbols > 1, [0]])))
        starts, ends = edge[::2], edge[1::2]
        long = ends - starts >= self.shortest
        starts, sizes = starts[long], (ends - starts)[long] + 1  # with a separator after each run
        offsets = np.cumsum(sizes) - sizes
        places = np.repeat(starts - offsets, sizes) + np.arange(sizes.sum())
        out = np.append(symbols, 1)[places]
        out[offsets + sizes - 1] = 1
        return out, places

    def occurrences(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, phrase) of every occurrence in the symbols of a shard."""
        text, places = self.project(symbols)
        at, which = [], []
        for a, b in shards(text):
            index = FmIndex(text[a:b], len(self.vocabulary) + 1)
            low, high = index.search(self.rows, self.lengths)
            count = np.maximum(high - low, 0)
            rows = np.repeat(low - (np.cumsum(count) - count), count) + np.arange(count.sum())
            at.append(places[a + index.locate(rows)])
            which.append(np.repeat(np.arange(len(count)), count))
        empty = [np.zeros(0, np.int64)]
        return np.concatenate(at or empty), np.concatenate(which or empty)


def shards(text: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of about SHARD_SYMBOLS symbols that end after a separator."""
    ends, start = np.flatnonzero(text == 1) + 1, 0
    while start < len(text):
        end = int(ends[min(np.searchsorted(ends, start + SHARD_SYMBOLS), len(ends) - 1)])
        yield start, end
        start = end


def merged(spans: np.ndarray) -> np.ndarray:
    """Sorted disjoint spans that cover the same places; touching ones are joined."""
    if len(spans) < 2:
        return spans
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    reach = np.maximum.accumulate(spans[:, 1])
    first = np.concatenate([[True], spans[1:, 0] > reach[:-1]])
    last = np.append(np.flatnonzero(first)[1:] - 1, len(spans) - 1)
    return np.stack([spans[first, 0], reach[last]], 1)


def scan_batch(texts: list[str | None], phrases: Phrases) -> tuple[list[int], list[np.ndarray], list[list[str]]]:
    """Of each text: words, merged hit spans of words, item ids sorted as strings."""
    get = phrases.vocabulary.get
    starts, sizes, parts = [0], [], []
    for text in texts:
        words = alnum_words(text)
        sizes.append(len(words))
        parts.append(np.fromiter((get(w, 1) for w in words), np.int64, len(words)))
        parts.append(np.ones(1, np.int64))
        starts.append(starts[-1] + len(words) + 1)
    at, which = phrases.occurrences(np.concatenate(parts)) if texts else (np.zeros(0, np.int64),) * 2
    doc = np.searchsorted(starts, at, side="right") - 1
    spans: list[np.ndarray] = [np.zeros((0, 2), np.int64)] * len(texts)
    items: list[list[str]] = [[] for _ in texts]
    order = np.argsort(doc, kind="stable")
    for rows in np.split(order, np.flatnonzero(np.diff(doc[order])) + 1) if len(order) else []:
        d = int(doc[rows[0]])
        begin = at[rows] - starts[d]
        spans[d] = merged(np.stack([begin, begin + phrases.lengths[which[rows]]], 1))
        items[d] = phrases.items(np.unique(which[rows]))
    return sizes, spans, items


def benchmark_blocks(benchmark: DataFrame, block_words: int = BLOCK_WORDS) -> Iterator[list[tuple[str, str | None]]]:
    """The items in blocks of about so many words; the driver holds one block."""
    block, words = [], 0
    for row in benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")), "text").toLocalIterator():
        block.append((row[0], row[1]))
        words += len(alnum_words(row[1]))
        if words >= block_words:
            yield block
            block, words = [], 0
    if block:
        yield block


HITS = ("bigint", "array<struct<start:int,end:int>>", "array<string>")
HIT_TYPES = [pa.int64(), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])), pa.list_(pa.string())]


def find_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", block_words: int = BLOCK_WORDS, names: tuple[str, str, str] = ("n_words", "spans", "items"), cut: bool = False) -> DataFrame:
    """`docs` with the number of words, hit spans (merged, of words) and item ids (sorted as strings), in columns of the `names`; where `docs` has columns of
    these names, the new ones get a mark (`fresh`), and all of `docs` pass through.

    With `cut` the last pass gives each text without the words of its spans. A benchmark of more than one block takes a pass for each: what it finds is kept
    by the text's key, for texts with hits only, and the texts themselves are read again and not written.
    """
    spark = docs.sparkSession
    prepare(spark)
    names = tuple(fresh(docs.columns, *names))
    blocks = benchmark_blocks(benchmark, block_words)
    block, following = next(blocks, []), next(blocks, None)
    if following is None:
        return _with_hits(docs, text_col, names, cut, spark.sparkContext.broadcast(Phrases(block)))
    key = fresh(docs.columns, "text_key", "text_key_2")
    of_text = [F.xxhash64(F.col(f"`{text_col}`")), F.xxhash64(F.lit(1), F.col(f"`{text_col}`"))]
    texts = docs.where(F.col(f"`{text_col}`").isNotNull()).select(*[c.alias(k) for c, k in zip(of_text, key, strict=True)], F.col(f"`{text_col}`").alias("text"))
    work, found, k = Workspace(spark), None, 0
    while block is not None:
        sent = spark.sparkContext.broadcast(Phrases(block))
        hits = work.save(_hits(texts, key, sent), f"hits-{k}")
        sent.destroy()
        found = hits if found is None else found.unionByName(hits)
        block, following, k = following, next(blocks, None), k + 1
    spans, items = fresh([*docs.columns, *key, *names], "found_spans", "found_items")
    found = found.groupBy(*key).agg(F.flatten(F.collect_set("spans")).alias(spans), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias(items))
    keyed = docs.select("*", *[c.alias(k) for c, k in zip(of_text, key, strict=True)])
    return _with_hits(keyed.join(found, key, "left").select(*[F.col(f"`{c}`") for c in docs.columns], spans, items), text_col, names, cut, None)


def _hits(texts: DataFrame, key: list[str], phrases: Broadcast) -> DataFrame:
    """(key, spans, items) of the texts in which a phrase of the block occurs; copies of a text once a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_only("search")
        for batch in (part for b in batches if b.num_rows for part in size_slices(b, 2, SHARD_BYTES)):
            _, spans, items = scan_batch(batch.column(2).to_pylist(), phrases.value)
            at = pa.array([i for i, s in enumerate(spans) if len(s)], pa.int64())
            found = [[[{"start": int(a), "end": int(b)} for a, b in spans[i.as_py()]] for i in at], [items[i.as_py()] for i in at]]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), *(pa.array(c, t) for c, t in zip(found, HIT_TYPES[1:], strict=True))], [*key, "spans", "items"])

    return texts.mapInArrow(run, f"`{key[0]}` bigint, `{key[1]}` bigint, spans {HITS[1]}, items {HITS[2]}")


def _with_hits(docs: DataFrame, text_col: str, names: tuple[str, ...], cut: bool, phrases: Broadcast | None) -> DataFrame:
    """The documents with hits of the phrases; without phrases, with hits that their last two columns have."""
    keep = docs.columns if phrases is not None else docs.columns[:-2]
    text_at = keep.index(text_col)
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep) + "".join(f", `{n}` {t}" for n, t in zip(names, HITS, strict=True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_only("search")
        for batch in (part for b in batches if b.num_rows for part in size_slices(b, text_at, SHARD_BYTES)):
            texts = batch.column(text_at).to_pylist()
            if phrases is not None:
                sizes, spans, items = scan_batch(texts, phrases.value)
            else:
                found, items = batch.column(len(keep)).to_pylist(), [x or [] for x in batch.column(len(keep) + 1).to_pylist()]
                sizes = [len(alnum_words(t)) for t in texts]
                spans = [merged(np.array(sorted((x["start"], x["end"]) for x in s or []), np.int64).reshape(-1, 2)) for s in found]
            columns = [sizes, [[{"start": int(a), "end": int(b)} for a, b in s] for s in spans], items]
            before = batch.columns[: len(keep)]
            if cut:
                before[text_at] = pa.array([cut_words(t, s) for t, s in zip(texts, spans, strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays([*before, *(pa.array(c, t) for c, t in zip(columns, HIT_TYPES, strict=True))], [*keep, *names])

    return docs.mapInArrow(run, schema)


def hit_words(spans: str = "spans") -> Column:
    return F.aggregate(spans, F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["start"])


def is_contaminated(n_hit: Column, n_words: Column) -> Column:
    return (n_hit > 0) & (20 * n_hit >= n_words)


def leak_digest(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row for each document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    found = find_leaks(docs.select("doc_id", "text"), benchmark).select("doc_id", "n_words", hit_words().alias("n_hit"), "items")
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), is_contaminated(F.col("n_hit"), F.col("n_words")).alias("contaminated"))


def cut_words(text: str | None, spans: np.ndarray) -> str | None:
    """The text without the words of the spans; what stood between two words of a span goes with them."""
    if not text or not len(spans):
        return text
    raw = text.encode()
    plain = raw.translate(ALNUM_LOWER)
    starts, ends, at = [], [], 0
    for word in plain.split():
        at = plain.index(word, at)
        starts.append(at)
        at += len(word)
        ends.append(at)
    kept, at = [], 0
    for a, b in spans:
        kept.append(raw[at : starts[a]])
        at = ends[b - 1]
    return b"".join([*kept, raw[at:]]).decode()


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """`docs` (doc_id, text, lang, source, n_chars) without contaminated documents; from others the hit words are removed."""
    size, spans, _ = own = tuple(fresh(docs.columns, "n_words", "spans", "items"))
    found = find_leaks(docs, benchmark, names=own, cut=True)
    kept = found.where(~is_contaminated(hit_words(spans), F.col(size)))
    chars = F.when(F.size(spans) > 0, F.length("text").cast("bigint")).otherwise(F.col("n_chars"))
    return kept.withColumn("n_chars", chars).select(*[f"`{c}`" for c in docs.columns])


def leak_sql() -> str:
    """DuckDB SQL for `leak_digest` over `documents` and `benchmark`."""
    words = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {words} AS words FROM documents),
b AS (SELECT coalesce(item_id::VARCHAR, '') AS item_id, {words} AS words FROM benchmark),
phrase AS (
  SELECT DISTINCT item_id, words[i:i + {WINDOW - 1}] AS w, least(len(words), {WINDOW}) AS size
  FROM (SELECT *, unnest(range(1, greatest(1, len(words)::BIGINT - {WINDOW - 1}) + 1)) AS i FROM b WHERE len(words) > 0)),
win AS (
  SELECT rid, i, size, words[i:i + size - 1] AS w
  FROM (SELECT rid, words, size, unnest(range(1, len(words)::BIGINT - size + 2)) AS i
        FROM d, (SELECT DISTINCT size FROM phrase))),
occ AS (SELECT rid, i, win.size, item_id FROM win JOIN phrase USING (w, size)),
hit AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + size)) AS p FROM occ) GROUP BY rid),
item AS (
  SELECT rid, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items
  FROM (SELECT DISTINCT rid, item_id FROM occ) GROUP BY rid),
a AS (
  SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
    sha256(coalesce(items, '')) AS items_sha256
  FROM d LEFT JOIN hit USING (rid) LEFT JOIN item USING (rid))
SELECT *, n_hit > 0 AND 20 * n_hit >= n_words AS contaminated FROM a"""
