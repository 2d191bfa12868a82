"""SimHash near-duplicates by anchor points of a covering code.

Fingerprints of 64 bits within 4 bits of each other have left halves within 1 bit or right halves within 2 (else they
would differ in 2 + 3). The anchors of a half of 32 bits are the words of the perfect Hamming code of length 31, joined
with the free 32nd bit: every half lies within covering radius 1 of exactly one anchor, its home. A fingerprint goes to every
anchor within 1 + 1 bits of its left half (17 anchors) and within 1 + 2 of its right half (172); two linked fingerprints
thus meet at the home of either. At each anchor the fingerprints at home are compared with all there over all 64 bits.
The 189 copies a distinct fingerprint don't grow with the input, and an anchor gets about N * 172 / 2^27 of N spread ones.

An anchor that is home to more than HOT_HOMES fingerprints is split: its rows are dealt out by each of five blocks of the other
half, one of which two linked fingerprints have in common.

An anchor sees about N * 172 / 2^27 of N spread fingerprints and compares each with those at home: beyond some 10^8 distinct ones the
comparisons grow with the square of N.

Only distinct fingerprints are dealt out (hot groups of copies shrink to one row before any shuffle). At an anchor with
many, a search over links drops each one reached from the list, so a dense cluster costs about its size, not its square.
Components come from alternating large and small stars over the links, each round a table in the shared folder.

Defined results: null and empty texts have fingerprint zero and link like any other; rows that share a doc_id keep their own
fingerprints; a null doc_id is never the smallest; repeated rows each get their row; an empty table gives an empty result.
`keep_first` works on rows, not ids: of each component the row with the smallest doc_id stays (a null one last; of equal ids the
one with the smaller key by id and text), and one of rows that are equal in both; other columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowfeed.llm.common import Workspace, fresh, keep_only, map_batches, map_stream, prepare, row_key, space_words

SHINGLE, SEED, THRESHOLD = 4, 42, 4
LEFT_BITS, RIGHT_BITS = 1, 2  # (LEFT_BITS + 1) + (RIGHT_BITS + 1) > THRESHOLD
#: Dealt rows of one task, about, 16 bytes each, and of one comparison; tasks at most, which then compare anchor after anchor.
TASK_ROWS, MOST_TASKS = 2_000_000, 20_000
#: Anchors with fewer fingerprints are compared by shifting the sorted rows; larger ones by a search.
SMALL_ANCHOR = 24
HASH_CHUNK = 1 << 15
#: An anchor that is home to more fingerprints than this is split by the other half's blocks (first bit, bits).
HOT_HOMES = 100_000
BLOCKS = ((0, 7), (7, 7), (14, 6), (20, 6), (26, 6))  # more blocks than THRESHOLD: of two linked halves, one block is equal


def fingerprint(text: str | None) -> int:
    """Majority bits of XXH64 over shingles of four words, repeats included."""
    from xxhash import xxh64_intdigest

    words = space_words(text)
    if not words:
        return 0
    joined = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    n = max(1, len(words) - SHINGLE + 1)
    first, last = (ends - sizes)[:n].tolist(), ends[-n:].tolist()
    ones = np.zeros(64, np.int64)
    for i in range(0, n, HASH_CHUNK):
        part = [xxh64_intdigest(joined[a:b], SEED) for a, b in zip(first[i : i + HASH_CHUNK], last[i : i + HASH_CHUNK], strict=True)]
        bits = np.unpackbits(np.array(part, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, name: str, column: Column, text_col: str = "text") -> DataFrame:
    """(name, fp) of each row: the column, and the fingerprint's 64 bits as a signed long."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        keep_only("simhash")
        fps = np.fromiter((fingerprint(t.as_py()) for t in batch.column(0)), np.uint64, batch.num_rows)
        yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(fps.view(np.int64))], [name, "fp"])

    read = docs.select(F.col(f"`{text_col}`").cast("string").alias("text"), column.alias(name))
    return map_batches(read, run, f"{name} {read.schema[name].dataType.simpleString()}, fp bigint")


def syndrome(x: np.ndarray) -> np.ndarray:
    """Of the low 31 bits: the exclusive or of the numbers (from 1) of set bits; 0 for code words."""
    out = np.zeros(x.shape, np.uint32)
    for level in range(5):
        mask = sum(1 << (i - 1) for i in range(1, 32) if i >> level & 1)
        out |= (np.bitwise_count(x & np.uint32(mask)).astype(np.uint32) & 1) << np.uint32(level)
    return out


@lru_cache
def steps_to_anchors(radius: int) -> tuple[np.ndarray, ...]:
    """For each syndrome, what to flip in a half to get each anchor within the radius."""
    flips: list[list[int]] = [[] for _ in range(32)]

    def grow(start: int, mask: int, s: int, weight: int) -> None:
        flips[s].append(mask)
        if weight + 1 <= radius:
            flips[s].append(mask | 1 << 31)
        if weight < radius:
            for i in range(start, 32):
                grow(i + 1, mask | 1 << (i - 1), s ^ i, weight + 1)

    grow(1, 0, 0, 0)
    return tuple(np.array(f, np.uint32) for f in flips)


def homes(half: np.ndarray) -> np.ndarray:
    s = syndrome(half)
    return half ^ np.where(s > 0, np.uint32(1) << (np.maximum(s, 1) - 1).astype(np.uint32), np.uint32(0)).astype(np.uint32)


def halves(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (fps >> np.uint64(32)).astype(np.uint32), (fps & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def deal(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(anchor key, fingerprint) of each fingerprint at each anchor in reach. Key: which half, then the anchor."""
    keys, who = [], []
    for side, (half, bits) in enumerate(zip(halves(fps), (LEFT_BITS, RIGHT_BITS), strict=True)):
        s = syndrome(half)
        for value, flips in enumerate(steps_to_anchors(1 + bits)):
            rows = np.flatnonzero(s == value)
            keys.append(((half[rows, None] ^ flips).astype(np.int64) | side << 32).ravel())
            who.append(np.repeat(fps[rows], len(flips)))
    return np.concatenate(keys), np.concatenate(who)


def home_keys(fps: np.ndarray) -> np.ndarray:
    """The two anchors that are home to each fingerprint."""
    return np.concatenate([homes(half).astype(np.int64) | side << 32 for side, half in enumerate(halves(fps))])


def split_hot(keys: np.ndarray, fps: np.ndarray, hot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of hot anchors (sorted) once for each block of the half that isn't the anchor's, with the block's bits in the key."""
    if not len(hot):
        return keys, fps
    at = np.minimum(np.searchsorted(hot, keys), len(hot) - 1)
    is_hot = hot[at] == keys
    k, f = keys[is_hot], fps[is_hot]
    left, right = halves(f)
    other = np.where(k >> 32 == 0, right, left).astype(np.int64)
    parts = [k | (1 + (j << 7) + (other >> first & (1 << bits) - 1)) << 33 for j, (first, bits) in enumerate(BLOCKS)]
    return np.concatenate([keys[~is_hot], *parts]), np.concatenate([fps[~is_hot], *[f] * len(BLOCKS)])


def links_at_anchors(keys: np.ndarray, fps: np.ndarray, small_anchor: int = SMALL_ANCHOR) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect all that are within the threshold of one at home, at each anchor."""
    order = np.lexsort((fps, keys))
    keys, fps = keys[order], fps[order]
    left, right = halves(fps)
    at_home = np.where(keys >> 32 & 1 == 0, homes(left), homes(right)) == (keys & 0xFFFFFFFF)
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    sizes = np.diff(np.append(starts, len(keys)))
    small = np.repeat(sizes < small_anchor, sizes)
    a, b = [], []
    for shift in range(1, small_anchor - 1):
        i = np.flatnonzero((keys[shift:] == keys[:-shift]) & small[shift:] & (at_home[shift:] | at_home[:-shift]))
        if not len(i):
            break
        i = i[np.bitwise_count(fps[i] ^ fps[i + shift]) <= THRESHOLD]
        a.append(fps[i])
        b.append(fps[i + shift])
    for start, size in zip(starts[sizes >= small_anchor], sizes[sizes >= small_anchor], strict=True):
        here, home = fps[start : start + size], at_home[start : start + size]
        rest = np.arange(size)
        for h in np.flatnonzero(home):
            at = np.searchsorted(rest, h)
            if at == len(rest) or rest[at] != h:
                continue
            rest, found = np.delete(rest, at), [h]
            while found and len(rest):
                p = found.pop()
                near = np.bitwise_count(here[rest] ^ here[p]) <= THRESHOLD
                if near.any():
                    found += rest[near].tolist()
                    b.append(here[rest[near]])
                    a.append(np.full(int(near.sum()), here[p]))
                    rest = rest[~near]
    empty = [np.zeros(0, np.uint64)]
    return np.concatenate(a or empty), np.concatenate(b or empty)


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node of its component), without the smallest nodes themselves."""
    nodes, index = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = index[: len(a)], index[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[u], root[v])
        new = root.copy()
        np.minimum.at(new, root[u], low)
        np.minimum.at(new, root[v], low)
        while (new[new] != new).any():
            new = new[new]
        if (new == root).all():
            break
        root = new
    moved = root != np.arange(len(nodes))
    return nodes[moved], nodes[root[moved]]


def by_anchor(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(anchors, fingerprints) of about TASK_ROWS rows, cut between anchors; rows come sorted by anchor."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    n = 0
    for batch in batches:
        keys, fps = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        if n >= TASK_ROWS and (cut := int(np.searchsorted(keys, held[-1][0][-1], side="right"))) < len(keys):
            held.append((keys[:cut], fps[:cut]))
            yield tuple(np.concatenate(x) for x in zip(*held, strict=True))
            held, n, keys, fps = [], 0, keys[cut:], fps[cut:]
        if len(keys):
            held.append((keys, fps))
            n += len(keys)
    if held:
        yield tuple(np.concatenate(x) for x in zip(*held, strict=True))


def links(distinct: DataFrame, hot_homes: int = HOT_HOMES, small_anchor: int = SMALL_ANCHOR) -> DataFrame:
    """(u, v): links between distinct fingerprints (column fp) that leave the same components as all links."""
    spark = distinct.sparkSession
    prepare(spark)

    def at_home(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([pa.array(home_keys(batch.column(0).to_numpy().view(np.uint64)))], ["anchor"])

    # At most two in `hot_homes` of the fingerprints, 8 bytes each, come to the driver and go to the tasks.
    crowded = map_batches(distinct.select("fp"), at_home, "anchor bigint").groupBy("anchor").count().where(F.col("count") > hot_homes)
    hot = np.sort(np.array([r.anchor for r in crowded.collect()], np.int64))

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        fps = batch.column(0).to_numpy().view(np.uint64)
        for i in range(0, len(fps), 4096):
            keys, who = split_hot(*deal(fps[i : i + 4096]), hot)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(who.view(np.int64))], ["anchor", "fp"])

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, fps in by_anchor(batches):
            a, b = links_at_anchors(keys, fps.view(np.uint64), small_anchor)
            u, v = forest(a.view(np.int64), b.view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

    dealt = map_batches(distinct.select("fp"), run, "anchor bigint, fp bigint")
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(MOST_TASKS, 1 + distinct.count() * 189 // TASK_ROWS))
    return map_stream(dealt.repartition(tasks, "anchor").sortWithinPartitions("anchor"), linked, "u bigint, v bigint").distinct()


def components(work: Workspace, edges: DataFrame) -> DataFrame:
    """(node, root): root is the smallest node of the component. Nodes without links and roots are left out."""

    def mark(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())

    least = lambda e: e.join(e.groupBy("u").agg(F.min("v").alias("m")), "u")
    now, turn = work.save(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "stars-0"), 0
    seen = mark(now)
    while True:
        both = least(now.union(now.select("v", "u")))
        large = both.where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()
        small = least(large)
        small = small.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v"))).distinct()
        turn += 1
        now = work.save(small, f"stars-{turn}")
        work.drop(f"stars-{turn - 1}")
        before, seen = seen, mark(now)
        if before == seen:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))


def classes(work: Workspace, prints: DataFrame, first: Column, hot_homes: int = HOT_HOMES, small_anchor: int = SMALL_ANCHOR) -> DataFrame:
    """(fp, first): of each distinct fingerprint, the least `first` (of prints' columns) among all that links reach."""
    distinct = work.save(prints.groupBy("fp").agg(F.min(first).alias("first")), "distinct")
    stars = components(work, links(distinct, hot_homes, small_anchor))
    rooted = distinct.join(stars, distinct.fp == stars.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    firsts = rooted.groupBy("root").agg(F.min("first").alias("first"))
    return work.save(rooted.drop("first").join(firsts, "root").select("fp", "first"), "classes")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot_homes: int = HOT_HOMES, small_anchor: int = SMALL_ANCHOR) -> DataFrame:
    """One row for each row of `docs`: doc_id, fingerprint, component_id (the smallest doc_id reachable by links)."""
    work = Workspace(docs.sparkSession)
    prints = work.save(fingerprints(docs, "doc_id", F.col(f"`{id_col}`"), text_col), "prints")
    found = classes(work, prints, F.col("doc_id"), hot_homes, small_anchor)
    hexed = F.lpad(F.lower(F.hex("fp")), 16, "0")
    return prints.join(found, "fp").select("doc_id", hexed.alias("fingerprint"), F.col("first").alias("component_id"))


def keep_first(docs: DataFrame) -> DataFrame:
    """`docs` with one row of each component."""
    work, key = Workspace(docs.sparkSession), fresh(docs.columns, "row_key")[0]
    named = F.struct(row_key().alias("row"), F.col("doc_id"))
    prints = work.save(fingerprints(docs, "named", named).select("named.row", "named.doc_id", "fp"), "prints")
    found = classes(work, prints, F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "row"))
    extra = prints.join(found, "fp").where(F.col("row") != F.col("first.row")).select("row")
    # Rows equal in id and text: one of them stays, or none.
    repeated = work.save(prints.groupBy("row").count().where("count > 1").select("row"), "repeated")
    keyed = docs.withColumn(key, row_key())
    once = keyed.join(extra.union(repeated).distinct().select(F.col("row").alias(key)), key, "left_anti")
    if not repeated.isEmpty():
        firsts = repeated.join(extra.distinct(), "row", "left_anti").select(F.col("row").alias(key))
        once = once.unionByName(keyed.join(firsts, key, "left_semi").dropDuplicates([key]))
    return once.select(*[f"`{c}`" for c in docs.columns])
