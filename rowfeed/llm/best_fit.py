"""Best-fit packing under conflicts: a bin takes at most one document of a source and one of a duplicate cluster.

Documents are dealt to shards of about SHARD_ROWS rows by a hash of their id, cluster and place in the table of sizes, which is
written once; each shard is packed alone, so a task's memory is bounded at any size of the corpus, and a hot source or
cluster, repeated ids and repeated rows are spread over all shards. In a shard, pieces go from
long to short. Open bins lie ordered by residual; each carries a bitmap of its sources and one of its clusters. The
search for a piece starts at the successor of its length among the residuals in use and goes on upwards until a bin
without a common bit is found, so the bin chosen is the tightest compatible one; among equals the one filled longest ago.
Bins are grouped by their bits of the few most frequent sources and clusters, each group with its own residual order: a
piece of a hot source never walks past the bins that have that source already.

A document longer than the capacity is cut: full pieces fill a bin each, the rest is packed as others are.

Defined results: a document without tokens (null or empty text) gets one row with a null bin; null sources and clusters
conflict with nothing; repeated rows are packed each; equal lengths go by id, then source; an empty table gives an empty
result. Other columns are not read.
"""

from __future__ import annotations

from collections import Counter, deque
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowfeed.llm.common import Workspace, keep_only, prepare
from rowfeed.llm.fst_tokens import count_tokens

CAPACITY, SHARD_ROWS, MOST_TASKS = 4096, 20_000, 20_000
#: Sources and clusters with a larger share of a shard than this, up to so many, group the bins.
HOT_SHARE, HOT_KEYS = 1 / 64, 6


def bits_of(keys: list) -> list[int]:
    """One bit for each key that occurs twice or more; others, and null, conflict with nothing."""
    count = Counter(k for k in keys if k is not None)
    number = {k: 1 << i for i, k in enumerate(k for k, n in count.most_common() if n > 1)}
    return [number.get(k, 0) for k in keys]


class Group:
    """Open bins with the same hot bits, ordered by residual."""

    def __init__(self) -> None:
        self.in_use = 0  # bit r: some bin has residual r
        self.bins: dict[int, deque[tuple[int, int]]] = {}  # residual -> (turn, bin), oldest turn first


class Packer:
    def __init__(self, capacity: int, hot_sources: int, hot_clusters: int) -> None:
        self.capacity, self.hot = capacity, (hot_sources, hot_clusters)
        self.residual: list[int] = []
        self.sources: list[int] = []
        self.clusters: list[int] = []
        self.turn: list[int] = []
        self.groups: dict[tuple[int, int], Group] = {}
        self.turns = 0

    def find(self, size: int, source: int, cluster: int) -> int | None:
        """The compatible bin with the least residual of at least `size`."""
        level = {}
        for hot, group in self.groups.items():
            if not (hot[0] & source or hot[1] & cluster) and (up := group.in_use >> size):
                level[hot] = size + (up & -up).bit_length() - 1
        while level:
            at, best = min(level.values()), None
            for hot in [h for h, r in level.items() if r == at]:
                group = self.groups[hot]
                here = group.bins[at]
                while here and self.turn[here[0][1]] != here[0][0]:
                    here.popleft()  # filled since
                for turn, b in here:
                    if self.turn[b] == turn and not (self.sources[b] & source or self.clusters[b] & cluster):
                        best = min(best, (turn, b)) if best else (turn, b)
                        break
                if not here:
                    group.in_use &= ~(1 << at)
                if up := group.in_use >> at + 1:
                    level[hot] = at + (up & -up).bit_length()
                else:
                    del level[hot]
            if best:
                return best[1]
        return None

    def put(self, size: int, source: int, cluster: int) -> tuple[int, int]:
        """(bin, offset in it)."""
        b = self.find(size, source, cluster)
        if b is None:
            b = len(self.residual)
            self.residual.append(self.capacity)
            self.sources.append(0)
            self.clusters.append(0)
            self.turn.append(0)
        offset = self.capacity - self.residual[b]
        self.residual[b] -= size
        self.sources[b] |= source
        self.clusters[b] |= cluster
        self.turns += 1
        self.turn[b] = self.turns
        if left := self.residual[b]:
            group = self.groups.setdefault((self.sources[b] & self.hot[0], self.clusters[b] & self.hot[1]), Group())
            group.bins.setdefault(left, deque()).append((self.turns, b))
            group.in_use |= 1 << left
        return b, offset


def hot_bits(bits: list[int]) -> int:
    count = Counter(b for b in bits if b)
    return sum(b for b, n in count.most_common(HOT_KEYS) if n > HOT_SHARE * len(bits))


def pack_shard(rows: Iterable[tuple], capacity: int = CAPACITY) -> list[tuple]:
    """rows: (id, tokens, source, cluster) -> (id, piece, start, tokens, bin, offset)."""
    rows = list(rows)
    sources, clusters = bits_of([r[2] for r in rows]), bits_of([r[3] for r in rows])
    packer, out, rest = Packer(capacity, hot_bits(sources), hot_bits(clusters)), [], []
    for k, (name, size, source, _) in enumerate(rows):
        full, left = divmod(size or 0, capacity)
        for piece in range(full):
            out.append((name, piece, piece * capacity, capacity, *packer.put(capacity, sources[k], clusters[k])))
        if left:
            rest.append((-left, name is not None, name, source or "", full, k))
        elif not full:
            out.append((name, 0, 0, 0, None, None))
    for left, _, name, _, piece, k in sorted(rest, key=lambda r: (r[0], r[1], r[2] if r[1] else 0, r[3])):
        out.append((name, piece, piece * capacity, -left, *packer.put(-left, sources[k], clusters[k])))
    return out


def pack(sized: DataFrame, capacity: int = CAPACITY, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """sized: a written table of doc_id, n_tokens, source, cluster -> doc_id, piece, start_token, n_tokens, bin_id, bin_offset.

    Rows equal in all four are numbered, by their count, and a row's shard is a hash of what it holds and its number: bins don't depend on how the
    input is cut into files, and repeated rows are spread over shards.
    """
    spark = sized.sparkSession
    prepare(spark)
    shards = 1 + sized.count() // shard_rows
    kind = sized.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_only("packing")  # texts are counted, and what follows may not need a worker to forget the tokens
        shard, held = None, []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[0] != shard:
                    yield from packed(shard, held)
                    shard, held = row[0], []
                held.append(row[1:])
        yield from packed(shard, held)

    def packed(shard: int | None, held: list[tuple]) -> Iterator[pa.RecordBatch]:
        if held:
            ids, piece, start, size, b, offset = zip(*pack_shard(held, capacity), strict=True)
            bins = [None if x is None else shard << 32 | x for x in b]
            columns = [(ids, None), (piece, pa.int32()), (start, pa.int64()), (size, pa.int64()), (bins, pa.int64()), (offset, pa.int32())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in columns], ["doc_id", "piece", "start_token", "n_tokens", "bin_id", "bin_offset"])

    numbered = sized.groupBy("doc_id", "n_tokens", "source", "cluster").count().withColumn("place", F.explode(F.sequence(F.lit(1).cast("bigint"), "count")))
    dealt = numbered.select(F.pmod(F.xxhash64("doc_id", "cluster", "place"), F.lit(shards)).alias("shard"), "doc_id", "n_tokens", "source", "cluster", "place")
    order = [F.asc_nulls_first(c) for c in ("doc_id", "cluster", "n_tokens", "source", "place")]
    dealt = dealt.repartition(min(shards, MOST_TASKS), "shard").sortWithinPartitions("shard", *order).drop("place")
    return dealt.mapInArrow(run, f"doc_id {kind}, piece int, start_token bigint, n_tokens bigint, bin_id bigint, bin_offset int")


def pack_documents(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Pack documents by token counts. Copies (equal but for case and white space) form a cluster."""
    plain = docs.select("doc_id", "text", "source")
    sized = count_tokens(plain, carry={"source": F.col("source"), "cluster": F.xxhash64(F.regexp_replace(F.lower("text"), "[ \t-\r]+", " "))})
    return pack(Workspace(docs.sparkSession).save(sized.select("doc_id", "n_tokens", "source", "cluster"), "sized"), capacity)
