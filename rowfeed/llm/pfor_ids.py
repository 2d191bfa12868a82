"""Token ids in patched frame-of-reference files, written in ascending doc_id order and read back.

A file holds the documents of one range of ids. Ids go in blocks of BLOCK: the block's minimum is subtracted, offsets are
packed at the width that holds PERCENTILE of them, and larger ones are stored whole in the block's exception list.

    file     magic | blocks | footer | footer length (u64) | magic
    block    minimum u32, width u8, exceptions u16, ids u16 | packed low bits | exception places u16 | exception values u32
    footer   ids u64, documents u64, blocks u64 | block starts u64 | doc ids i64 | doc id is set u8 | ids in each document u64

All numbers are little-endian. Any block is found by its start, any document by the running sum of document sizes.

A task streams its rows to a file of a fixed name by way of a temporary one and a rename, so that a repeated or
speculative attempt leaves the same file. Files are opened with Arrow's filesystems, in a folder that driver and
executors share. What the driver holds is one line a file.

Defined results: null counts as the empty text, of which only the end id remains; a null doc_id comes first; rows with
equal ids are each written, in the order of their texts' hashes (rows equal in both go to one file); an empty table gives no file and an empty result.
"""

from __future__ import annotations

import re
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache
from typing import BinaryIO

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowfeed.llm.common import Workspace, keep, keep_only, prepare
from rowfeed.llm.fst_tokens import tokenizer_path

MAGIC = b"RFPFOR1\n"
BLOCK, PERCENTILE = 1024, 0.95
HEAD = struct.Struct("<IBHH")
END_ID = 2
#: Bytes of words and ids that are kept, characters of a word to be kept, and words given to the library as one text.
KEPT_BYTES, LONGEST, JOINED = 320 << 20, 64, 500
#: Rows and bytes of text of one file, about.
FILE_ROWS, FILE_BYTES = 1_000_000, 256 << 20
READ_BLOCKS = 1024


def _pack(values: np.ndarray, width: int) -> np.ndarray:
    """Rows of values to rows of bytes: value i at bit i * width. 64 values fill `width` words; all rows go at once."""
    k, n = values.shape
    size = -(-n // 64) * 64
    columns = np.zeros((64, k * size // 64), np.uint64)  # value i of each 64
    padded = values if size == n else np.pad(values, ((0, 0), (0, size - n)))
    columns[:] = padded.reshape(-1, 64).T
    columns &= np.uint64((1 << width) - 1)
    words = np.zeros((width, columns.shape[1]), np.uint64)
    for i in range(64):
        word, shift = divmod(i * width, 64)
        words[word] |= columns[i] << np.uint64(shift)
        if shift + width > 64:
            words[word + 1] |= columns[i] >> np.uint64(64 - shift)
    return np.ascontiguousarray(words.T).astype("<u8", copy=False).view(np.uint8).reshape(k, -1)[:, : (width * n + 7) // 8]


def _unpack(packed: np.ndarray, width: int, n: int) -> np.ndarray:
    k, size = len(packed), -(-n // 64) * 64
    if packed.shape[1] < size * width // 8:
        packed = np.pad(packed, ((0, 0), (0, size * width // 8 - packed.shape[1])))
    words = np.ascontiguousarray(np.ascontiguousarray(packed).view("<u8").reshape(-1, width).T)
    columns = np.empty((64, words.shape[1]), np.uint32)
    for i in range(64):
        word, shift = divmod(i * width, 64)
        value = words[word] >> np.uint64(shift)
        if shift + width > 64:
            value |= words[word + 1] << np.uint64(64 - shift)
        columns[i] = value & np.uint64((1 << width) - 1)
    return np.ascontiguousarray(columns.T).reshape(k, size)[:, :n]


def encode_blocks(ids: np.ndarray) -> list[bytes]:
    """Blocks of the ids (u32); only the last may be short."""
    n = len(ids)
    full = n // BLOCK
    out = _encode(ids[: full * BLOCK].reshape(full, BLOCK)) if full else []
    return out + (_encode(ids[full * BLOCK :].reshape(1, -1)) if n > full * BLOCK else [])


def _encode(rows: np.ndarray) -> list[bytes]:
    n = rows.shape[1]
    low = rows.min(1)
    offsets = rows - low[:, None]
    place = min(n - 1, int(np.ceil(PERCENTILE * n)) - 1)
    at = np.partition(offsets, place, axis=1)[:, place]
    widths = np.array([int(x).bit_length() for x in at])
    out: list[bytes] = [b""] * len(rows)
    for width in np.unique(widths).tolist():
        for which in np.array_split(w := np.flatnonzero(widths == width), 1 + len(w) // 256):
            mine = offsets[which]
            packed = _pack(mine, width) if width else np.zeros((len(which), 0), np.uint8)
            big = mine >> np.uint32(width) > 0 if width < 32 else np.zeros(mine.shape, bool)
            for k, i in enumerate(which.tolist()):
                places = np.flatnonzero(big[k])
                out[i] = b"".join([HEAD.pack(int(low[i]), width, len(places), n), packed[k].tobytes(), places.astype("<u2").tobytes(), mine[k, places].astype("<u4").tobytes()])
    return out


def decode_blocks(raw: bytes, starts: list[int]) -> np.ndarray:
    """The ids of blocks that begin at the starts in `raw`."""
    heads = [HEAD.unpack_from(raw, s) for s in starts]
    sizes = np.array([h[3] for h in heads])
    ends = np.cumsum(sizes)
    out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint32)
    kinds: dict[tuple[int, int], list[int]] = {}
    for i, h in enumerate(heads):
        kinds.setdefault((h[1], h[3]), []).append(i)
    for (width, n), which in kinds.items():
        size = (width * n + 7) // 8
        packed = np.stack([np.frombuffer(raw, np.uint8, size, starts[i] + HEAD.size) for i in which])
        values = _unpack(packed, width, n) if width else np.zeros((len(which), n), np.uint32)
        for k, i in enumerate(which):
            count, at = heads[i][2], starts[i] + HEAD.size + size
            if count:
                values[k, np.frombuffer(raw, "<u2", count, at)] = np.frombuffer(raw, "<u4", count, at + 2 * count)
            out[ends[i] - n : ends[i]] = values[k] + np.uint32(heads[i][0])
    return out


class Writer:
    """Documents in, a file out; holds less than a batch of ids, and 17 bytes a document."""

    def __init__(self, to: BinaryIO) -> None:
        self.to, self.at, self.starts, self.held, self.n_held, self.names, self.there, self.sizes = to, len(MAGIC), array("Q"), [], 0, array("q"), bytearray(), array("Q")
        to.write(MAGIC)

    def add(self, name: int | None, ids: bytes) -> None:
        self.names.append(name or 0)
        self.there.append(name is not None)
        self.sizes.append(len(ids) // 4)
        self.held.append(ids)
        self.n_held += len(ids) // 4
        if self.n_held >= 256 * BLOCK:
            self.flush(last=False)

    def flush(self, last: bool) -> None:
        ids = np.frombuffer(b"".join(self.held), "<u4")
        n = len(ids) if last else len(ids) // BLOCK * BLOCK
        for block in encode_blocks(ids[:n]):
            self.starts.append(self.at)
            self.at += len(block)
            self.to.write(block)
        self.held, self.n_held = [ids[n:].tobytes()], len(ids) - n

    def close(self) -> int:
        self.flush(last=True)
        total = sum(self.sizes)
        names, there = np.array(self.names, "<i8"), np.frombuffer(bytes(self.there), np.uint8)
        footer = b"".join([struct.pack("<QQQ", total, len(names), len(self.starts)), np.array(self.starts, "<u8").tobytes(), names.tobytes(), there.tobytes(), np.array(self.sizes, "<u8").tobytes()])
        self.to.write(footer + struct.pack("<Q", len(footer)) + MAGIC)
        return total


def read_documents(file: pa.NativeFile) -> Iterator[tuple[int | None, np.ndarray]]:
    """(doc id, ids) of each document, in order; READ_BLOCKS blocks at a time."""
    tail = 8 + len(MAGIC)
    size = file.size()
    file.seek(size - tail)
    end = file.read(tail)
    if end[8:] != MAGIC:
        raise ValueError("not a token id file")
    (length,) = struct.unpack("<Q", end[:8])
    file.seek(size - tail - length)
    footer = file.read(length)
    _, n_docs, n_blocks = struct.unpack_from("<QQQ", footer)
    at = 24
    starts = np.frombuffer(footer, "<u8", n_blocks, at).astype(np.int64)
    names = np.frombuffer(footer, "<i8", n_docs, at := at + 8 * n_blocks).tolist()
    there = np.frombuffer(footer, np.uint8, n_docs, at := at + 8 * n_docs).tolist()
    sizes = np.frombuffer(footer, "<u8", n_docs, at + n_docs).astype(np.int64).tolist()
    bounds = np.append(starts, size - tail - length)
    held, block = np.zeros(0, np.uint32), 0
    for name, is_set, n in zip(names, there, sizes, strict=True):
        if len(held) < n:
            parts, have = [held], len(held)
            while have < n:
                to = min(block + READ_BLOCKS, n_blocks)
                file.seek(int(bounds[block]))
                raw = file.read(int(bounds[to] - bounds[block]))
                parts.append(decode_blocks(raw, (bounds[block:to] - bounds[block]).tolist()))
                have, block = have + len(parts[-1]), to
            held = np.concatenate(parts)
        yield (name if is_set else None), held[:n]
        held = held[n:]


class TextEncoder:
    """The tokenizers library over segments: words with the space before them. Ids of segments are kept.

    A byte-level BPE splits a text by a pattern before matching any merge, and always before a space that follows a
    character which is not white space. So the ids of a text are those of its segments. A new segment of plain letters,
    digits and marks is split by that pattern, and its pieces are kept too; pieces with a space go to the library
    together, which starts a token at each one's space. A text with an added token's string is given to it whole.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        size = self.tokenizer.get_vocab_size()
        self.spaced = np.array([(self.tokenizer.id_to_token(i) or "").startswith("\u0120") for i in range(size)])
        #: Where engines for regular expressions agree on classes.
        self.plain = re.compile("[!-~\n\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u017f]+").fullmatch
        self.split_plain = re.compile("'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z\u00c0-\u017f]+| ?[0-9]+| ?[^\\sA-Za-z0-9\u00c0-\u017f]+|\\s+(?!\\S)|\\s+").findall
        self.kept = Missing()  # by word, the ids of a space and the word
        self.pieces: dict[str, bytes] = {}
        self.size = 0
        # Some characters count as white space for one regular expression engine and not for another.
        self.split = re.compile("(?<=[^\\s\\u180e\\u200b\\ufeff]) ").split

    def ids(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    @staticmethod
    def open(word: str) -> bool:
        """Whether a space after the word would belong to a run of white space."""
        return not word or word[-1].isspace() or word[-1] in "\u180e\u200b\ufeff"

    def learn(self, words: set[str]) -> None:
        """Put ids of the words in `kept`."""
        kept, pieces = self.kept, self.pieces
        if self.size > KEPT_BYTES:
            kept.clear()
            pieces.clear()
            self.size = 0
        self.size += sum(map(len, words)) * 5 + 120 * len(words)  # with their ids and the dict's share
        letters, held, new, hard = [], {}, {}, []
        for w in words:
            if w.isalpha():
                letters.append(w)
            elif self.plain(w):
                held[w] = parts = self.split_plain(" " + w)
                for p in parts:
                    if p not in pieces:
                        new[p] = None
            else:
                hard.append(" " + w)
        self.together(letters, kept)
        # A word that marks follow: its letters may be known, or be worth knowing.
        self.together([p[1:] for p in new if p[0] == " " and len(p) > 1 and p[1:] not in kept], kept)
        others = [p for p in new if p[0] != " " or len(p) == 1]
        pieces.update(zip(others, self.ids(others), strict=True))
        for w, parts in held.items():
            kept[w] = b"".join([kept[p[1:]] if p[0] == " " and len(p) > 1 else pieces[p] for p in parts])
        for w, ids in zip(hard, self.ids(hard), strict=True):
            kept[w[1:]] = ids

    def together(self, words: list[str], to: dict[str, bytes]) -> None:
        """Ids of words with a space before each, of many words in one text: a token begins at each space."""
        for i in range(0, len(words), JOINED):
            part = words[i : i + JOINED]
            ids = np.array(self.tokenizer.encode_batch_fast([" " + " ".join(part)], add_special_tokens=False)[0].ids, "<u4")
            starts = np.flatnonzero(self.spaced[ids])
            if len(starts) != len(part):  # the library joined words that a space parts
                to.update(zip(part, self.ids([" " + w for w in part]), strict=True))
                continue
            raw, cuts = ids.tobytes(), [*(4 * starts).tolist(), 4 * len(ids)]
            to.update(zip(part, [raw[x:y] for x, y in zip(cuts, cuts[1:], strict=False)], strict=True))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Of each text: its ids as little-endian u32."""
        whole = [i for i, t in enumerate(texts) if any(a in t for a in self.added)]
        kept, missed = self.kept, self.kept.missed
        missed.clear()
        get, cut, found, holes = kept.__getitem__, [], [], []
        for k, text in enumerate(texts):
            words, before = text.split(" "), len(missed)
            cut.append(words)
            found.append(list(map(get, words)))
            if len(missed) > before:
                holes.append(k)
        if missed:
            # A word that is empty or ends in white space is never kept, so it shows here: its text has a run of white space.
            ends = {w for w in missed if self.open(w)}
            for k in holes if ends else ():
                if any(x is None and w in ends for w, x in zip(cut[k], found[k], strict=True)):
                    cut[k] = self.split(texts[k])
                    found[k] = list(map(get, cut[k]))
            self.learn({w for w in missed if len(w) <= LONGEST and not self.open(w)})
            for k in holes:
                words, ids, i = cut[k], found[k], -1
                while True:
                    try:
                        i = ids.index(None, i + 1)
                    except ValueError:
                        break
                    w = words[i]
                    ids[i] = kept[w] if w in kept else self.ids([" " + w])[0]
        for first, ids in zip(self.ids([words[0] for words in cut]), found, strict=True):
            ids[0] = first  # no space before it
        out = [b"".join(ids) for ids in found]
        for i in whole:
            out[i] = self.ids([texts[i]])[0]
        return out


class Missing(dict):
    """A dict that notes what it hasn't."""

    def __init__(self) -> None:
        super().__init__()
        self.missed: list[str] = []

    def __missing__(self, key: str) -> None:
        self.missed.append(key)


@lru_cache(2)
def encoder(path: str) -> TextEncoder:
    return TextEncoder(path)


keep("ids", encoder.cache_clear)


def open_folder(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri}")


def write_ids(docs: DataFrame, folder: str, model: str = "byte_bpe_50k.json", end_id: int = END_ID) -> DataFrame:
    """Write files of `docs` (doc_id, text) to the folder; a row of (file, path, n_ids, n_docs) for each, to be saved by the caller."""
    spark = docs.sparkSession
    prepare(spark)
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        keep_only("ids")
        number, enc, out = TaskContext.get().partitionId(), encoder(tokenizer_path(model)), None
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                part = batch.slice(i, 500)
                if out is None:
                    files, root = open_folder(folder)
                    files.create_dir(root, recursive=True)
                    path, temporary = f"{root}/ids-{number:06d}.pfor", f"{root}/.{uuid.uuid4().hex}.tmp"
                    stream = files.open_output_stream(temporary)
                    out = Writer(stream)
                texts = [t or "" for t in part.column(1).to_pylist()]
                for name, ids in zip(part.column(0).to_pylist(), enc.encode(texts), strict=True):
                    out.add(name, ids + end)
        if out is not None:
            total = out.close()
            stream.close()
            files.move(temporary, path)
            yield pa.RecordBatch.from_arrays([pa.array([number]), pa.array([f"{folder}/ids-{number:06d}.pfor"]), pa.array([total]), pa.array([len(out.sizes)])], ["file", "path", "n_ids", "n_docs"])

    size = docs.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).first()
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1 + size.n // FILE_ROWS, 1 + size.bytes // FILE_BYTES)
    keyed = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", F.xxhash64("text").alias("tie"))
    dealt = keyed.repartitionByRange(parts, F.col("doc_id").asc_nulls_first(), "tie").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "tie")
    return dealt.select("doc_id", "text").mapInArrow(run, "file bigint, path string, n_ids bigint, n_docs bigint")


def read_ids(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """Of the files' documents: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""
    start, rows = 0, []
    for row in manifest.orderBy("file").collect():  # one row a file
        rows.append((row.path, start))
        start += row.n_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, at in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                files, place = open_folder(path)
                names, starts, sizes, sums = [], [], [], []
                with files.open_input_file(place) as f:
                    for name, ids in read_documents(f):
                        names.append(name)
                        starts.append(at)
                        sizes.append(len(ids))
                        sums.append(zlib.crc32(ids.astype("<u4").tobytes()))
                        at += len(ids)
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (names, starts, sizes, sums)], ["doc_id", "start", "n_tokens", "ids_crc32"])

    prepare(spark)
    paths = spark.createDataFrame(rows, "path string, start bigint").repartition(max(1, len(rows)))
    return paths.mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def write_and_read(docs: DataFrame) -> DataFrame:
    work = Workspace(docs.sparkSession)
    manifest = work.save(write_ids(docs, f"{work.path}/files"), "manifest")
    return read_ids(docs.sparkSession, manifest)
