"""Token counts by a finite-state transducer compiled from a byte-fallback BPE vocabulary.

Merging takes the best-scored adjacent pair, leftmost first. A sequence of pieces is the result for its text exactly if
each two neighbours are the result for their own two-piece text (a merge across a boundary would show there already). So
the result for a prefix is fixed by its last piece, and the last piece at a position by those at the few earlier
positions from which a vocabulary piece can still reach on. These (position's trie node, last piece before it, count
difference) are the transducer's state; reading a character moves to the next state and emits the change of the count.
States and transitions are compiled when first needed and kept. A pair of characters that no piece contains resets the
state, so a text falls into segments whose counts add up; their counts are kept as well, as compound transitions.

Long texts are cut into chunks at any character. The map of a chunk takes each state in which the text before can leave the
transducer to the state after the chunk and the count in between. A chunk with a reset has one state after it, whatever the
state before, so maps are small. They compose associatively: the counts at the ends of all chunks come from a prefix scan.

Defined results: null counts as the empty text, which has no tokens; repeated rows are counted alike; any length is
counted whole; an empty table gives an empty result; columns other than the id and the text are not read.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from typing import TypeVar

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowfeed.llm.common import Kept, keep, keep_only, map_batches

#: The vocabulary's own character for a space, and the one used here, with which texts stay in one byte a character where they can.
MARK, SPACE = "▁", " "
#: Kept segments, states and pairs are forgotten beyond these numbers; they are found again when needed.
MAX_SEGMENTS, MAX_STATES, MAX_PAIRS = 900_000, 250_000, 250_000
#: A state's entries are packed into integers: trie node, number of the last piece, count difference.
NODE_BITS, PIECE_BITS, BIAS = 20, 20, 128
CHUNK_CHARS = 1 << 16
T = TypeVar("T")


#: State before -> (state after, count in between).
ChunkMap = dict[bytes, tuple[bytes, int]]


class TokenCounter:
    """pieces: (piece, score) of the vocabulary; the text's spaces become the piece character for them, one more goes before."""

    def __init__(self, pieces: Iterable[tuple[str, float]]) -> None:
        self.score = {p.replace(MARK, SPACE): s for p, s in pieces}
        self.trie: list[dict[str, int]] = [{}]
        self.piece_at: dict[int, str] = {}
        for piece in self.score:
            node = 0
            for ch in piece:
                node = self.trie[node].setdefault(ch, len(self.trie))
                if node == len(self.trie):
                    self.trie.append({})
            self.piece_at[node] = piece
        self.chars = {p for p in self.score if len(p) == 1}
        self.pairs_in = {p[i : i + 2] for p in self.score for i in range(len(p) - 1)}
        self.names = ["", *self.score]
        self.number = {p: i for i, p in enumerate(self.names)}
        self.valid = Kept(self._pair, MAX_PAIRS)
        self._reset_states()
        self.counts = Kept(self.run, MAX_SEGMENTS)
        self._find_resets()

    def _find_resets(self) -> None:
        """Where the vocabulary allows: resets before each run of spaces, around a newline, and between letters and other characters."""
        letters = {c for c in self.chars if c.isalpha()}
        across = [p for p in self.pairs_in if SPACE not in p and (p[0] in letters) != (p[1] in letters)]
        if any(SPACE in p.lstrip(SPACE) for p in self.score):
            self.find, self.reset = lambda s: [s] if s else [], lambda _s: None
            return
        line = "\\n" if all("\n" not in p for p in self.pairs_in) else ""
        kinds = [f"[{re.escape(''.join(sorted(letters)))}]+", f"[^{re.escape(''.join(sorted(letters)))}{SPACE}{line}]+"] if letters and not across else [f"[^{SPACE}{line}]+"]
        self.find = re.compile("|".join([*(f"{SPACE}*{k}" for k in kinds), f"{SPACE}+", *([line] if line else [])])).findall
        self.reset = re.compile(f"(?<=[^{SPACE}])(?={SPACE})" + (f"|(?<={line})|(?={line})" if line else "")).search

    def _reset_states(self) -> None:
        self.items: list[bytes] = []
        self.ids: dict[bytes, int] = {}
        self.moves: list[dict[str, int]] = []
        self.state((BIAS << NODE_BITS + PIECE_BITS,))  # at the root, after nothing

    def state(self, entries: tuple[int, ...]) -> int:
        items = struct.pack(f"<{len(entries)}Q", *entries)
        if items not in self.ids:
            self.ids[items] = len(self.items)
            self.items.append(items)
            self.moves.append({})
        return self.ids[items]

    def _pair(self, pair: int) -> bool:
        """Whether two pieces (the first may be none) are the result for their text."""
        parts = [self.names[pair >> PIECE_BITS], self.names[pair & (1 << PIECE_BITS) - 1]]
        return self.merge("".join(parts)) == [x for x in parts if x]

    def merge(self, text: str) -> list[str]:
        """The defining procedure, for the short texts of two pieces."""
        parts = list(text)
        while True:
            best = max(((self.score[a + b], -i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in self.score), default=None)
            if best is None:
                return parts
            i = -best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]

    def move(self, at: int, ch: str) -> int:
        """The next state and the change of the count, packed."""
        if ch not in self.chars:
            return len(ch.encode()) + BIAS  # bytes, and nothing merges with them: to the reset state
        on, won = [], None
        for item in struct.unpack(f"<{len(self.items[at]) // 8}Q", self.items[at]):
            node, last, rel = item & (1 << NODE_BITS) - 1, item >> NODE_BITS & (1 << PIECE_BITS) - 1, (item >> NODE_BITS + PIECE_BITS) - BIAS
            nxt = self.trie[node].get(ch)
            if nxt is None:
                continue
            piece = self.piece_at.get(nxt)
            if won is None and piece is not None and self.valid[last << PIECE_BITS | self.number[piece]]:
                won = self.number[piece], rel + 1
            if self.trie[nxt]:
                on.append((nxt, last, rel))
        piece, change = won
        packed = (*(n | p << NODE_BITS | (r - change + BIAS) << NODE_BITS + PIECE_BITS for n, p, r in on), piece << NODE_BITS | BIAS << NODE_BITS + PIECE_BITS)
        return self.state(packed) << 8 | (change + BIAS)

    def run(self, text: str) -> int:
        """The count of a segment read from the reset state."""
        if len(self.items) > MAX_STATES:
            self._reset_states()
        at = total = 0
        for ch in text:
            step = self.moves[at].get(ch)
            if step is None:
                step = self.moves[at][ch] = self.move(at, ch)
            at = step >> 8
            total += (step & 255) - BIAS
        return total

    def segments(self, text: str) -> int:
        return sum(map(self.counts.__getitem__, self.find(text)))

    def walk(self, state: bytes, text: str) -> tuple[bytes, int]:
        """The state after the text, read from a state, and the change of the count. States are named by what they hold, as numbers are given anew."""
        if len(self.items) > MAX_STATES:
            self._reset_states()
        at, total = self.state(struct.unpack(f"<{len(state) // 8}Q", state)), 0
        for ch in text:
            step = self.moves[at].get(ch)
            if step is None:
                step = self.moves[at][ch] = self.move(at, ch)
            at = step >> 8
            total += (step & 255) - BIAS
        return self.items[at], total

    def chunk_map(self, text: str, entries: Iterable[bytes]) -> ChunkMap:
        first = self.reset(text)
        if first is None:
            return {q: self.walk(q, text) for q in entries}
        parts = self.find(text[first.start() :])
        after, count = self.walk(self.items[0], parts[-1])
        count += sum(map(self.counts.__getitem__, parts[:-1]))
        return {q: (after, self.walk(q, text[: first.start()])[1] + count) for q in entries}

    def prefix_counts(self, text: str, chunk_chars: int = CHUNK_CHARS) -> list[int]:
        """The counts of the text's prefixes that end with its chunks."""
        text = SPACE + text.replace(MARK, SPACE)
        start, maps = self.items[0], []
        entries = {start}
        for i in range(0, len(text), chunk_chars):
            maps.append(self.chunk_map(text[i : i + chunk_chars], entries))
            entries = {after for after, _ in maps[-1].values()}
        return [m[start][1] for m in prefix_scan(maps, compose)]

    def count(self, text: str, chunk_chars: int = CHUNK_CHARS) -> int:
        if not text:
            return 0
        if len(text) < chunk_chars:
            return self.segments(SPACE + text.replace(MARK, SPACE))
        return self.prefix_counts(text, chunk_chars)[-1]


def compose(f: ChunkMap, g: ChunkMap) -> ChunkMap:
    """First f, then g."""
    return {q: (g[state][0], n + g[state][1]) for q, (state, n) in f.items()}


def prefix_scan(items: list[T], compose: Callable[[T, T], T]) -> list[T]:
    """All prefix compositions: pairs are composed first, then the scan of half the length fills in the rest."""
    if len(items) < 2:
        return list(items)
    half = prefix_scan([compose(a, b) for a, b in zip(items[::2], items[1::2], strict=False)], compose)
    return [items[0], *(half[i // 2] if i % 2 else compose(half[i // 2 - 1], items[i]) for i in range(1, len(items)))]


def load_pieces(path: str) -> list[tuple[str, float]]:
    """Normal pieces of a sentencepiece model file. Only identity normalisation with a space put before, and byte fallback, are compiled."""
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as f:
        model.ParseFromString(f.read())
    n, t = model.normalizer_spec, model.trainer_spec
    if (t.model_type, t.byte_fallback, n.name, n.add_dummy_prefix, n.remove_extra_whitespaces, n.escape_whitespaces) != (2, True, "identity", True, False, True):
        raise ValueError("only byte-fallback BPE with identity normalisation and a space before the text is supported")
    if any(p.type not in (1, 2, 3, 6) for p in model.pieces):
        raise ValueError("user-defined and unused pieces are not supported")
    return [(p.piece, p.score) for p in model.pieces if p.type == 1]


@lru_cache(2)
def counter(path: str) -> TokenCounter:
    return TokenCounter(load_pieces(path))


keep("tokens", counter.cache_clear)


def tokenizer_path(name: str) -> str:
    """A vocabulary file's place on this machine; workers look it up themselves."""
    import public_tokenizers

    return public_tokenizers.path(name)


def count_tokens(docs: DataFrame, model: str = "piece_bpe_32k.model", limit: int = 4096, id_col: str = "doc_id", text_col: str = "text", carry: dict[str, Column] | None = None) -> DataFrame:
    """One row for each row: id, n_bytes, n_tokens, over_limit (n_tokens > limit), and what `carry` says. One pass, no shuffle."""
    more = [c.alias(name) for name, c in (carry or {}).items()]

    def count(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        keep_only("tokens")
        c = counter(tokenizer_path(model))
        sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).cast(pa.int64())
        tokens = pa.array((c.count(t.as_py() or "") for t in batch.column(1)), pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0), sizes, tokens, *batch.columns[2:]], ["doc_id", "n_bytes", "n_tokens", *batch.schema.names[2:]])

    read = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), *more)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in read.schema)
    out = map_batches(read, count, kinds.replace("`text` string", "n_bytes bigint, n_tokens bigint", 1))
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"), *(carry or {}))
