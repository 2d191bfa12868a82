"""Toxicity by a convolutional text classifier: hashed word embeddings, several filter widths, max pooling.

A word (lower case, without punctuation around it) has the sum of hashed rows: one of the word and one each of its first 4, 5
and 6 characters, so that inflected forms share what their stem has learnt. Filters of widths 1, 2 and 3 run over the whole text;
each one's maximum, rectified, goes to a logistic output. Training is in numpy on the driver, on at most MAX_ROWS labelled
rows of each class, chosen by a hash of doc_id among the rows that aren't held out, one row an id, none of more than MAX_BYTES. Slots seen in fewer than MIN_DOCS of them
keep the zero vector; the first coordinate begins as the slot's log odds.

Thresholds are calibrated by language on rows kept back from training. The language is guessed from the text's most
common words; the labelled language is never read. A score is the output, shifted so that 0.5 is the threshold for the
guessed language. Scoring takes whole texts, in pieces of PIECE words, so memory doesn't grow with a text's length.

Defined results: null and empty texts get the score of a text without known words; without labels of both classes every score
is 0; a null doc_id isn't held out; repeated rows are scored alike; an empty table gives an empty result.
"""

from __future__ import annotations

import string
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowfeed.llm.common import keep, keep_only, map_batches

MAX_ROWS, MAX_BYTES, MIN_DOCS = 3000, 32_768, 5
SLOTS, DIM, FILTERS, WIDTHS = 1 << 20, 8, 8, (1, 2, 3)
STEMS = (4, 5, 6)
EPOCHS, BATCH, RATE = 8, 32, 0.02
PIECE = 1 << 17
MAX_TOKENS = 300_000
MARKS = string.punctuation + "“”‘’«»¡¿…–—"
#: Common words by which a language is guessed (fixed values).
COMMON = {
    "en": "the of and to in that is was with for are this be on as it an from or at".split(),
    "es": "el los las que en un una por con para del se lo su es y al como no la".split(),
    "fr": "le les des et est une dans que pour sur au pas qui par la du un en de ce".split(),
    "de": "der die das und ist ein eine nicht mit den von zu im auf für sich dem des sie als".split(),
}
LANGUAGES = [*COMMON, "other"]


def features(token: str) -> list[int]:
    """Slots of a token: of the word, and of its stems. Slot 0 stands for nothing."""
    from xxhash import xxh64_intdigest

    word = token.strip(MARKS)
    keys = [word, *("^" + word[:n] for n in STEMS if len(word) >= n)] if word else []
    slots = [1 + xxh64_intdigest(k.encode()) % (SLOTS - 1) for k in keys]
    return slots + [0] * (1 + len(STEMS) - len(slots))


def language_bits(token: str) -> int:
    word = token.strip(MARKS)
    return sum(1 << i for i, words in enumerate(COMMON.values()) if word in words)


class Lexicon(dict):
    """Numbers of tokens as they are met, from 1, with the slots and language bits of each; 0 stands between texts."""

    def __init__(self) -> None:
        super().__init__()
        self.slots, self.bits = [[0] * (1 + len(STEMS))], [0]

    def __missing__(self, token: str) -> int:
        self.slots.append(features(token))
        self.bits.append(language_bits(token))
        self[token] = number = len(self.slots) - 1
        return number

    def encode(self, text: str | None) -> np.ndarray:
        words = text.lower().split() if text else []
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))


def languages(bits: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The guessed language of each text, from the words' language bits."""
    counts = np.stack([np.add.reduceat(bits >> i & 1, starts) for i in range(len(COMMON))], 1)
    return np.where(counts.max(1) > 0, counts.argmax(1), len(COMMON))


@dataclass
class Cnn:
    row: np.ndarray  # (SLOTS,): the slot's row below, 0 for slots that aren't known
    rows: np.ndarray  # (known + 1, DIM), zeros first
    filters: dict[int, np.ndarray]  # width -> (width, DIM, FILTERS)
    bias: np.ndarray  # (len(WIDTHS) * FILTERS,)
    out: np.ndarray
    out_bias: float
    shift: np.ndarray  # logit of the threshold, by language
    trained: bool = True
    stamp: str = ""  # of this training; workers keep vectors by it

    def embed(self, slots: np.ndarray) -> np.ndarray:
        return self.rows[self.row[slots]].sum(-2)

    def convolve(self, e: np.ndarray) -> np.ndarray:
        """(words, all filters): e has max(WIDTHS) - 1 rows of zeros at its end and after each text."""
        n = len(e) - max(WIDTHS) + 1
        return np.concatenate([sum(e[j : j + n] @ w[j] for j in range(k)) for k, w in self.filters.items()], 1)

    def logits(self, vectors: np.ndarray, codes: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Of texts that start where `starts` says, with zeros between; `vectors` has a row for each code."""
        best = np.full((len(starts), len(self.bias)), -np.inf, np.float32)
        pad = np.zeros(max(WIDTHS) - 1, np.int64)
        codes = np.concatenate([codes, pad])
        for a in range(0, len(codes) - len(pad), PIECE):
            c = self.convolve(vectors[codes[a : a + PIECE + len(pad)]])
            c[codes[a : a + len(c)] == 0] = -np.inf  # what begins between texts reaches into the next one
            inside = starts[(starts > a) & (starts < a + len(c))]
            cuts = np.concatenate([[0], inside - a]).astype(np.int64)
            which = np.searchsorted(starts, a, side="right") - 1 + np.arange(len(cuts))
            best[which] = np.maximum(best[which], np.maximum.reduceat(c, cuts))
        best[np.isinf(best)] = 0  # texts without words
        return np.maximum(best + self.bias, 0) @ self.out + self.out_bias


class Scorer:
    """A net with the vectors of the tokens met so far; they are forgotten beyond MAX_TOKENS."""

    def __init__(self, net: Cnn) -> None:
        self.net = net
        self.forget()

    def forget(self) -> None:
        self.lexicon, self.vectors, self.bits = Lexicon(), np.zeros((0, DIM), np.float32), np.zeros(0, np.int64)

    def scores(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(score, guessed language) of each text."""
        if len(self.lexicon) > MAX_TOKENS:
            self.forget()
        codes, starts = joined([self.lexicon.encode(t) for t in texts])
        if (have := len(self.bits)) < len(self.lexicon.bits):
            self.bits = np.concatenate([self.bits, np.array(self.lexicon.bits[have:], np.int64)])
            if self.net.trained:
                self.vectors = np.concatenate([self.vectors, self.net.embed(np.array(self.lexicon.slots[have:]))])
        lang = languages(self.bits[codes], starts)
        if not self.net.trained:
            return np.zeros(len(texts)), lang
        z = self.net.logits(self.vectors, codes, starts) - self.net.shift[lang]
        return 1 / (1 + np.exp(-np.clip(z.astype(np.float64), -40, 40))), lang


def joined(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Texts one after the other, with zeros between, and where they start."""
    gap = np.zeros(max(1, max(WIDTHS) - 1), np.int64)
    sizes = np.array([len(t) + len(gap) for t in texts], np.int64)
    return np.concatenate([x for t in texts for x in (t, gap)]), np.cumsum(sizes) - sizes


def untrained() -> Cnn:
    none = np.zeros((1, DIM), np.float32)
    return Cnn(np.zeros(1, np.int32), none, {}, np.zeros(0), np.zeros(0), 0.0, np.zeros(len(LANGUAGES)), trained=False)


def train(texts: list[str | None], labels: np.ndarray, calibrate: np.ndarray, seed: int = 11) -> Cnn:
    """Train on the rows where `calibrate` is false; thresholds come from the others."""
    fit = np.flatnonzero(~calibrate)
    if len(set(labels[fit].tolist())) < 2:
        return untrained()
    rng = np.random.default_rng(seed)
    lexicon = Lexicon()
    coded = [lexicon.encode(t) for t in texts]
    slots = np.array(lexicon.slots)
    seen = np.zeros((2, SLOTS))  # class, slot
    for i in fit:
        seen[labels[i], np.unique(slots[coded[i]])] += 1
    size = np.array([(labels[fit] == 0).sum(), (labels[fit] == 1).sum()])
    known = seen.sum(0) >= MIN_DOCS
    known[0] = False
    row = np.where(known, np.cumsum(known), 0).astype(np.int32)
    rows = np.zeros((1 + int(known.sum()), DIM), np.float32)
    rows[1:] = rng.normal(0, 0.05, rows[1:].shape)
    odds = np.log((seen[1] + 1) / (size[1] + 2)) - np.log((seen[0] + 1) / (size[0] + 2))
    rows[1:, 0] = odds[known] / 4
    filters = {k: rng.normal(0, 0.2, (k, DIM, FILTERS)).astype(np.float32) for k in WIDTHS}
    for w in filters.values():
        w[:, 0, : FILTERS // 2] += 1 / len(w)
    n_out = len(WIDTHS) * FILTERS
    net = Cnn(row, rows, filters, np.full(n_out, -0.2, np.float32), rng.normal(0.1, 0.1, n_out).astype(np.float32), 0.0, np.zeros(len(LANGUAGES)))
    weight = np.where(labels == 1, size.sum() / 2 / size[1], size.sum() / 2 / size[0])
    # Sums of squared gradients, for steps that get smaller.
    sums = {"b": np.full(n_out, 1e-6), "o": np.full(n_out, 1e-6), "c": 1e-6, "e": np.full((len(rows), 1), 1e-4, np.float32)} | {k: np.full_like(w, 1e-6) for k, w in filters.items()}
    for _ in range(EPOCHS):
        order = rng.permutation(fit)
        for a in range(0, len(order), BATCH):
            part = order[a : a + BATCH]
            codes, starts = joined([coded[i] for i in part])
            of_word = row[slots[np.concatenate([codes, np.zeros(max(WIDTHS) - 1, np.int64)])]]
            e = rows[of_word].sum(1)
            conv = net.convolve(e)
            conv[codes == 0] = -np.inf
            ends = np.append(starts[1:], len(conv))
            at = np.stack([s + conv[s:t].argmax(0) for s, t in zip(starts, ends, strict=True)])
            h = np.maximum(np.take_along_axis(conv, at, 0) + net.bias, 0)
            p = 1 / (1 + np.exp(-(h @ net.out + net.out_bias)))
            dz = (p - labels[part]) * weight[part] / len(part)
            dh = dz[:, None] * net.out * (h > 0)
            do, db = h.T @ dz + 1e-4 * net.out, dh.sum(0)
            places, grads = [], []
            for i, k in enumerate(WIDTHS):
                mine = slice(i * FILTERS, (i + 1) * FILTERS)
                df = np.zeros_like(filters[k])
                for j in range(k):
                    df[j] = np.einsum("rfd,rf->df", e[at[:, mine] + j], dh[:, mine])
                    places.append((at[:, mine] + j).ravel())
                    grads.append((dh[:, mine, None] * filters[k][j].T[None]).reshape(-1, DIM))
                sums[k] += df * df
                filters[k] -= (RATE * df / np.sqrt(sums[k])).astype(np.float32)
            for name, x, g in (("b", net.bias, db), ("o", net.out, do)):
                sums[name] += g * g
                x -= RATE * g / np.sqrt(sums[name])
            sums["c"] += dz.sum() ** 2
            net.out_bias -= RATE * dz.sum() / np.sqrt(sums["c"])
            which, index = np.unique(of_word[np.concatenate(places)].ravel(), return_inverse=True)
            g = np.zeros((len(which), DIM), np.float32)
            np.add.at(g, index.ravel(), np.repeat(np.concatenate(grads), of_word.shape[1], 0))
            g[which == 0] = 0
            sums["e"][which] += (g * g).mean(1, keepdims=True)
            rows[which] -= RATE * g / np.sqrt(sums["e"][which])
    net.shift = thresholds(net, [texts[i] for i in np.flatnonzero(calibrate)], labels[calibrate])
    return net


def thresholds(net: Cnn, texts: list[str | None], y: np.ndarray) -> np.ndarray:
    """By language, the logit that parts the classes with the best F1; over all where a language has few rows."""
    if not texts:
        return np.zeros(len(LANGUAGES))
    p, lang = Scorer(net).scores(texts)
    z = np.log(p / (1 - p))

    def best(z: np.ndarray, y: np.ndarray) -> float | None:
        if min((y == 0).sum(), (y == 1).sum()) < 10:
            return None
        order = np.argsort(z, kind="stable")
        z, y = z[order], y[order]
        # F1 if the first i are called clean; the middle of the widest gap among the best.
        hits = y.sum() - np.concatenate([[0], np.cumsum(y)])
        f1 = 2 * hits / (y.sum() + np.arange(len(y), -1, -1))
        edges = np.concatenate([[z[0] - 1], z, [z[-1] + 1]])
        i = max(np.flatnonzero(f1 >= f1.max() - 1e-12), key=lambda k: edges[k + 1] - edges[k])
        return float((edges[i] + edges[i + 1]) / 2)

    overall = best(z, y)
    overall = 0.0 if overall is None else overall
    own = [best(z[lang == i], y[lang == i]) for i in range(len(LANGUAGES))]
    return np.array([overall if x is None else x for x in own])


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> Cnn:
    """The net from at most `max_rows` labelled rows of each class, none held out. What the driver holds is bounded by these."""
    marked = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out()).select("doc_id", "toxic")
    chosen = [marked.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows) for y in (0, 1)]
    picked = docs.select("doc_id", "text").where(F.coalesce(F.octet_length("text"), F.lit(0)) <= MAX_BYTES).join(F.broadcast(chosen[0].union(chosen[1]).distinct()), "doc_id")
    # Of rows with one id, the one with the least hash of the text.
    picked = picked.groupBy("doc_id", "toxic").agg(F.min_by("text", F.coalesce(F.xxhash64("text"), F.lit(0))).alias("text"))
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 1
    table = picked.select("doc_id", "text", F.col("toxic").cast("int").alias("toxic"), fold.alias("calibrate")).toArrow().sort_by([("doc_id", "ascending"), ("text", "ascending")])
    if not table.num_rows:
        return untrained()
    return train(table.column("text").to_pylist(), table.column("toxic").to_numpy().astype(np.int64), table.column("calibrate").to_numpy())


_SCORERS: dict[str, Scorer] = {}
keep("toxicity", _SCORERS.clear)


def scorer_of(sent: Broadcast[Cnn]) -> Scorer:
    """The worker's scorer for a net that was sent; only the last one is kept."""
    if sent.value.stamp not in _SCORERS:
        _SCORERS.clear()
        _SCORERS[sent.value.stamp] = Scorer(sent.value)
    return _SCORERS[sent.value.stamp]


def score(docs: DataFrame, net: Cnn) -> DataFrame:
    """One row for each document: doc_id, held_out, score, predicted, language (guessed). One pass, no shuffle."""
    net.stamp = uuid.uuid4().hex
    sent = docs.sparkSession.sparkContext.broadcast(net)

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        keep_only("toxicity")
        scorer = scorer_of(sent)
        values, lang = [], []
        for i in range(0, batch.num_rows, 250):
            v, g = scorer.scores(batch.column(1).slice(i, 250).to_pylist())
            values.append(v)
            lang += [LANGUAGES[x] for x in g]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(values)), pa.array(lang)], ["doc_id", "score", "language"])

    read = docs.select("doc_id", "text")
    out = map_batches(read, run, f"doc_id {read.schema['doc_id'].dataType.simpleString()}, score double, language string")
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "language")


def score_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs, learn(docs, labels))
