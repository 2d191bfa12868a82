"""Packing, substring dedup, id files, near-duplicates, and the pipeline, against plain versions."""

import cProfile
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from rowfeed.llm import best_fit, chaining, fst_tokens, pfor_ids, queries, quality_rules, simhash_anchor
from rowfeed.llm.common import space_words
from tests.llm.conftest import prose


def pack_model(rows, capacity):
    """Best fit by looking at all bins for each piece."""
    source, cluster = best_fit.bits_of([r[2] for r in rows]), best_fit.bits_of([r[3] for r in rows])
    bins, out, rest, turn = [], [], [], 0

    def put(size, s, c):
        nonlocal turn
        turn += 1
        fits = [b for b in bins if b[0] >= size and not (b[1] & s or b[2] & c)]
        b = min(fits, key=lambda b: (b[0], b[3])) if fits else None
        if b is None:
            b = [capacity, 0, 0, 0, len(bins)]
            bins.append(b)
        offset = capacity - b[0]
        b[0], b[1], b[2], b[3] = b[0] - size, b[1] | s, b[2] | c, turn
        return b[4], offset

    for k, (name, size, src, _) in enumerate(rows):
        full, left = divmod(size, capacity)
        out += [(name, p, p * capacity, capacity, *put(capacity, source[k], cluster[k])) for p in range(full)]
        if left:
            rest.append((-left, name, src or "", full, k))
        elif not full:
            out.append((name, 0, 0, 0, None, None))
    for left, name, _, piece, k in sorted(rest):
        out.append((name, piece, piece * capacity, -left, *put(-left, source[k], cluster[k])))
    return out


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 30), st.sampled_from(["a", "a", "a", "b", "c", None]), st.sampled_from([1, 1, 2, 3, 4, 5, None])), max_size=60))
def test_packing_is_best_fit(rows):
    rows = [(i, *r) for i, r in enumerate(rows)]
    assert sorted(best_fit.pack_shard(rows, 12), key=str) == sorted(pack_model(rows, 12), key=str)


def test_packing_query_equals_plain(spark, sf):
    """The whole query against counts by the library and a scan of all bins; the table is one shard."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=fst_tokens.tokenizer_path("piece_bpe_32k.model"))
    docs = sorted(queries.documents(spark, sf).select("doc_id", "text", "source").collect())
    rows = [(d.doc_id, len(model.encode(d.text or "", num_threads=1)), d.source, None if d.text is None else " ".join(d.text.lower().split())) for d in docs]
    want = sorted(pack_model(rows, best_fit.CAPACITY), key=str)
    assert sorted(map(tuple, queries.op5_best_fit_packing(spark, sf).collect()), key=str) == want


def test_bins_don_t_depend_on_files(spark, odd):
    docs = odd.select("doc_id", "text", "source").unionByName(odd.select("doc_id", "text", "source").limit(5))
    docs = spark.createDataFrame(docs.collect(), docs.schema)
    one, two = (sorted(map(str, best_fit.pack(best_fit.Workspace(spark).save(sized(docs.repartition(n)), f"sized-{n}"), 4096, 4).collect())) for n in (1, 7))
    assert one == two and len({r.split("bin_id=")[1] for r in one}) > 4


def sized(docs):
    counted = fst_tokens.count_tokens(docs, carry={"source": F.col("source"), "cluster": F.xxhash64("text")})
    return counted.select("doc_id", "n_tokens", "source", "cluster")


def test_packing_query(spark, sf):
    docs = {r.doc_id: r for r in queries.documents(spark, sf).collect()}
    size = {r.doc_id: r.n_tokens for r in queries.op1_token_counts(spark, sf).collect()}
    bins, got = {}, {}
    for r in queries.op5_best_fit_packing(spark, sf).collect():
        got.setdefault(r.doc_id, []).append((r.start_token, r.n_tokens))
        if r.bin_id is not None:
            bins.setdefault(r.bin_id, []).append(r)
    for d, pieces in got.items():
        pieces.sort()
        assert sum(n for _, n in pieces) == size[d] and all(a[0] + a[1] == b[0] for a, b in zip(pieces, pieces[1:], strict=False))
    assert set(got) == set(docs)
    for rows in bins.values():
        rows.sort(key=lambda r: r.bin_offset)
        assert all(a.bin_offset + a.n_tokens == b.bin_offset for a, b in zip(rows, rows[1:], strict=False))
        assert sum(r.n_tokens for r in rows) <= 4096
        assert len({docs[r.doc_id].source for r in rows}) == len(rows) == len({docs[r.doc_id].text for r in rows})


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 30), st.integers(0, 30)), max_size=25, unique=True))
def test_chains_are_best(anchors):
    """By the score of runs of anchors on one diagonal that follow each other closely, chained by trying all."""
    anchors = sorted(anchors)
    b, a = (np.array([x[i] for x in anchors], int) for i in (0, 1))
    found = chaining.chains(np.zeros(len(anchors), int), b, a)
    seen = [i for c in found for i in c.tolist()]
    assert len(seen) == len(set(seen))
    for c in found:
        assert (np.diff(b[c]) > 0).all() and (np.diff(a[c]) > 0).all()

    def score(c):
        return len(c) - chaining.GAP_COST / 2 * sum(b[j] - b[i] + a[j] - a[i] for i, j in zip(c, c[1:], strict=False))

    parts = []
    for i in range(len(anchors)):
        if parts and a[i] - b[i] == a[i - 1] - b[i - 1] and b[i] - b[i - 1] <= chaining.WINDOW:
            parts[-1].append(i)
        else:
            parts.append([i])
    best = {}
    for k, part in enumerate(parts):
        before = [j for j in best if b[parts[j][-1]] < b[part[0]] and a[parts[j][-1]] < a[part[0]]]
        gap = lambda j: chaining.GAP_COST / 2 * (b[part[0]] - b[parts[j][-1]] + a[part[0]] - a[parts[j][-1]])  # noqa: E731, B023
        best[k] = score(part) + max([0.0, *(best[j] - gap(j) for j in before)])
    if found:
        assert score(found[0].tolist()) == pytest.approx(max(best.values()))


def test_repeated_units_found_by_samples():
    """As by comparing every word with the p-th after it."""
    r, found = np.random.default_rng(4), 0
    for _ in range(150):
        parts = [np.resize(r.integers(1, 30, int(r.integers(1, 27))), int(r.integers(20, 300))) if r.random() < 0.6 else r.integers(0, 9, int(r.integers(1, 60))) for _ in range(int(r.integers(1, 6)))]
        words, want, reach = np.concatenate([np.zeros(1, int), *parts]).astype(np.uint16), [], {}
        for p in range(1, min(chaining.PERIOD, len(words) - 1) + 1):
            equal = [*((words[:-p] == words[p:]) & (words[:-p] > 0)).tolist(), False]
            low = 0
            for i, e in enumerate(equal):
                if not e:
                    if i + p - low >= chaining.MIN_WORDS and reach.get(low, 0) < i + p:
                        want.append((low, i + p))
                        reach |= dict.fromkeys(range(low, i + p), i + p)
                    low = i + 1
        got = chaining.periodic(words)
        assert [g[:2] for g in got] == sorted(want)
        found += len(got)
    assert found > 100


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=12), st.lists(st.integers(0, 3), max_size=12))
def test_alignment_has_least_edit_distance(x, y):
    d = list(range(len(y) + 1))
    for i, a in enumerate(x):
        d = [i + 1, *d[1:]] if False else [*_row(d, i, a, y)]
    matched, extra = chaining.edit_matches(np.array(x, int), np.array(y, int))
    assert len(x) - int(matched.sum()) + extra == d[-1]


def _row(d, i, a, y):
    out = [i + 1]
    for j, b in enumerate(y):
        out.append(min(d[j + 1] + 1, out[-1] + 1, d[j] + (a != b)))
    return out


def plain_edits(x, y):
    """Which words of x an alignment of least edit distance matches: what both begin and end with, and the last such alignment between."""
    size = min(len(x), len(y))
    head = next((i for i in range(size) if x[i] != y[i]), size)
    tail = next((i for i in range(size - head) if x[-1 - i] != y[-1 - i]), size - head)
    i, j = len(x) - head - tail, len(y) - head - tail
    matched, x, y = [*range(head), *range(len(x) - tail, len(x))], x[head : head + i], y[head : head + j]
    costs = [list(range(j + 1))]
    for n, w in enumerate(x):
        costs.append(_row(costs[-1], n, w, y))
    while i or j:
        if i and j and costs[i][j] == costs[i - 1][j - 1] + (x[i - 1] != y[j - 1]):
            i, j = i - 1, j - 1
            matched += [head + i] if x[i] == y[j] else []
        elif j and costs[i][j] == costs[i][j - 1] + 1:
            j -= 1
        else:
            i -= 1
    return matched


def plain_extend(x, y):
    """Scores of x from its first word on: along y, over a difference if more than 0.6 of the words after it match."""
    score, i, j, error = [-4.0] * len(x), 0, 0, 0.0
    extra = [0] * (len(x) + 1)
    while i < len(x) and j < len(y):
        if x[i] == y[j]:
            score[i], i, j = 1.0, i + 1, j + 1
            continue
        best, step = 0.6, None
        for p, q in chaining.STEPS:
            k = min(chaining.LOOK, len(x) - i - p, len(y) - j - q)
            share = sum(x[i + p + n] == y[j + q + n] for n in range(k)) / k if k > 0 else 0.0
            if share > best:
                best, step = share, (p, q)
                if share > 0.8:
                    break
        if not step:
            break
        i, j = i + step[0], j + step[1]
        extra[i] += max(0, step[1] - step[0])
    return [s - 4 * e for s, e in zip(score, extra, strict=False)]


def plain_align(x, y, b, a):
    """Chain by chain and word by word."""
    score, end = [-4.0] * len(x), chaining.KMER
    for n, (i, j) in enumerate(zip(b, a, strict=True)):
        if n and j - i == a[n - 1] - b[n - 1]:
            span = range(b[n - 1], i + end)
        else:
            span = range(i, i + end)
            if n and max(i - b[n - 1], j - a[n - 1]) - end <= chaining.MAX_GAP and min(i - b[n - 1], j - a[n - 1]) > end:
                for k in plain_edits(x[b[n - 1] + end : i], y[a[n - 1] + end : j]):
                    score[b[n - 1] + end + k] = 1.0
        for k in span:
            if k + j - i < len(y):
                score[k] = 1.0 if x[k] == y[k + j - i] else -4.0
    low, high, margin = max(0, b[0] - chaining.MARGIN), min(len(x), b[-1] + end + chaining.MARGIN), chaining.MARGIN
    score[b[-1] + end : high] = plain_extend(x[b[-1] + end : high], y[a[-1] + end : a[-1] + high - b[-1] + margin])
    score[low : b[0]] = plain_extend(x[low : b[0]][::-1], y[max(0, a[0] - b[0] + low - margin) : a[0]][::-1])[::-1]
    out, i = [], low
    while i < high:
        total, best, last = 0, 0, i
        for k in range(i, high if score[i] > 0 else i):
            total += score[k]
            if total > best:
                best, last = total, k + 1
            elif total <= 0 or total < best - 4 * chaining.MAX_GAP:
                break
        if last - i >= chaining.MIN_PART:
            out.append((i, last))
        i = max(last, i + 1)
    return out if sum(s > 0 for s in score[low:high]) >= chaining.MIN_PART * chaining.SIMILARITY else []


def changed_copies(r, n):
    """Texts with changed copies of them, and chains of the seeds that they share: (x, y, places in x, in y)."""
    out = []
    while len(out) < n:
        words = int(r.choice([3, 60, 5000]))
        x = r.integers(1, words + 1, int(r.integers(8, 300))).tolist()
        rate, y = r.choice([0.0, 0.03, 0.12]), r.integers(1, words + 1, int(r.integers(0, 90))).tolist()
        for w in x[int(r.integers(0, 40)) :]:
            u = r.random()
            y += r.integers(1, words + 1, 1).tolist() if u < rate else [] if u < 1.3 * rate else [w, *r.integers(1, words + 1, int(r.integers(1, 6))).tolist()] if u < 1.6 * rate else [w]
        y = y[: int(r.integers(len(y) // 2, len(y) + 1))]
        seeds = {}
        for j in range(len(y) - chaining.KMER + 1):
            seeds.setdefault(tuple(y[j : j + chaining.KMER]), []).append(j)
        anchors = [(i, j) for i in range(len(x) - chaining.KMER + 1) if r.random() < 0.4 for j in seeds.get(tuple(x[i : i + chaining.KMER]), [])[:2]]
        if len(anchors) >= chaining.MIN_ANCHORS:
            b, a = np.array(anchors).T
            out += [(np.array(x, np.uint16), np.array(y, np.uint16), b[c], a[c]) for c in chaining.chains(np.zeros(len(b), int), b, a)]
    return out


def test_chains_are_aligned_together():
    """The parts of a plain alignment, chain by chain, with few calls for each chain (chain by chain it took over 100)."""
    found = changed_copies(np.random.default_rng(3), 500)
    want = [(k, -1 - k, 3 + s, 3 + e, k) for k, (x, y, b, a) in enumerate(found) for s, e in plain_align(x.tolist(), y.tolist(), b.tolist(), a.tolist())]
    assert len({k for k, *_ in want}) > 100
    rows = []
    for k, (x, y, b, a) in enumerate(found):
        rows += [(k, 0, k, chaining._packers()[0].compress(y.tobytes()), None, None, None), (k, 1, -1 - k, x.tobytes(), k, 3, chaining.packed_places(b + 3, a))]
    rows.append((len(found), 1, 0, b"", 0, 0, b""))  # a chain without its document's words
    rows.insert(2, (0, 1, None, b"", 7, 9, chaining.packed_places(np.array([9]), np.array([60]))))  # a stretch that repeats a unit
    columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.int64(), pa.int32(), pa.binary()], strict=True)]
    batch = pa.RecordBatch.from_arrays(columns, ["key", "kind", "doc", "words", "row", "start", "places"])
    calls = cProfile.Profile()
    parts = calls.runcall(lambda: list(chaining._aligned(iter([batch.slice(0, 3), batch.slice(3)]))))
    got = [tuple(r.values()) for p in parts for r in p.to_pylist()]
    assert sorted(got, key=str) == sorted([(7, None, 9, 69, 0), *want], key=str)
    assert sum(c.callcount for c in calls.getstats()) < 40 * len(found)


def test_every_window_has_a_seed():
    r = np.random.default_rng(0)
    texts = [r.integers(1, 2**16, n).astype(np.uint16) for n in (0, 3, 5, 11, 12, 1000, 1969)]
    texts.append(texts[5][100:180])
    (seed, doc, pos, context), repeats = chaining.seeds(texts)
    assert not len(repeats[0])
    for d, t in enumerate(texts):
        at = pos[doc == d]
        if len(t) >= chaining.KMER:
            assert len(at) and at[0] < chaining.WINDOW and (np.diff(at) <= chaining.WINDOW).all() and len(t) - chaining.KMER - at[-1] < chaining.WINDOW
        else:
            assert not len(at)
    # Inside a shared run the same k-mers are taken, and contexts agree as far as the run goes.
    whole = {int(s): (p, c) for s, d, p, c in zip(seed, doc, pos, context, strict=True) if d == 5}
    for s, p, c in [(int(s), p, c) for s, d, p, c in zip(seed, doc, pos, context, strict=True) if d == 7 and 7 <= p <= 68]:
        assert whole[s][0] == p + 100
        assert chaining.alike(np.array([c]), np.array([whole[s][1]]))[0] >= 2 * min(chaining.NEAR, 80 - p - chaining.KMER)


def test_stretches_that_repeat_a_unit():
    r = np.random.default_rng(1)
    text = lambda n: r.integers(1, 2**16, n).astype(np.uint16)
    one, unit = np.full(60, 7, np.uint16), text(11)
    _, (hashes, doc, start, size) = chaining.seeds([np.concatenate([text(30), one, text(5)]), np.concatenate([np.tile(unit, 6)[3:], text(40)]), np.tile(unit, 5)[:49], np.concatenate([text(9), np.tile(unit, 7)])])
    assert [(int(d), int(s), int(n)) for d, s, n in zip(doc, start, size, strict=True)] == [(0, 30, 60), (1, 0, 63), (3, 9, 77)]
    assert hashes[1] == hashes[2] != hashes[0]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 2), st.integers(0, 5), st.integers(0, 30), st.sampled_from([0, 1, 1 << 56, 3 << 48, 1 << 48])), max_size=40, unique_by=lambda x: x[1:3]))
def test_partners_agree_most(rows):
    seed, rank, pos, context = (np.array([r[i] for r in rows], t) for i, t in enumerate((np.uint64, np.int64, np.int64, np.uint64)))
    got = chaining.partners(seed, rank, pos, context) if rows else []
    for i, p in enumerate(got):
        earlier = [j for j in range(len(rows)) if seed[j] == seed[i] and rank[j] < rank[i]]
        if not earlier:
            assert p == -1
        else:
            most = max(chaining.alike(context[[j]], context[[i]])[0] for j in earlier)
            assert p in earlier and chaining.alike(context[[p]], context[[i]])[0] == most


def planted(r):
    """Texts with exact, fuzzy and short repeats; (texts, words of each that must be found, texts to leave alone)."""
    exact, fuzzy, short = prose(r, 70).split(), prose(r, 90).split(), prose(r, 25).split()
    damaged = [w if i % 12 else f"new{i}" for i, w in enumerate(fuzzy)]
    fill = lambda n: [f"u{r.random()}" for _ in range(n)]
    texts = {
        1: fill(30) + exact + fill(20), 2: fill(100), 3: fill(5) + exact, 4: fuzzy + fill(9), 5: fill(40) + exact + fill(1) + short, 6: fill(12) + damaged + fill(3), 7: short + fill(60),
        8: ["tick"] * 90, 9: fill(3) + ["tick"] * 80,
    }
    want = {3: set(range(5, 75)), 5: set(range(40, 110)), 6: set(range(13, 100)), 9: set(range(3, 83))}
    return {k: " ".join(v) for k, v in texts.items()}, want


@pytest.mark.parametrize("parts", [1, 5])
def test_planted_passages(spark, parts):
    texts, want = planted(random.Random(4))
    docs = spark.createDataFrame([(k, v, "en", "a", len(v)) for k, v in texts.items()], "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(parts)
    found = {}
    for r in chaining.repeated_passages(docs).collect():
        found.setdefault(r.doc_id, set()).update(range(r.start_word, r.start_word + r.n_words))
        assert all(p < r.doc_id for p in r.partner_ids)
    assert set(found) == set(want)
    for k, w in want.items():
        assert len(w - found[k]) <= 3 and len(found[k] - w) <= 3, k
    left = {r.doc_id: r.text for r in chaining.remove_repeats(docs).collect()}
    assert all(left[k] == texts[k] for k in (1, 2, 4, 7, 8)) and len(left[3].split()) <= 8


@pytest.mark.parametrize("parts", [1, 5])
def test_each_copy_in_a_document_is_found(spark, parts):
    r = random.Random(8)
    shared, fill = prose(r, 60), [" ".join(f"u{r.random()}" for _ in range(40)) for _ in range(3)]
    texts = {1: f"{fill[0]} {shared}", 2: f"{shared} {fill[1]} {shared} {fill[2]} {shared}"}
    docs = spark.createDataFrame([*texts.items()], "doc_id bigint, text string").repartition(parts, "doc_id")
    assert docs.where("doc_id = 1").select(F.spark_partition_id()).first() != docs.where("doc_id = 2").select(F.spark_partition_id()).first() or parts == 1
    found = set()
    for p in chaining.repeated_passages(docs).collect():
        assert (p.doc_id, p.partner_ids) == (2, [1])
        found.update(range(p.start_word, p.start_word + p.n_words))
    assert len(found ^ {*range(60), *range(100, 160), *range(200, 260)}) <= 6


def covered(df):
    found = {}
    for r in df.collect():
        found.setdefault(r.doc_id, set()).update(range(r.start_word, r.start_word + r.n_words))
    return found


def fill(r, n):
    return [f"u{r.random()}" for _ in range(n)]


@pytest.mark.parametrize("parts", [1, 4])
def test_pieces_in_earlier_documents_hide_nothing(spark, parts):
    """Documents 1 to 9 and 101 to 109 have pieces of what 100 and 200 have whole."""
    r = random.Random(2)
    whole = prose(r, 72).split()
    texts = {100: fill(r, 20) + whole + fill(r, 20), 200: fill(r, 33) + whole + fill(r, 20)}
    for k in range(9):
        for d in (1 + k, 101 + k):
            texts[d] = fill(r, 30) + whole[8 * k : 8 * k + 12] + fill(r, 30)
    docs = spark.createDataFrame([(k, " ".join(v)) for k, v in texts.items()], "doc_id bigint, text string").repartition(parts)
    assert covered(chaining.repeated_passages(docs)) == {200: set(range(33, 105))}


@pytest.mark.parametrize("copies", [8, 40])
def test_crowds_of_pieces_hide_no_changed_passage(spark, copies):
    """Document 90000 has what 1000 has with each twelfth word changed; many documents between have pieces too short to be parts, as 90000 has them."""
    r = random.Random(2)
    whole = prose(r, 72).split()
    texts = {1000: fill(r, 20) + [w if k % 12 else f"old{k}" for k, w in enumerate(whole)] + fill(r, 20), 90000: fill(r, 33) + whole + fill(r, 20)}
    for k in range(15 * copies):
        texts[2000 + k] = fill(r, 30) + whole[4 * (k // copies) :][:12] + fill(r, 30)
    docs = spark.createDataFrame([(k, " ".join(v)) for k, v in texts.items()], "doc_id bigint, text string").repartition(4)
    assert covered(chaining.repeated_passages(docs)) == {90000: set(range(34, 105))}
    left = chaining.remove_repeats(docs.withColumn("n_chars", F.length("text").cast("bigint"))).where("doc_id = 90000").first().text
    assert left.split() == texts[90000][:34] + texts[90000][105:]


@settings(max_examples=30, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 2**31 - 1), st.integers(-(2**31), 2**31 - 1)), min_size=1, max_size=9))
def test_packed_places(pairs):
    pos, pos2 = (np.array(x, np.int64) for x in zip(*pairs, strict=True))
    got = chaining._places(chaining._match_rows(pos, pos, pos, pos2).column(2))
    assert [x.tolist() for x in got] == [pos.tolist(), pos2.tolist()]
    b, a = np.sort(pos >> 2), pos2 >> 2
    got = chaining.unpacked_places(pa.scalar(chaining.packed_places(b, a), pa.binary()))
    assert [x.tolist() for x in got] == [b.tolist(), a.tolist()]


@pytest.mark.parametrize("copies", [1, 3])
def test_matches_leave_out_no_pair_of_texts(copies):
    """Up to CROWD occurrences: every two of different documents but copies, of which the first stands for all."""
    n = chaining.CROWD // copies
    rank, context = np.repeat(np.arange(n), copies), np.repeat(np.arange(n, dtype=np.uint64) << np.uint64(20), copies)
    rank[copies:] += np.tile(np.arange(copies), n - 1) * n
    seed, pos = np.full(len(rank), 7, np.uint64), np.arange(len(rank))
    (later, earlier, *_),  = chaining.matches(seed, rank, pos, context)
    first = [min(rank[context == c]) for c in context]
    want = {(i, j) for i in range(len(rank)) for j in range(len(rank)) if rank[j] < rank[i] and rank[j] == first[j]}
    assert set(zip(later.tolist(), earlier.tolist(), strict=True)) == want and len(later) == len(want)


@pytest.mark.parametrize("block", [7, 2048])
def test_all_of_a_crowd_by_blocks(spark, block):
    """With exact, crowded seeds are matched like others: every two occurrences of different documents, of equal contexts the first document's."""
    r = np.random.default_rng(8)
    rows = [(None, None, k, int(i), 16 * (i % 3) << 16, int(r.integers(0, 12)), i) for k, n in ((5, 3 * chaining.CROWD), (-6, 90), (7, chaining.CROWD)) for i in range(n)]
    sown = [(100 + d, d, None, None, p, k, c | i << 2 * chaining.HALF) for _, _, k, i, p, c, _ in rows for d in [int(r.integers(0, 40))]]
    sown += [(1, 1, None, 60, 0, 5, 0), (1, None, 2, 7, 9, 5, 0)]  # a unit's and a match, which only pass by
    blocks = chaining.crowd_blocks(spark.createDataFrame(sown, chaining.SEED_ROWS), 3, block).repartition(3, "key", "low", "high").sortWithinPartitions("key", "low", "high")
    got = []
    for m in chaining.map_stream(blocks, chaining._crossed, chaining.MATCH_ROWS).toArrow().to_batches():
        pos, pos2 = chaining._places(m.column(2))
        got += zip(m.column(0).to_pylist(), pos.tolist(), m.column(1).to_pylist(), pos2.tolist(), strict=True)
    seen = [(k, d, p + (c >> 48), c & (1 << 48) - 1) for _, d, row2, size, p, k, c in sown if row2 is None and size is None and k != 7]
    first = {}
    for k, d, _, c in seen:
        first[k, c] = min(d, first.get((k, c), d))
    want = [(100 + d, p, 100 + d2, p2) for k, d, p, _ in seen for k2, d2, p2, c2 in seen if k == k2 and d2 < d and d2 == first[k, c2]]
    assert sorted(got) == sorted(want) and len(want) > 1000


def test_a_crowd_loses_no_link_if_exact(spark):
    """Passages changed at random, too far from what other documents of the crowd have for a match that stands for another: what a join of all pairs finds is found."""
    r = random.Random(12)
    shared = [prose(r, 72).split() for _ in range(3)]
    rows = []
    for k in range(3 * 80):
        text = [w if r.random() > 0.1 else fill(r, 1)[0] for w in shared[k % 3]]
        rows.append((k, " ".join(fill(r, 20) + text + fill(r, 20))))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    found, known = covered(chaining.repeated_passages(docs, exact=True)), covered(chaining.repeated_passages(docs))
    hashes, plain = [chaining.word_hashes(t) for _, t in rows], {}
    (seed, doc, pos, _), _ = chaining.seeds(hashes)
    pairs = {}
    for s in np.unique(seed):
        at = np.flatnonzero(seed == s)
        for i in at:
            for j in at[doc[at] < doc[i]]:
                pairs.setdefault((int(doc[i]), int(doc[j])), []).append((int(pos[i]), int(pos[j])))
    for (b, a), anchors in pairs.items():
        x, y = (np.array(v) for v in zip(*anchors, strict=True))
        for c in chaining.chains(np.zeros(len(x), int), x, y):
            plain.setdefault(b, []).extend(chaining.align(hashes[b], hashes[a], x[c], y[c]))
    want = {}
    for b, parts in plain.items():
        now = None
        for s, e in [*sorted(parts), (1 << 30, 1 << 30)]:
            if now and s <= now[1]:
                now[1] = max(e, now[1])
                continue
            if now and now[1] - now[0] >= chaining.MIN_WORDS:
                want.setdefault(b, set()).update(range(*now))
            now = [s, e]
    size = lambda x: sum(map(len, x.values()))
    lost = sum(len(w - found.get(k, set())) for k, w in want.items())
    print("words", size(want), "lost if exact", lost, "lost", sum(len(w - known.get(k, set())) for k, w in want.items()))
    assert not lost and size(want) > 2000


@pytest.mark.parametrize(("few", "most"), [(128, 4096), (2, 4096), (2, 3)])
def test_close_classes_of_a_crowd(monkeypatch, few, most):
    """Each occurrence and the first one of every class with at most DIFFER words that differ, but for those that a better one outdoes; the
    same whichever way classes are compared."""
    monkeypatch.setattr(chaining, "FEW_CLASSES", few)
    monkeypatch.setattr(chaining, "ALL_CLASSES", most)
    r = np.random.default_rng(5)
    words = r.integers(0, 4, (3, 16))[r.integers(0, 3, 240)]
    words = np.where(r.random(words.shape) < 0.12, r.integers(0, 4, words.shape), words)
    near = (words << 2 * np.arange(16)).sum(axis=1).astype(np.uint32)
    seed, rank = r.integers(0, 2, 240).astype(np.uint64), r.permutation(240) // 2
    later, earlier = chaining.close_pairs(seed, rank, near)
    first = {}
    for i in np.argsort(rank, kind="stable").tolist():
        first.setdefault((seed[i], near[i]), i)
    unlike = lambda i, j: frozenset(np.flatnonzero(words[i] != words[j]).tolist())
    want = set()
    for i in range(240):
        near_by = [(rank[j], unlike(i, j)) for (s, _), j in first.items() if s == seed[i] and rank[j] < rank[i] and len(unlike(i, j)) <= chaining.DIFFER]
        want |= {(i, d) for k, d in near_by if d and not any(e < d and m < k for m, e in near_by)}
    got = {(i, unlike(i, j)) for i, j in zip(later.tolist(), earlier.tolist(), strict=True)}
    assert got == want and len(got) > 200
    least = {x: min(rank[j] for (s, _), j in first.items() if s == seed[x[0]] and rank[j] < rank[x[0]] and unlike(x[0], j) == x[1]) for x in got}
    assert all(rank[j] == least[i, unlike(i, j)] for i, j in zip(later.tolist(), earlier.tolist(), strict=True))


def test_repeated_ids_are_documents_of_their_own(spark):
    r = random.Random(3)
    a, b = prose(r, 120), " ".join(fill(r, 150))
    rows = [(1, a, "x"), (2, f"{a} {' '.join(fill(r, 9))}", "x"), (2, b, "y"), (2, b, "y"), (None, f"{' '.join(fill(r, 4))} {b}", "z"), (None, a, "z")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, spans string").withColumn("n_chars", F.length("text").cast("bigint")).repartition(3)
    got = sorted((str(p.doc_id), p.start_word, p.n_words, p.partner_ids) for p in chaining.repeated_passages(docs).collect())
    assert [g for g in got if g[0] == "2"] == [("2", 0, 120, [1])]
    assert sorted(g[1:3] for g in got if g[0] == "None") == [(0, 120), (4, 150)]
    left = chaining.remove_repeats(docs)
    assert left.columns == docs.columns
    assert sorted((r.doc_id or 0, len(r.text.split()), r.spans) for r in left.collect()) == [(0, 4, "z"), (1, 120, "x"), (2, 9, "x"), (2, 150, "y"), (2, 150, "y")]


@pytest.mark.parametrize("parts", [1, 6])
def test_crowded_seeds(spark, parts):
    """One passage in all documents, each copy found whole, with links in proportion."""
    r = random.Random(6)
    shared = prose(r, 55).split()
    docs = spark.createDataFrame([(k, " ".join(fill(r, 20) + shared + fill(r, 20))) for k in range(300)], "doc_id bigint, text string").repartition(parts)
    rows = chaining.repeated_passages(docs).collect()
    # Words are compared by 16 bits, so that among many a neighbour may pass for equal.
    assert {p.doc_id for p in rows} == set(range(1, 300)) and all(19 <= p.start_word <= 20 and 75 <= p.start_word + p.n_words <= 76 for p in rows)
    assert sum((p.start_word, p.n_words) != (20, 55) for p in rows) <= 3
    assert all(p.partner_ids and len(p.partner_ids) <= 24 for p in rows)


def test_recall_of_fuzzy_passages(spark):
    """Passages of 80 to 250 words with one word in ten replaced, left out or put in, in texts of common words."""
    r = random.Random(9)
    words = [f"w{i}" for i in range(2000)]
    rows, place = [], {}
    for k in range(150):
        passage = [r.choice(words) for _ in range(r.randint(80, 250))]
        changed = []
        for w in passage:
            x = r.random()
            changed += [w] if x > 0.1 else [r.choice(words)] if x > 0.05 else [] if x > 0.025 else [w, r.choice(words)]
        rows += [(k, [r.choice(words) for _ in range(60)] + passage), (1000 + k, [r.choice(words) for _ in range(40)] + changed + [r.choice(words) for _ in range(40)])]
        place[1000 + k] = set(range(40, 40 + len(changed)))
    found = covered(chaining.repeated_passages(spark.createDataFrame([(k, " ".join(v)) for k, v in rows], "doc_id bigint, text string")))
    assert set(found) <= set(place)
    hit = sum(len(w & found.get(k, set())) for k, w in place.items())
    assert hit >= 0.9 * sum(map(len, place.values())) and sum(len(found[k] - place[k]) for k in found) <= 0.01 * hit
    assert sum(len(w & found.get(k, set())) > len(w) / 2 for k, w in place.items()) >= 0.95 * len(place)


def test_exact_repeats_of_all_documents(spark, sf):
    docs = {r.doc_id: space_words(r.text) for r in queries.documents(spark, sf).collect()}
    first, need = {}, {}
    found = covered(queries.op6_substring_dedup(spark, sf))
    for k in sorted(docs):
        for i in range(len(docs[k]) - 49):
            if first.setdefault(tuple(docs[k][i : i + 50]), k) != k:
                need.setdefault(k, set()).update(range(i, i + 50))
    assert not [k for k, w in need.items() if w - found.get(k, set())]


def test_cut_passages():
    assert chaining.cut_passages("a b\nc  d e", [(1, 2)]) == "a d e"
    assert chaining.cut_passages("a b", [(0, 2)]) == "" and chaining.cut_passages(None, [(0, 1)]) is None


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 40), st.integers(0, 2**32 - 1)), max_size=2500))
def test_blocks_round_trip(ids):
    x = np.array(ids, np.uint32)
    blocks = pfor_ids.encode_blocks(x)
    starts = (np.cumsum([0, *map(len, blocks)])[:-1]).tolist()
    assert np.array_equal(pfor_ids.decode_blocks(b"".join(blocks), starts), x)


def test_file_round_trip(tmp_path):
    import pyarrow as pa

    r = np.random.default_rng(1)
    docs = [(None if i == 0 else i, r.integers(0, 50_000, n).astype("<u4")) for i, n in enumerate([0, 1, 5, 300_000, 0, 1023, 1024, 7])]
    with open(tmp_path / "f", "wb") as f:
        w = pfor_ids.Writer(f)
        for name, ids in docs:
            w.add(name, ids.tobytes())
        assert w.close() == sum(len(x) for _, x in docs)
    with pa.OSFile(str(tmp_path / "f")) as f:
        back = list(pfor_ids.read_documents(f))
    assert [n for n, _ in back] == [n for n, _ in docs] and all(np.array_equal(a, b) for (_, a), (_, b) in zip(back, docs, strict=True))
    with pa.BufferReader(b"x" * 100) as f, pytest.raises(ValueError):
        list(pfor_ids.read_documents(f))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from([" ", "  ", "\n", "a", "the", "é", "日", "᠎", "​", "\xa0", "<|endoftext|>", "9", ".", ",", "'s", "\x1c", "\x85", "B", "word", "$$", "ß", "×"]), max_size=20).map("".join))
def test_segments_encode_like_the_whole_text(text):
    e = pfor_ids.encoder(fst_tokens.tokenizer_path("byte_bpe_50k.json"))
    assert np.frombuffer(e.encode([text])[0], "<u4").tolist() == e.tokenizer.encode(text, add_special_tokens=False).ids


def test_id_files_of_all_documents(spark, sf):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(fst_tokens.tokenizer_path("byte_bpe_50k.json"))
    docs = {r.doc_id: r.text or "" for r in queries.documents(spark, sf).collect()}
    got, start = {r.doc_id: r for r in queries.op7_token_id_files(spark, sf).collect()}, 0
    for k in sorted(docs):
        ids = [*tokenizer.encode(docs[k], add_special_tokens=False).ids, 2]
        assert (got[k].start, got[k].n_tokens, got[k].ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def components_model(fps):
    """Smallest index reachable by links, for each."""
    root = list(range(len(fps)))
    for i in range(len(fps)):
        todo = [i] if root[i] == i else []
        while todo:
            j = todo.pop()
            for k in np.flatnonzero(np.bitwise_count(fps ^ fps[j]) <= 4):
                if root[k] > i:
                    root[k] = i
                    todo.append(int(k))
    return root


def test_links_meet_at_an_anchor():
    r = np.random.default_rng(3)
    x = r.integers(0, 2**64, 400, dtype=np.uint64)
    flips = np.array([sum(1 << int(b) for b in r.choice(64, r.integers(0, 5), replace=False)) for _ in x], np.uint64)
    fps = np.unique(np.concatenate([x, x ^ flips]))
    a, b = simhash_anchor.links_at_anchors(*simhash_anchor.deal(fps))
    assert (np.bitwise_count(a ^ b) <= 4).all()
    u, v = simhash_anchor.forest(a, b)
    label = dict(zip(u.tolist(), v.tolist(), strict=True))
    assert [label.get(int(f), int(f)) for f in fps] == [int(fps[i]) for i in components_model(fps)]
    assert [len(simhash_anchor.deal(fps[:1])[0])] <= [189]


@pytest.mark.parametrize("spread", [64, 6])
def test_hot_anchors_are_split(spread):
    r = np.random.default_rng(9)
    centre = r.integers(0, 2**64, 1, dtype=np.uint64)
    fps = np.unique(np.concatenate([centre ^ np.uint64(sum(1 << int(b) for b in r.choice(spread, 6, replace=False))) for _ in range(150)]))
    keys, who = simhash_anchor.deal(fps)
    hot = np.unique(simhash_anchor.home_keys(fps))
    split, whose = simhash_anchor.split_hot(keys, who, hot)
    u, v = simhash_anchor.forest(*simhash_anchor.links_at_anchors(split, whose))
    label = dict(zip(u.tolist(), v.tolist(), strict=True))
    assert [label.get(int(f), int(f)) for f in fps] == [int(fps[i]) for i in components_model(fps)]
    assert len(split) == len(keys) + 4 * np.isin(keys, hot).sum()


def test_dense_clusters(monkeypatch):
    monkeypatch.setattr(simhash_anchor, "SMALL_ANCHOR", 3)
    r = np.random.default_rng(5)
    centre = r.integers(0, 2**64, 1, dtype=np.uint64)
    fps = np.unique(np.concatenate([centre ^ np.uint64(sum(1 << int(b) for b in r.choice(64, 3, replace=False))) for _ in range(300)]))
    u, _ = simhash_anchor.forest(*simhash_anchor.links_at_anchors(*simhash_anchor.deal(fps)))
    assert len(u) == sum(i != k for i, k in enumerate(components_model(fps)))


def test_homes_cover():
    x = np.random.default_rng(0).integers(0, 2**32, 5000, dtype=np.uint64).astype(np.uint32)
    h = simhash_anchor.homes(x)
    assert (simhash_anchor.syndrome(h) == 0).all() and (np.bitwise_count(x ^ h) <= 1).all()


def test_near_duplicates_of_all_documents(spark, sf):
    import re

    import xxhash

    def fingerprint(text):
        w = re.findall(r"[^\x20\x09-\x0D]+", text.translate({i: i + 32 for i in range(65, 91)}))
        h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]).encode(), seed=42) for i in range(max(1, len(w) - 3))] if w else []
        return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))

    docs = sorted((r.doc_id, fingerprint(r.text or "")) for r in queries.documents(spark, sf).collect())
    root = components_model(np.array([f for _, f in docs], np.uint64))
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in queries.op10_simhash_near_dedup(spark, sf).collect()}
    assert got == {d: (format(f, "016x"), docs[root[i]][0]) for i, (d, f) in enumerate(docs)}


def test_pipeline(spark, sf, tmp_path):
    docs, sizes = queries.documents(spark, sf), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf)
        out.write.parquet(f"file://{tmp_path}/{k}")
        after = spark.read.parquet(f"file://{tmp_path}/{k}")
        before, now = {r.doc_id: r for r in docs.collect()}, after.collect()
        if k == 0:
            good = {r.doc_id for r in quality_rules.score_quality(docs).where("kept").collect()}
            assert {r.doc_id for r in now} == good and all(before[r.doc_id] == r for r in now)
        elif k == 1:
            assert {r.doc_id for r in now} == {r.component_id for r in simhash_anchor.near_duplicates(docs).collect()}
        elif k == 2:
            spans = {r.doc_id for r in chaining.repeated_passages(docs).collect()}
            assert all((r.text == before[r.doc_id].text) == (r.doc_id not in spans) for r in now)
        elif k == 3:
            from rowfeed.llm import fm_index

            hits = {r.doc_id: r for r in fm_index.leak_digest(docs, queries.documents(spark, sf, "benchmark")).collect()}
            assert {r.doc_id for r in now} == {d for d, r in hits.items() if not r.contaminated}
            assert all((r.text == before[r.doc_id].text) == (hits[r.doc_id].n_hit == 0) for r in now)
        else:
            assert {r.doc_id for r in now} == set(before)
        docs = after
        sizes.append(len(now))
    assert sorted(map(str, corpus_pipeline.run(spark, sf).collect())) == sorted(map(str, docs.collect()))
    assert sizes[0] > sizes[1] >= sizes[2] >= sizes[3] > 0
