"""Token counts, decontamination, quality, licences, toxicity, pages: against libraries, plain versions and held-out rows."""

import hashlib
import random
import re
from pathlib import Path

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from rowfeed.llm import fm_index, fst_tokens, html_crf, license_digest, queries, toxicity_cnn
from rowfeed.llm.license_texts import LICENSES

TEXT = st.lists(st.sampled_from([" ", "  ", "\n", "a", "b", "the", "ing", "é", "日本", "😀", "\t", "<s>", "▁", "0", ",", ".", "²", "ß", "\x00"]), max_size=40).map("".join)


@pytest.fixture(scope="module")
def counter():
    return fst_tokens.counter(fst_tokens.tokenizer_path("piece_bpe_32k.model"))


@settings(max_examples=300, deadline=None)
@given(text=TEXT, chunk=st.integers(1, 9))
def test_counts_are_those_of_the_library(counter, text, chunk):
    want = len(library().encode(text))
    assert counter.count(text) == want and counter.count(text, chunk) == want


def library():
    import sentencepiece

    if not hasattr(library, "held"):
        library.held = sentencepiece.SentencePieceProcessor(model_file=fst_tokens.tokenizer_path("piece_bpe_32k.model"))
    return library.held


def test_counts_of_all_documents(spark, sf):
    docs = {r.doc_id: r.text or "" for r in queries.documents(spark, sf).collect()}
    for r in queries.op1_token_counts(spark, sf).collect():
        n = len(library().encode(docs[r.doc_id]))
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(docs[r.doc_id].encode()), n, n > 4096)


def test_states_are_forgotten_and_found_again(monkeypatch):
    monkeypatch.setattr(fst_tokens, "MAX_STATES", 5)
    c = fst_tokens.TokenCounter([("a", -1), ("b", -2), ("ab", -3), ("aba", -4), ("▁", -5), ("▁a", -6)])
    assert c.count("abab ab") == c.count("abab ab") == 1 + 2 + 2  # ▁a+b? checked by merging below
    assert c.count("aba") == len(c.merge(" aba"))


def test_scan_composes_all_prefixes():
    assert fst_tokens.prefix_scan(list("abcdefg"), str.__add__) == ["a", "ab", "abc", "abcd", "abcde", "abcdef", "abcdefg"]
    assert fst_tokens.prefix_scan([], str.__add__) == []


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 5), min_size=1, max_size=60), st.lists(st.lists(st.integers(1, 6), min_size=1, max_size=4), min_size=1, max_size=6))
def test_index_finds_every_occurrence(symbols, phrases):
    index = fm_index.FmIndex(np.array(symbols), 6)
    rows = np.zeros((len(phrases), 4), np.int64)
    for i, p in enumerate(phrases):
        rows[i, 4 - len(p) :] = p
    low, high = index.search(rows, np.array([len(p) for p in phrases]))
    for p, a, b in zip(phrases, low, high, strict=True):
        want = [i for i in range(len(symbols) - len(p) + 1) if symbols[i : i + len(p)] == p]
        assert sorted(index.locate(np.arange(a, max(a, b))).tolist()) == want


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate({i: i + 32 for i in range(65, 91)}))


def leak_model(text, items):
    w, hit, found = words(text), set(), set()
    for name, item in items:
        v = words(item)
        for i in range(max(1, len(v) - 12) if v else 0):
            p = v[i : i + 13]
            at = [j for j in range(len(w) - len(p) + 1) if w[j : j + len(p)] == p]
            hit |= {j + k for j in at for k in range(len(p))}
            found |= {name} if at else set()
    return len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(w)


@pytest.mark.parametrize("block", [1, 10**6])
def test_leaks_match_a_plain_search(spark, block):
    r = random.Random(2)
    word = lambda: r.choice("ab AB c. d, é".split())
    items = [(str(i), " ".join(word() for _ in range(r.choice([2, 5, 13, 15, 20])))) for i in range(12)] + [("", "")]
    texts = [" ".join(word() for _ in range(r.randint(0, 80))) + " " + r.choice(items)[1] for _ in range(80)] + [None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    bench = spark.createDataFrame(items, "item_id string, text string")
    found = fm_index.find_leaks(docs, bench, block_words=block)
    got = {x.doc_id: x for x in found.collect()}
    for i, t in enumerate(texts):
        n, hit, k, _, _ = leak_model(t, items)
        assert (got[i].n_words, sum(s.end - s.start for s in got[i].spans), len(got[i]["items"])) == (n, hit, k), t


def test_leak_query_matches_a_plain_search(spark, sf):
    docs = {r.doc_id: r.text for r in queries.documents(spark, sf).collect()}
    items = [(str(r.item_id), r.text) for r in queries.documents(spark, sf, "benchmark").collect()]
    for r in queries.op2_decontamination(spark, sf).limit(60).collect():
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == leak_model(docs[r.doc_id], items)


def test_blocks_save_no_texts(spark, monkeypatch):
    """What the passes of a benchmark of many blocks write is keys, spans and items of texts with hits; columns whose names clash pass through."""
    saved = []
    save = fm_index.Workspace.save
    monkeypatch.setattr(fm_index.Workspace, "save", lambda self, df, name: saved.append((df.columns, name)) or save(self, df, name))
    docs = spark.createDataFrame([(k, " ".join(f"w{k % 5 + i}" for i in range(40)), 7, "x") for k in range(50)], "doc_id bigint, text string, spans int, text_key string")
    items = spark.createDataFrame([(f"i{k}", " ".join(f"w{k + i}" for i in range(15))) for k in range(0, 60, 3)], "item_id string, text string")
    found = fm_index.find_leaks(docs, items, block_words=15)
    assert found.columns == ["doc_id", "text", "spans", "text_key", "n_words", "spans_", "items"]
    assert len(saved) == 20 and all(c == ["text_key_", "text_key_2", "spans", "items"] for c, _ in saved)
    assert all(r.spans == 7 and r.text_key == "x" and r.n_words == 40 and r["spans_"] for r in found.collect())


def test_cut_words():
    assert fm_index.cut_words("One, two three. Four", [(1, 3)]) == "One, . Four"
    assert words(fm_index.cut_words("One, two three. Four é five", [(1, 3), (4, 5)])) == ["one", "four", "five"]
    assert fm_index.cut_words(None, []) is None


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    df = queries.queries()[name](spark, sf)
    out = con.execute(queries.oracle_sql()[name])
    names = [c[0] for c in out.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted(map(str, (tuple(r[n] for n in sorted(names)) for r in df.collect()))) == sorted(map(str, (tuple(r[names.index(n)] for n in sorted(names)) for r in out.fetchall())))


def test_licences(spark):
    mit = LICENSES["MIT"]
    texts = [
        ("MIT", "Copyright (c) 2019 A. Person\n\n" + mit.upper()), ("MIT", " ".join(mit.split())), ("MIT", "/* " + mit.replace("\n", "\n * ") + " */"), ("MIT", mit.replace('"', "“") + "\nAll rights reserved."), (None, mit + " more"), (None, ""), (None, None), (None, "..."),
        ("BSD-3-Clause", "Copyright 2001, Them\nAll rights reserved.\n\n" + LICENSES["BSD-3-Clause"]), ("ISC", LICENSES["ISC"]), ("0BSD", LICENSES["0BSD"]),
    ]
    docs = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(texts)], "doc_id int, text string")
    got = {r.doc_id: r for r in license_digest.scan_licenses(docs).collect()}
    assert [got[i].license_id for i in range(len(texts))] == [n for n, _ in texts]
    assert all(got[i].digest == hashlib.sha256(license_digest.canonical_text(t).encode()).hexdigest() for i, (_, t) in enumerate(texts))
    known = spark.createDataFrame([(got[4].digest, "z"), (got[4].digest, "a"), (hashlib.sha256(b"").hexdigest(), "empty")], "digest string, license_id string")
    assert [r.license_id for r in license_digest.scan_licenses(docs, known).where("is_license").collect()] == ["a"]
    assert "Python" not in license_digest.scan_licenses(docs)._jdf.queryExecution().toString()


def test_copyright_lines_with_a_plain_name(spark):
    mit = LICENSES["MIT"]
    lines = ["Copyright Joyent, Inc. and other Node contributors.", " * COPYRIGHT The X Authors", "Copyright Ändern e.V.", "Copyright notice of mine", "copyright holders", "Copyright law applies"]
    docs = spark.createDataFrame([(i, f"{x}\n\n{mit}") for i, x in enumerate(lines)], "doc_id int, text string")
    got = {r.doc_id: r for r in license_digest.scan_licenses(docs).collect()}
    assert [got[i].license_id for i in range(len(lines))] == ["MIT"] * 3 + [None] * 3
    assert all(got[i].digest == hashlib.sha256(license_digest.canonical_text(f"{x}\n\n{mit}").encode()).hexdigest() for i, x in enumerate(lines))


def test_full_texts(spark):
    folder = Path("/usr/share/common-licenses")
    names = {"Apache-2.0": "Apache-2.0", "Artistic": "Artistic-1.0-Perl", "BSD": "BSD-3-Clause", "CC0-1.0": "CC0-1.0", "GFDL-1.3": "GFDL-1.3", "GPL-1": "GPL-1.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2.1": "LGPL-2.1", "LGPL-3": "LGPL-3.0", "MPL-1.1": "MPL-1.1", "MPL-2.0": "MPL-2.0"}
    texts = [(want, (folder / f).read_text()) for f, want in names.items() if (folder / f).exists()]
    if not texts:
        pytest.skip("no licence texts on this machine")
    # A text in one line that starts with its copyright is a copyright line.
    texts += [(want, " ".join(t.split())) for want, t in texts if not t.startswith("Copyright")] + [(want, t[: t.index("END OF TERMS")]) for want, t in texts if "END OF TERMS" in t] + [(None, t[:-200]) for _, t in texts]
    docs = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(texts)], "doc_id int, text string")
    got = {r.doc_id: r.license_id for r in license_digest.scan_licenses(docs).collect()}
    assert [got[i] for i in range(len(texts))] == [want for want, _ in texts]


def test_toxicity_on_held_out_rows(spark):
    d = "/root/testdata/sf0.01"
    out = queries.op4_toxicity(spark, d).join(queries.documents(spark, d, "labels"), "doc_id")
    rows = out.where("held_out").collect()
    assert sum(r.predicted == r.toxic for r in rows) / len(rows) > 0.9
    import zlib

    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == (r.score >= 0.5) for r in out.collect())


def test_scores_are_those_of_a_plain_net():
    """Against filters moved along the words one by one, without a lexicon, pieces or pads between texts."""
    r = random.Random(3)
    words = ["good", "plain", "word", "text", "awfully", "awful", "badness", "bad!", "the", "der", "unseen"]
    texts = [" ".join(r.choice(words[:4]) for _ in range(r.randint(1, 30))) + (" awful bad" if i % 2 else "") for i in range(80)]
    net = toxicity_cnn.train(texts, np.array([i % 2 for i in range(80)]), np.array([i % 4 > 1 for i in range(80)]))

    def plain(text):
        e = [net.rows[[net.row[s] for s in toxicity_cnn.features(w)]].sum(0) for w in (text or "").lower().split()]
        zero = np.zeros(toxicity_cnn.DIM)
        tops = []
        for k, w in net.filters.items():
            at = [sum(((e[i + j] if i + j < len(e) else zero) @ w[j]) for j in range(k)) for i in range(max(1, len(e)))]
            tops.append(np.max(at, axis=0))
        z = np.maximum(np.concatenate(tops) + net.bias, 0) @ net.out + net.out_bias
        common = [sum(w.strip(toxicity_cnn.MARKS) in c for w in (text or "").lower().split()) for c in toxicity_cnn.COMMON.values()]
        lang = int(np.argmax(common)) if max(common) else len(common)
        return 1 / (1 + np.exp(-(z - net.shift[lang])))

    some = [*texts[:10], "the the unseen awful", "der", "", None, " ".join(r.choice(words) for _ in range(50))]
    got, _ = toxicity_cnn.Scorer(net).scores(some)
    assert np.abs(got - np.array([plain(t) for t in some])).max() < 1e-4


def test_long_texts_score_like_their_words():
    r = random.Random(1)
    texts = [" ".join(r.choice(["good", "plain", "word", "text"]) for _ in range(40)) + (" awful" if i % 2 else "") for i in range(80)]
    net = toxicity_cnn.train(texts, np.array([i % 2 for i in range(80)]), np.array([i % 4 > 1 for i in range(80)]))
    scorer = toxicity_cnn.Scorer(net)
    far = " ".join(["good"] * 300_000)
    s, _ = scorer.scores([texts[0], texts[1], far, far + " awful " + far, None])
    assert (s >= 0.5).tolist() == [False, True, False, True, False]
    again, _ = scorer.scores([far + " awful " + far])
    assert abs(again[0] - s[3]) < 1e-6


def license_rows():
    """Known texts with lines of several forms before them, and full texts where the system has them."""
    from pathlib import Path

    lines = ["", "Copyright (c) 2020 A. Person", "Copyright The Example Authors", "  # Copyright  Example GmbH & Co", "copyright notice of nobody", "Copyright holders say", "(c) 1999 X\nAll rights reserved.\nCopyright Y Z"]
    texts = [f"{line}\n\n{t}" for line in lines for t in list(LICENSES.values())[:6]] + [None, "", "Some text.", "copyright\tMe and copyright you\n"]
    folder = Path("/usr/share/common-licenses")
    texts += [p.read_text(errors="replace") for p in sorted(folder.iterdir())] if folder.is_dir() else []
    return list(enumerate(texts))


def test_license_sql_knows_what_the_scan_knows(spark, monkeypatch):
    docs = spark.createDataFrame(license_rows(), "doc_id bigint, text string")
    con = duckdb.connect()
    con.register("documents", docs.toArrow())
    want = sorted(con.sql(license_digest.scan_sql()).fetchall())
    assert sorted(map(tuple, license_digest.scan_licenses(docs).collect())) == want and sum(r[3] for r in want) > 30
    monkeypatch.setattr(license_digest, "BROADCAST_ROWS", 3)
    shuffled = license_digest.scan_licenses(docs)
    assert sorted(map(tuple, shuffled.collect())) == want


def test_blocks():
    page = "<ul><li>a<li>b &amp;lt; c</ul><p>x <b>y</b>\n z<p>q<script>var a='</p>'</script>&nbsp;r<br>s<div hidden>no</div><!-- <p>no</p> --><select><option>no</select><td>t"
    assert [b[0] for b in html_crf.blocks(page)] == ["a", "b &lt; c", "x y z", "q r s", "t"]
    assert html_crf.blocks("a < b <p>c") and html_crf.blocks("<p title='>'>c</p>")[0][0] == "c"


def test_head_without_end_tag():
    for start in ("<body>", "", "<!-- c --><div>", "<body><head>", "<head><body>"):
        page = f"<html><head><meta charset=u><title>t</title><style>p {{}}</style>{start}<article><p>one<p>two</article></html>"
        assert [b[0] for b in html_crf.blocks(page)] == ["one", "two"], start
    assert [b[0] for b in html_crf.blocks("<head>\n<title>t</title> text <p>one")] == ["text", "one"]
    assert [b[0] for b in html_crf.blocks("<head><noscript><link></noscript><template><p>no</template><script>no</script></head><p>one")] == ["one"]


def test_only_hidden_parts_are_hidden():
    for attributes in ('class="intro hidden md:block"', 'title="The hidden cost of"', "aria-label='a hidden valley'", "class=hidden", 'data-x="display:none"', 'title="aria-hidden=true"', 'aria-hidden="false"', "data-hidden", 'style="--display:none; display: none; display:block"'):
        assert [b[0] for b in html_crf.blocks(f"<article {attributes}>a</article>b")] == ["a", "b"], attributes
    for attributes in ("hidden", 'class="a"hidden', 'HIDDEN=""', "hidden=hidden class=b", 'aria-hidden="true"', "aria-hidden=true", 'style="color:red;display : none"', "style='display:none !important;display:block'"):
        assert [b[0] for b in html_crf.blocks(f"<p {attributes}>a</p><p>b")] == ["b"], attributes


def test_formulas_and_fallbacks_stay():
    page = "<p>let <math><semantics><mrow><mi>x</mi><mo>=</mo><mn>2</mn></mrow><annotation>x=2</annotation></semantics></math> be <svg><title>no</title><text>drawn</text><path/></svg> now<p>a <object data=u><b>b</b></object> <noscript>c</noscript> <video>no</video>d<canvas>no</canvas>"
    assert [b[0] for b in html_crf.blocks(page)] == ["let x=2 be drawn now", "a b c d"]
    assert [b[0] for b in html_crf.blocks("<p>a <object><p>b</object>c")] == ["a", "b", "c"]


def test_field_on_pages_it_has_not_seen():
    field = html_crf.model()
    right = total = 0
    for page, labels in html_crf.labelled_pages(150, seed=99):
        found = html_crf.blocks(page)
        got = field.decode([html_crf.features(*b) for b in found]) if found else []
        right += sum(a == b for a, b in zip(got, labels, strict=True))
        total += len(labels)
    assert right / total > 0.98


def test_viterbi_is_the_best_labelling():
    import itertools

    field = html_crf.model()
    page = [html_crf.features(*b) for b in html_crf.blocks(html_crf.labelled_pages(5, seed=3)[2][0])][:9]
    score = field.scores(page)

    def value(y):
        return field.start[y[0]] + sum(score[t, k] for t, k in enumerate(y)) + sum(field.trans[a, b] for a, b in zip(y, y[1:], strict=False))

    assert value(field.decode(page)) == pytest.approx(max(value(y) for y in itertools.product((0, 1), repeat=len(page))))


def test_articles_of_all_pages(spark, sf):
    import html

    pages = {r.page_id: r.html for r in queries.documents(spark, sf, "pages").collect()}
    for r in queries.op8_html_text(spark, sf).collect():
        inner = re.search("<article>(.*?)</article>", pages[r.page_id], re.S)[1]
        parts = [" ".join(html.unescape(re.sub("<[^>]*>", " ", p)).split()) for p in re.split("</?(?:p|h1)>", inner)]
        assert r.text == "\n".join(p for p in parts if p) and r.n_chars == len(r.text)
