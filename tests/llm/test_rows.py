"""Odd rows through every operator: nothing crashes, no row is lost, results are as defined."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from rowfeed.llm import best_fit, chaining, fm_index, fst_tokens, html_crf, license_digest, pfor_ids, quality_rules, simhash_anchor, toxicity_cnn


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([(1, "w1 w2 w3"), (2, None), (None, "w4 w5"), (3, "")], "item_id bigint, text string")


@pytest.fixture(scope="module")
def labels(spark, odd_rows):
    return spark.createDataFrame([(r[0], 1, i % 2) for i, r in enumerate(odd_rows)] + [(None, None, None)], "doc_id bigint, quality int, toxic int")


def per_row(name, docs, benchmark, labels):
    return {
        "tokens": lambda: fst_tokens.count_tokens(docs),
        "leaks": lambda: fm_index.leak_digest(docs, benchmark),
        "quality": lambda: quality_rules.score_quality(docs),
        "toxicity": lambda: toxicity_cnn.score_toxicity(docs, labels),
        "ids": lambda: pfor_ids.write_and_read(docs),
        "licenses": lambda: license_digest.scan_licenses(docs),
        "simhash": lambda: simhash_anchor.near_duplicates(docs),
    }[name]()


NAMES = ["tokens", "leaks", "quality", "toxicity", "ids", "licenses", "simhash"]


@pytest.mark.parametrize("name", NAMES)
def test_one_row_for_each_row(name, odd, odd_rows, benchmark, labels):
    got = [r.doc_id for r in per_row(name, odd, benchmark, labels).collect()]
    assert sorted(map(str, got)) == sorted(str(r[0]) for r in odd_rows)


@pytest.mark.parametrize("name", NAMES)
def test_empty_tables(name, empty, benchmark, labels):
    out = per_row(name, empty, benchmark.limit(0), labels.limit(0))
    assert out.count() == 0 and "doc_id" in out.columns


def test_passages_of_odd_rows(odd, empty):
    got = {(r.doc_id, tuple(r.partner_ids)) for r in chaining.repeated_passages(odd).collect()}
    assert got == {(2, (1,)), (None, (2,))}  # a document without an id comes last
    assert chaining.repeated_passages(empty).count() == 0


def test_packing_of_odd_rows(odd, empty, odd_rows):
    rows = best_fit.pack_documents(odd).collect()
    assert {r.doc_id for r in rows} == {r[0] for r in odd_rows}
    assert {r.doc_id for r in rows if r.bin_id is None} == {3, 4}
    sized = {r.doc_id: r.n_tokens for r in fst_tokens.count_tokens(odd).collect()}
    assert sum(r.n_tokens for r in rows if r.doc_id == 6) == sized[6] > best_fit.CAPACITY
    assert best_fit.pack_documents(empty).count() == 0


def test_pages_of_odd_rows(spark):
    page = "<article><p>Some text that is long enough to be a sentence of an article.</p></article>"
    pages = spark.createDataFrame([(1, "u", page, 1), (1, "u", page, 1), (None, None, None, None), (2, "v", "", 2), (3, "w", "<p", 3), (4, "x", "<<>><!-- x", 4)], "page_id bigint, url string, html string, text int")
    got = html_crf.extract_text(pages).collect()
    assert len(got) == 6 and sum(r.n_chars for r in got if r.page_id == 1) == 2 * got[0].n_chars > 0
    assert [(r.text, r.n_chars) for r in got if r.page_id in (None, 2)] == [("", 0)] * 2
    assert html_crf.extract_text(pages.limit(0)).count() == 0


def test_stages_keep_columns(spark, odd, empty, sf, tmp_path):
    for docs in (odd, empty):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, sf)
            assert out.columns == docs.columns and [t for _, t in out.dtypes] == [t for _, t in docs.dtypes]
            out.write.mode("overwrite").parquet(f"file://{tmp_path}/o")
    kept = {r.doc_id: r.key for r in corpus_pipeline.STAGES[1][1](spark, odd, sf).collect()}
    assert set(kept.values()) == {3} and 1 in kept and not {2, None} & set(kept)  # the row without an id is a copy, and comes last


def test_untouched_columns_survive_a_cut(spark, odd, benchmark):
    out = fm_index.decontaminate(odd.withColumn("text", F.concat(F.coalesce("text", F.lit("")), F.lit(" x" * 200 + " w1 w2 w3"))), benchmark)
    row = out.where("doc_id = 7").first()
    assert row.spans == [2] and row.items == "x" and "w1 w2 w3" not in row.text and row.n_chars == len(row.text)


def test_near_dedup_is_of_rows(spark):
    """A unique text stays whatever id it shares; of equal rows, and of copies whatever their ids, one stays."""
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    rows = [(1, a, 1), (1, a, 1), (2, a, 2), (2, b, 3), (None, b, 4), (None, a, 5), (3, c, 6), (3, c, 6), (3, c, 6), (None, None, 7), (4, "", 8)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, row_key int").repartition(4)
    got = sorted((str(r.doc_id), r.text, r.row_key) for r in simhash_anchor.keep_first(docs).collect())
    assert got == sorted([("1", a, 1), ("2", b, 3), ("3", c, 6), ("4", "", 8)])


@pytest.mark.parametrize(("hot_homes", "small_anchor"), [(0, 24), (3, 3), (100_000, 2)])
def test_components_don_t_depend_on_how_anchors_are_compared(spark, hot_homes, small_anchor):
    import random

    r = random.Random(1)
    base = [f"w{i}" for i in range(300)]
    texts = [" ".join(w if r.random() > 0.004 * (k % 5) else f"x{k}" for w in base) for k in range(60)] + [" ".join(r.choice(base) for _ in range(50)) for _ in range(30)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    plain = {x.doc_id: x.component_id for x in simhash_anchor.near_duplicates(docs).collect()}
    assert len(set(plain.values())) < 80
    assert {x.doc_id: x.component_id for x in simhash_anchor.near_duplicates(docs, hot_homes=hot_homes, small_anchor=small_anchor).collect()} == plain


def test_benchmarks_of_many_blocks(spark):
    docs = spark.createDataFrame([(k, " ".join(f"w{k + i}" for i in range(40))) for k in range(20)] + [(None, None)], "doc_id bigint, text string")
    items = spark.createDataFrame([(f"i{k}", " ".join(f"w{k + i}" for i in range(15))) for k in range(0, 60, 3)], "item_id string, text string")
    one, many = (sorted((str(r.doc_id), r.n_words, str(r.spans), r["items"]) for r in fm_index.find_leaks(docs, items, block_words=n).collect()) for n in (10**6, 40))
    assert one == many and sum(len(r[3]) > 0 for r in one) == 20


def test_pages_that_nothing_closes():
    import time

    began = time.perf_counter()
    for page in ("<a " * 1_000_000, "<div>x" * 100_000, "<b>" * 200_000 + "<p>x</p>" * 20_000, "<span>" * 100_000 + "x<hr>" * 100_000 + "</i>" * 100_000, "<p title='" * 200_000, '<p a="' * 200_000 + ">x", "<!--" * 500_000, "<i>" + "<div>" * 50_000 + "</i>x" * 50_000, "<style>" * 300_000, "x " * 4_000_000):
        html_crf.blocks(page)
    assert time.perf_counter() - began < 60


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ('<article><p title="a > b" data-x=\'<p>\'>one<p>two</article>', ["one", "two"]),
        ('<p a="b" c">one</p><p>2 < 3 <b>bold</b></p>', ["one", "2 < 3 bold"]),
        ("<table><tr><td>a<td>b<tr><td>c</table>", ["a", "b", "c"]),
        ("<ul><li>a<ul><li>b</ul><li>c</ul>", ["a", "b", "c"]),
        ("<b>x<div>y</b>z</div>", ["x", "yz"]),
        ("<p>one<br/>two<wbr>three</p><p hidden>no</p><p class='not hidden'>yes", ["one twothree", "yes"]),
        ("<head><title>t</title><body><p>one", ["one"]),
    ],
)
def test_leaf_blocks(page, want):
    assert [b[0] for b in html_crf.blocks(page)] == want


def test_adjacent_spellings(spark):
    texts = ["Licence licence, LICENCE x", "the licence"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(license_digest.canonical(F.col("t")).alias("c")).collect()
    assert [r.c for r in got] == ["license license license x", "the license"] == [license_digest.canonical_text(t) for t in texts]


def test_rule_on_stop_words_spares_other_scripts(spark):
    rows = [(0, " ".join(f"слово{chr(1072 + i % 30)}{chr(1072 + i % 7)}ок{chr(1072 + i % 11)}" for i in range(90))), (1, " ".join(f"qz{i}x" for i in range(90)))]
    got = {r.doc_id: r.kept for r in quality_rules.score_quality(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == {0: True, 1: False}
    assert {r.rule: r.n_failed for r in quality_rules.losses(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()} == {"stop_words": 1}
