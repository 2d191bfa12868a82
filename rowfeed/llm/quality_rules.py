"""Quality rules: a threshold table compiled into one projection of ratios, without user functions.

Words are `[^\\x20\\x09-\\x0D]+`. Every measure is a built-in expression over one row, so the plan is scan, project,
with no shuffle. Repeated windows are found exactly: the row's three-word windows are sorted as strings with their
positions, equal neighbours are kept, and the union of their spans is summed.

Defined results: a null or empty text has no words, so it fails the base rule; a ratio over zero words or lines is 0;
repeated rows are judged alike; an empty table gives an empty result; other columns, whatever their names, pass through
`judge` unless they have the name of a measure, which then replaces them.
"""

from __future__ import annotations

import functools
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SYMBOLS = "[#*$%&|<>]"
MIN_WORDS = 50
#: Common words of languages in Latin script, a line each (fixed values); a capital may begin them. Texts in other scripts don't come
#: under the rule on them, and those of other languages in Latin script may fail it.
STOP_WORDS = (
    "a an and are as at be by for from in is it of on or that the this to was with "
    "al como con de del el en es la las lo los no para por que se su un una y "
    "au aux ce dans des du est et il le les ne pas pour qui sur une "
    "auf aus das dem den der die ein eine er ist mit nicht sich sie und von zu für im "
    "che della dei di gli nel non sono "
    "ao com da das do dos em mais não os ou uma "
    "aan dat een het met niet op te van voor "
    "att av det för inte och på som till ikke af "
    "jest na nie od się że "
    "bir bu ile için ve "
    "dan yang ini itu untuk dengan "
    "și în cu pe că"
).split()


@dataclass(frozen=True)
class Rule:
    """A row fails if the measure lies outside [low, high]; rows whose `spare` measure is above its bound can't fail."""

    name: str
    measure: str
    low: float | None = None
    high: float | None = None
    spare: tuple[str, float] | None = None


#: Ratios are of words, of lines or of characters in words, as their names say.
THRESHOLDS = (
    Rule("short_words", "mean_word_chars", low=2.0),
    Rule("long_words", "mean_word_chars", high=20.0),
    Rule("symbols", "symbols_per_word", high=0.3),
    Rule("capitals", "upper_ratio", high=0.5),
    Rule("same_lines", "dup_line_ratio", high=0.5),
    Rule("stop_words", "stop_word_ratio", low=0.03, spare=("foreign_ratio", 0.3)),
)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body(value)` with the value evaluated once, whatever the optimizer does with projections."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _words(text: Column) -> Column:
    return F.array_remove(F.split(text, "[ \t-\r]+"), "")


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)).cast("long")


def _repeat_words(words: Column) -> Column:
    """Words inside three-word windows that occur twice or more in the array."""

    def window(i: Column) -> Column:
        return F.struct(F.concat_ws(" ", F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)).alias("w"), i.alias("p"))

    def repeated(found: Column) -> Column:
        return F.filter(found, lambda x, k: (F.get(found, k - 1)["w"] == x["w"]) | (F.get(found, k + 1)["w"] == x["w"]))

    def covered(at: Column) -> Column:
        start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).alias("last"))
        step = lambda acc, p: F.struct((acc["n"] + F.least(F.lit(3), p - acc["last"])).alias("n"), p.alias("last"))
        return F.aggregate(at, start, step, lambda acc: acc["n"])

    windows = F.sort_array(F.transform(F.sequence(F.lit(0), F.size(words) - 3), window))
    spans = covered(F.sort_array(F.transform(_let(windows, repeated), lambda x: x["p"])))
    return F.when(F.size(words) < 4, F.lit(0).cast("long")).otherwise(spans)


def _dup_lines(text: Column) -> Column:
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike("[^ \t-\r]"))
    return _let(lines, lambda a: F.struct((F.size(a) - F.size(F.array_distinct(a))).cast("long").alias("dup"), F.size(a).cast("long").alias("n")))


def measures(text: Column) -> Column:
    """The counts of one text, as a struct."""

    def of_words(words: Column) -> list[Column]:
        return [
            F.size(words).cast("long").alias("n_words"),
            F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
            _repeat_words(words).alias("n_repeat_words"),
            F.size(F.filter(words, lambda w: w.isin(_stop_forms()))).cast("long").alias("n_stop_words"),
        ]

    full = F.coalesce(text, F.lit(""))
    symbols, upper, foreign, lines = _count(full, SYMBOLS), _count(full, "[A-Z]"), _count(full, r"[^\x00-\x7F]"), _dup_lines(full)
    line_counts = _let(lines, lambda a: F.struct(symbols.alias("n_symbols"), upper.alias("n_upper"), foreign.alias("n_foreign"), a["dup"].alias("n_dup_lines"), a["n"].alias("n_lines")))
    return _let(line_counts, lambda m: _let(_words(full), lambda w: F.struct(*of_words(w), *[m[n].alias(n) for n in ("n_symbols", "n_upper", "n_foreign", "n_dup_lines", "n_lines")])))


def _stop_forms() -> list[str]:
    return sorted({x for w in STOP_WORDS for x in (w, w.capitalize())})


def _ratio(m: Column, part: str, whole: str) -> Column:
    return F.when(m[whole] > 0, m[part] / m[whole]).otherwise(F.lit(0.0))


RATIOS = {
    "mean_word_chars": ("word_chars", "n_words"),
    "symbols_per_word": ("n_symbols", "n_words"),
    "upper_ratio": ("n_upper", "word_chars"),
    "foreign_ratio": ("n_foreign", "word_chars"),
    "dup_line_ratio": ("n_dup_lines", "n_lines"),
    "stop_word_ratio": ("n_stop_words", "n_words"),
}


def holds(rule: Rule, m: Column) -> Column:
    """One rule as a boolean of the counts."""
    value, kept = _ratio(m, *RATIOS[rule.measure]), F.lit(True)
    if rule.low is not None:
        kept = kept & (value >= F.lit(rule.low))
    if rule.high is not None:
        kept = kept & (value <= F.lit(rule.high))
    return kept | (_ratio(m, *RATIOS[rule.spare[0]]) > F.lit(rule.spare[1])) if rule.spare else kept


def compile_rules(rules: tuple[Rule, ...], m: Column) -> Column:
    """The table as one boolean of the counts: no rule is broken."""
    return functools.reduce(Column.__and__, [holds(r, m) for r in rules], F.lit(True))


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Names of one operator's own columns beside whatever the input has.
OWN = "__rowfeed_quality"


def verdict(text: Column, rules: tuple[Rule, ...] = THRESHOLDS) -> Column:
    """The counts, base_failed and kept of a text, as one expression."""

    def judged(m: Column) -> Column:
        failed = (m["n_words"] < MIN_WORDS) | (F.lit(100) * m["n_repeat_words"] > F.lit(50) * m["n_words"])
        return F.struct(*[m[n].alias(n) for n in COUNTS], failed.alias("base_failed"), (~failed & compile_rules(rules, m)).alias("kept"))

    return _let(measures(text), judged)


def judge(docs: DataFrame, rules: tuple[Rule, ...] = THRESHOLDS, text_col: str = "text") -> DataFrame:
    """`docs` with the counts, `base_failed` and `kept`, which replace columns of those names."""
    names = [*COUNTS, "base_failed", "kept"]
    others = [F.col(f"`{c}`") for c in docs.columns if c not in names]
    laid = docs.select(*others, verdict(F.col(f"`{text_col}`"), rules).alias(OWN))
    return laid.select(*others, *[F.col(f"{OWN}.{n}").alias(n) for n in names])


def keep_good(docs: DataFrame, rules: tuple[Rule, ...] = THRESHOLDS) -> DataFrame:
    """The rows of `docs` that are kept, with their columns as they are."""
    return docs.where(verdict(F.col("text"), rules)["kept"])


def score_quality(docs: DataFrame) -> DataFrame:
    return judge(docs.select("doc_id", "text")).drop("text")


def losses(docs: DataFrame, rules: tuple[Rule, ...] = THRESHOLDS) -> DataFrame:
    """How many rows fail the base rule, and of the others each rule: rule, n_failed."""
    m = measures(F.col("text"))
    failed = (F.col("m.n_words") < MIN_WORDS) | (100 * F.col("m.n_repeat_words") > 50 * F.col("m.n_words"))
    flags = [F.when(failed, F.lit("base")), *(F.when(~failed & ~holds(r, F.col("m")), F.lit(r.name)) for r in rules)]
    return docs.select(m.alias("m")).select(F.explode(F.array_compact(F.array(*flags))).alias("rule")).groupBy("rule").agg(F.count("*").alias("n_failed"))


def quality_sql() -> str:
    """DuckDB SQL for `score_quality` over `documents`."""
    stop = ", ".join(f"'{w}'" for w in _stop_forms())
    ratio = {k: f"CASE WHEN {w} > 0 THEN {p}::DOUBLE / {w} ELSE 0 END" for k, (p, w) in RATIOS.items()}

    def holds(r: Rule) -> str:
        parts = [f"{ratio[r.measure]} {sign} {bound}" for sign, bound in ((">=", r.low), ("<=", r.high)) if bound is not None]
        return f"({' AND '.join(parts)}" + (f" OR {ratio[r.spare[0]]} > {r.spare[1]})" if r.spare else ")")

    kept = " AND ".join(map(holds, THRESHOLDS))
    return f"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text,
    regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines
  FROM documents),
win AS (
  SELECT rid, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS w
  FROM (SELECT rid, words, unnest(range(1, len(words)::BIGINT - 1)) AS i FROM d)),
rep AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, w) AS n FROM win) WHERE n > 1),
cov AS (SELECT rid, count(DISTINCT i + k)::BIGINT AS n FROM rep, (SELECT unnest([0, 1, 2]) AS k) GROUP BY rid),
m AS (
  SELECT doc_id, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
    len(regexp_extract_all(text, '{SYMBOLS}'))::BIGINT AS n_symbols,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(cov.n, 0)::BIGINT AS n_repeat_words,
    len(list_filter(words, lambda w: w IN ({stop}))) AS n_stop_words, len(lines) AS n_lines,
    len(regexp_extract_all(text, '[A-Z]')) AS n_upper, len(regexp_extract_all(text, '[^\\x00-\\x7F]')) AS n_foreign
  FROM d LEFT JOIN cov USING (rid)),
b AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND {kept} AS kept FROM b"""
