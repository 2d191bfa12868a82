"""License scan by canonical digest: whole texts are normalised, hashed and hash-joined to known licence digests.

Everything is a DataFrame expression. Canonical form: A-Z lower-cased; copyright lines dropped; equivalent spellings
unified; all other ASCII than letters and digits, and typographic quotes and dashes, become one space; trimmed.

Defined results: a null text counts as empty; the empty canonical text (no letters or digits) matches no licence; equal
texts match alike, so repeated rows each get their row; an empty table gives an empty result. Where one digest has several
licence ids, the smallest id is reported, so that a document never yields two rows. A text that matches none is tried
again without lines of "copyright" and a plain name; the digest reported is that of the canonical form. Other columns of the input are not read.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rowfeed.llm.license_texts import FULL_TEXTS, LICENSES

#: A digest table of at most this many rows (about 100 bytes each) is broadcast; a larger one is joined by shuffle.
BROADCAST_ROWS = 20_000

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A line that only states who holds the copyright: it starts, after marks, with "copyright" or "(c)" and a year or a mark.
COPYRIGHT_LINE = r"(^|\n)[ \t/*#;>-]*((copyright|©)[ \t]*(\(c\)|©|[0-9<\[{,-]|by )|\(c\)[ \t]*(copyright|[0-9]))[^\n]*"
#: The same with a plain name: "copyright" and a word that running licence text doesn't have there.
NAMED = r"[ \t/*#;>-]*copyright[ \t]+"
#: Words that running licence text has after "copyright" (fixed values).
RUNNING = r"(notices?|(co)?holders?|owners?|laws?|licen[cs]e[sd]?|statements?|interests?|rights?|and|or|in|on|of|to|is|as|for|under|treat(y|ies)|claims?|disclaimers?|permissions?|protection|infringements?|doctrines?)([^a-z0-9]|$)"
NAMED_LINE = rf"(^|\n){NAMED}(?!{RUNNING})[^ \t\n][^\n]*"
RESERVED_LINE = r"(^|\n)[ \t/*#;>-]*all rights reserved[.]?[ \t]*"
#: Equivalent spellings, after the licence list matching guidelines (fixed values).
SPELLINGS = {
    "acknowledgement": "acknowledgment",
    "analyse": "analyze",
    "artefact": "artifact",
    "authorisation": "authorization",
    "authorised": "authorized",
    "cancelled": "canceled",
    "centre": "center",
    "customisation": "customization",
    "favour": "favor",
    "favourite": "favorite",
    "fulfil": "fulfill",
    "initialise": "initialize",
    "judgement": "judgment",
    "labelling": "labeling",
    "labour": "labor",
    "licence": "license",
    "licenced": "licensed",
    "licences": "licenses",
    "maximise": "maximize",
    "modelled": "modeled",
    "modelling": "modeling",
    "offence": "offense",
    "optimise": "optimize",
    "organisation": "organization",
    "organise": "organize",
    "practise": "practice",
    "programme": "program",
    "realise": "realize",
    "recognise": "recognize",
    "signalling": "signaling",
    "utilisation": "utilization",
    "whilst": "while",
}
SPACERS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F©«»‘’“”–—]+"


def canonical(text: Column) -> Column:
    """The canonical form as one expression. While spellings are replaced each word has two spaces before and after it, one of its own, so that neighbours are both replaced."""
    lower = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    bare = F.regexp_replace(F.regexp_replace(lower, COPYRIGHT_LINE, "\n"), RESERVED_LINE, "\n")
    out = F.concat(F.lit(" "), F.regexp_replace(bare, SPACERS, "  "), F.lit(" "))
    for old, new in SPELLINGS.items():
        out = F.replace(out, F.lit(f" {old} "), F.lit(f" {new} "))
    return F.trim(F.replace(out, F.lit("  "), F.lit(" ")))


def canonical_text(text: str | None) -> str:
    """The same on the driver, for the few licence texts and for tests."""
    lower = (text or "").translate(str.maketrans(UPPER, LOWER))
    bare = re.sub(RESERVED_LINE, "\n", re.sub(COPYRIGHT_LINE, "\n", lower))
    return " ".join(SPELLINGS.get(w, w) for w in re.sub(SPACERS, " ", bare).split(" ") if w)


def digest(text: Column) -> Column:
    return F.sha2(canonical(text), 256)


def known_digests() -> list[tuple[str, str]]:
    """(digest, licence id) of the texts that come with this module; of FULL_TEXTS there are digests only."""
    return sorted((hashlib.sha256(canonical_text(t).encode()).hexdigest(), name) for name, t in LICENSES.items())


def known_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(known_digests() + sorted(FULL_TEXTS.items()), "digest string, license_id string")


def scan_licenses(docs: DataFrame, known: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of `docs`: id, digest, license_id (null where the whole text is no known licence), is_license.

    `known` has (digest, license_id), by default the texts of this module. It is broadcast only after a count that stops
    at BROADCAST_ROWS; a larger table is joined by shuffle, where AQE splits a digest that many documents have.
    """
    known = known_table(docs.sparkSession) if known is None else known
    known = known.where(F.col("digest") != hashlib.sha256(b"").hexdigest()).groupBy("digest").agg(F.min("license_id").alias("license_id"))
    few = known.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    if few:
        known = F.broadcast(known)
    text = F.col(text_col)
    lower = F.translate(text, UPPER, LOWER)
    keyed = docs.select(F.col(id_col).alias("doc_id"), digest(text).alias("digest"), F.when(lower.rlike(NAMED_LINE), digest(F.regexp_replace(lower, NAMED_LINE, "\n"))).alias("named"))
    # The second digest is never null, so that a join by shuffle has no null key in which all texts without one meet.
    keyed = keyed.select("doc_id", "digest", F.coalesce("named", "digest").alias("named"))
    other = known.select(F.col("digest").alias("named"), F.col("license_id").alias("other_id"))
    other = F.broadcast(other) if few else other
    found = keyed.join(known, "digest", "left").join(other, "named", "left").select("doc_id", "digest", F.coalesce("license_id", "other_id").alias("license_id"))
    return found.withColumn("is_license", F.col("license_id").isNotNull())


def scan_sql() -> str:
    """DuckDB SQL for `scan_licenses` over `documents`: the digest of the canonical form, else of the text without lines of "copyright" and a plain name."""

    def text(x: str) -> str:
        return "'" + x.replace("'", "''") + "'"

    spelt = "CASE w " + " ".join(f"WHEN '{old}' THEN '{new}'" for old, new in SPELLINGS.items()) + " ELSE w END"

    def digest_of(lower: str) -> str:
        bare = f"regexp_replace(regexp_replace({lower}, {text(COPYRIGHT_LINE)}, chr(10), 'g'), {text(RESERVED_LINE)}, chr(10), 'g')"
        return f"sha256(array_to_string(list_transform(list_filter(string_split(regexp_replace({bare}, {text(SPACERS)}, ' ', 'g'), ' '), lambda w: w <> ''), lambda w: {spelt}), ' '))"

    # RE2 has no look-ahead, so lines are looked at one by one.
    is_named = f"regexp_matches(x, {text(f'^{NAMED}[^ ' + chr(92) + 't]')}) AND NOT regexp_matches(x, {text(f'^{NAMED}{RUNNING}')})"
    unnamed = f"array_to_string(list_transform(string_split(lower, chr(10)), lambda x: CASE WHEN {is_named} THEN '' ELSE x END), chr(10))"
    values = ", ".join(f"('{d}', '{n}')" for d, n in sorted([*known_digests(), *FULL_TEXTS.items()]))
    return f"""
WITH listed(digest, license_id) AS (VALUES {values}),
known AS (SELECT digest, min(license_id) AS license_id FROM listed GROUP BY digest),
lowered AS (SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS lower FROM documents),
keyed AS (SELECT doc_id, {digest_of('lower')} AS digest, {digest_of(unnamed)} AS named FROM lowered)
SELECT doc_id, keyed.digest, coalesce(a.license_id, b.license_id) AS license_id, coalesce(a.license_id, b.license_id) IS NOT NULL AS is_license
FROM keyed LEFT JOIN known a ON keyed.digest = a.digest LEFT JOIN known b ON keyed.named = b.digest"""
