"""License scans by canonical digest lookup, in DataFrame functions only.

A text is normalised: A-Z in lower case, copyright lines and list marks away, equivalent spellings to one form,
punctuation and white space to single spaces. Its SHA-256 is joined by hash to the digests of known licence texts. The
same is done for each line and each paragraph of several lines of a document, since notices mostly stand in other text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower
from .license_texts import DIGESTS, KNOWN, WHOLE

__all__ = ["DIGESTS", "KNOWN", "ORACLE_SQL", "WHOLE", "canonical", "known_licenses", "scan"]

# Spellings that count as the same, after punctuation has become spaces; applied in this order.
SPELLINGS = (
    ("licence", "license"),
    ("licences", "licenses"),
    ("licenced", "licensed"),
    ("sublicence", "sublicense"),
    ("sub license", "sublicense"),
    ("sub licence", "sublicense"),
    ("non commercial", "noncommercial"),
    ("non infringement", "noninfringement"),
    ("organisation", "organization"),
    ("acknowledgement", "acknowledgment"),
    ("merchantibility", "merchantability"),
    ("per cent", "percent"),
    ("favour", "favor"),
    ("https", "http"),
    ("gplv2", "gpl version 2"),
    ("gplv3", "gpl version 3"),
    ("v2", "version 2"),
    ("v3", "version 3"),
    ("v 2", "version 2"),
    ("v 3", "version 3"),
    ("copyright holder", "copyright owner"),
    ("copyright holders", "copyright owners"),
)
#: Digests that are broadcast at most.
BROADCAST_ROWS = 100_000
#: Whole lines that only tell the holder of the rights, and marks of lists at the start of a line.
NOISE = "(?md)^[ \\t]*(?:(?:copyright[ \\t:,]*(?:\\(c\\)|©|[0-9]{4}|by |<|\\[)|\\(c\\)|©|all rights reserved)[^\\n]*$|(?:[-*]|[0-9]{1,2}[.)])[ \\t]+)"
PUNCTUATION = "[^a-z0-9\u0080-\U0010ffff]+"


def canonical(text: Column) -> Column:
    """Normal form of a text; '' for null, and for a text of punctuation or copyright lines only."""
    out = F.regexp_replace(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(NOISE), F.lit(" "))
    out = F.concat(F.lit(" "), F.regexp_replace(out, F.lit(PUNCTUATION), F.lit(" ")), F.lit(" "))

    def spelled(bare: Column) -> Column:
        # each word gets spaces of its own on both sides, so that spellings next to each other are all replaced
        replaced, met = F.replace(bare, F.lit(" "), F.lit("  ")), F.lit(False)
        for a, b in SPELLINGS:
            replaced = F.replace(replaced, F.lit(f" {a.replace(' ', '  ')} "), F.lit(f" {b.replace(' ', '  ')} "))
        for first in sorted({a.split(" ")[0] for a, _ in SPELLINGS}):  # most texts have nothing to replace
            met = met | F.contains(bare, F.lit(f" {first} "))
        return F.btrim(F.when(met, F.regexp_replace(replaced, F.lit(" +"), F.lit(" "))).otherwise(bare))

    return F.get(F.transform(F.array(out), spelled), F.lit(0))  # a variable: out is made once


def known_licenses(spark: SparkSession, texts: tuple[tuple[str, str], ...] = KNOWN, digests: tuple[tuple[str, str], ...] = DIGESTS) -> DataFrame:
    """(digest, license) of licence texts and of digests of normal forms; one row a digest, of several names the first
    by code point."""
    df = spark.createDataFrame(list(texts), "license string, text string").select(F.sha2(canonical(F.col("text")), 256).alias("digest"), "license")
    if digests:
        df = df.union(spark.createDataFrame(list(digests), "license string, digest string").select("digest", "license"))
    return df.groupBy("digest").agg(F.min("license").alias("license"))


def scan(docs: DataFrame, known: DataFrame) -> DataFrame:
    """(doc_id, text_digest, text_license, line_licenses, n_license_lines, paragraph_licenses) for every row of docs
    (doc_id, text).

    text_license: the licence that the entire text is, else null. line_licenses: the distinct licences that whole
    lines are, sorted and joined by commas, '' if none; n_license_lines: the lines that match, repeats counted;
    paragraph_licenses: the distinct ones that paragraphs of several lines are (paragraphs are parted by blank lines).
    Null, empty and blank texts and lines match nothing. Repeated rows give repeated rows; an empty table gives none;
    other columns are ignored.

    Each row and its lines stay in one task up to the sums, which are all that is shuffled.
    """
    docs = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    known = known.filter(F.col("digest") != F.sha2(F.lit(""), 256))
    whole, lines = F.array(F.struct(F.lit(0).alias("kind"), F.col("text").alias("unit"))), F.split("text", "\n")
    parts = F.when(F.rlike("text", F.lit("\n[ \t\r]*\n")), F.filter(F.split("text", "\n[ \t\r]*\n"), lambda p: F.contains(p, F.lit("\n")))).otherwise(F.array().cast("array<string>"))

    def tagged(kind: int, units: Column) -> Column:
        return F.transform(units, lambda u: F.struct(F.lit(kind).alias("kind"), u.alias("unit")))

    units = docs.select("row", "doc_id", F.inline(F.concat(whole, tagged(1, lines), tagged(2, parts))))
    units = units.select("row", "doc_id", "kind", F.sha2(canonical(F.col("unit")), 256).alias("digest"))
    if known.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:  # about 100 bytes a row; a larger table is joined by a shuffle
        known = F.broadcast(known)
    met = units.join(known, "digest", "left")

    def names(kind: int) -> Column:
        return F.array_join(F.array_sort(F.collect_set(F.when(F.col("kind") == kind, F.col("license")))), ",")

    return (
        met.groupBy("row")
        .agg(
            F.max("doc_id").alias("doc_id"),
            F.max(F.when(F.col("kind") == 0, F.col("digest"))).alias("text_digest"),
            F.max(F.when(F.col("kind") == 0, F.col("license"))).alias("text_license"),
            names(1).alias("line_licenses"),
            F.count_if((F.col("kind") == 1) & F.col("license").isNotNull()).alias("n_license_lines"),
            names(2).alias("paragraph_licenses"),
        )
        .drop("row")
    )


def _canonical_sql(x: str) -> str:
    """The normal form in SQL, word by word: single words by a map, pairs of words between doubled spaces."""
    bare = f"regexp_replace(translate(coalesce({x}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '(?m)^[ \\t]*(?:(?:copyright[ \\t:,]*(?:\\(c\\)|©|[0-9]{{4}}|by |<|\\[)|\\(c\\)|©|all rights reserved)[^\\n]*$|(?:[-*]|[0-9]{{1,2}}[.)])[ \\t]+)', ' ', 'g')"
    words = f"string_split(trim(regexp_replace({bare}, '[^a-z0-9\\x{{80}}-\\x{{10ffff}}]+', ' ', 'g')), ' ')"
    single = " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in SPELLINGS if " " not in a)
    out = f"' ' || array_to_string(list_transform({words}, lambda w: CASE w {single} ELSE w END), '  ') || ' '"
    for a, b in SPELLINGS:
        if " " in a:
            out = f"replace({out}, ' {a.replace(' ', '  ')} ', ' {b.replace(' ', '  ')} ')"
    return f"trim(regexp_replace({out}, ' +', ' ', 'g'))"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


#: The same scan in SQL.
ORACLE_SQL = f"""
WITH known AS (
  SELECT digest, min(l) AS license FROM (
    SELECT sha256({_canonical_sql('t')}) AS digest, l FROM (VALUES {', '.join(f"({_quoted(name)}, {_quoted(t)})" for name, t in KNOWN)}) v(l, t)
    UNION ALL SELECT g, l FROM (VALUES {', '.join(f"({_quoted(name)}, '{g}')" for name, g in DIGESTS) or "(NULL, '-')"}) v(l, g)) u GROUP BY 1),
d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
l AS (SELECT r, sha256({_canonical_sql('line')}) AS digest FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d)),
p AS (SELECT r, sha256({_canonical_sql('part')}) AS digest FROM (SELECT r, unnest(regexp_split_to_array(text, '\n[ \t\r]*\n')) AS part FROM d) WHERE contains(part, chr(10))),
h AS (SELECT r, string_agg(DISTINCT license, ',' ORDER BY license) AS line_licenses, count(*) AS n FROM l JOIN known USING (digest) GROUP BY r),
q AS (SELECT r, string_agg(DISTINCT license, ',' ORDER BY license) AS paragraph_licenses FROM p JOIN known USING (digest) GROUP BY r),
w AS (SELECT r, doc_id, sha256({_canonical_sql('text')}) AS text_digest FROM d)
SELECT doc_id, text_digest, license AS text_license, coalesce(line_licenses, '') AS line_licenses, CAST(coalesce(n, 0) AS BIGINT) AS n_license_lines, coalesce(paragraph_licenses, '') AS paragraph_licenses
FROM w LEFT JOIN known ON text_digest = digest LEFT JOIN h USING (r) LEFT JOIN q USING (r)
"""
