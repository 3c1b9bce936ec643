"""Sequence-like tables made of the test data, identically in DataFrame functions and in SQL.

Each text is cut at the ends of its sentences and lines, and after 120 letters, into sequences; no letter is left out.
raw has all letters in upper case, seq those of the 20-letter alphabet (it may be empty). Core sequences are those of
sources that end in 0 or 5, the others are pretraining ones; the language gives the cyclization type.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sequoria.functions import letters as W
from sequoria.functions import sequence as S
from sequoria.functions.plan import spread

ALPHABET = S.ALPHABET
OTHERS = "BJOUXZ"
ENDS = ".!?\n"
#: Sequences of one text get consecutive numbers under this.
PER_TEXT = 100_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def role(source: Column) -> Column:
    return F.when(source.rlike("[05]$"), "core").otherwise("pretrain")


def labelled_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, source, role, lang, label, toxic of each text, without the text."""
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"), "toxic")
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", role(F.col("source")).alias("role"), "lang")
    return docs.join(labels, "doc_id", "left")


def upper_letters(text: Column) -> Column:
    """The letters A-Z, in upper case, and marks of ends of a text. What else it holds is found and then left out by
    translations: an expression over the class of these letters takes some eight times as long."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    others = F.translate(text, f"{upper}{upper.lower()}{ENDS}", "")
    return F.call_function("translate", text, F.concat(F.lit(upper.lower()), others), F.lit(upper))


def sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ord, doc_id, pos, raw, seq, source, role, lang, cyclization_type, label (null if there is none), toxic."""
    cut = W.pieces(ENDS, 120, OTHERS)(F.col("text"))
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"), "toxic")
    # labels are joined to texts, of which there are far fewer than sequences
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")).join(labels, "doc_id", "left")
    # what is the same for all sequences of a text is made before it is cut
    kind = F.when(F.col("lang") == "en", "head_to_tail").when(F.col("lang") == "de", "disulfide").when(F.col("lang") == "fr", "sidechain").otherwise("")
    docs = docs.select("doc_id", "source", role(F.col("source")).alias("role"), "lang", kind.alias("cyclization_type"), "label", "toxic", cut.alias("cut"))
    docs = docs.select("*", F.posexplode("cut").alias("pos", "piece"))
    return docs.select("doc_id", (F.col("doc_id") * PER_TEXT + F.col("pos")).alias("ord"), "pos", "piece.raw", "piece.seq", "source", "role", "lang", "cyclization_type", "label", "toxic")


def _pick(index: Column, *values: str) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), (index % len(values)).cast("int"))


def measurements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measurement rows as text: one for each sequence, with censored values, units, bonds, weights and vetoes."""
    rows = sequences(spark, sf_dir).select("ord", "doc_id", "pos", "raw", "seq", "source", "lang")
    pos, h = F.col("pos"), F.col("doc_id") * 31 + F.col("pos") * 7
    cents = (h * 7919) % 6001
    number = lambda c: F.concat(F.call_function("div", c, F.lit(100)).cast("string"), F.lit("."), F.lpad((c % 100).cast("string"), 2, "0"))
    low, high = number(cents), number(cents + 1000)
    kind = pos % 8
    mic = F.when(kind == 1, F.concat(F.lit("<"), low)).when(kind == 2, F.concat(F.lit("<="), low)).when(kind == 3, F.concat(F.lit("> "), low)).when(kind == 4, F.concat(F.lit(">="), low)).when(kind == 5, F.concat(low, F.lit("-"), high)).when(kind == 6, F.concat(high, F.lit(" – "), low)).when((kind == 7) & (F.col("doc_id") % 5 == 0), "n/a").otherwise(low)
    unit = F.when(h % 6 == 5, F.when(pos % 3 == 0, "nM").otherwise("mcg/mL")).otherwise(_pick(h % 6, "ug/mL", "ug/mL", " mg / L", "µM", "umol/L", ""))
    spoken = F.when(F.col("lang") == "en", "head_to_tail").when(F.col("lang") == "de", " Disulfide").when(F.col("lang") == "fr", "sidechain").when(pos % 7 != 0, _pick(pos, "", "unknown", "cyclic_unspecified"))
    bonds = F.when(F.col("lang") == "de", _pick(pos, "[[2,5]]", '[[3,4,"DSB"],[1,2,"DSB"]]', '{"position1":1,"position2":4,"type":{"name":"DSB"},"cycleType":{"name":"NCB"}}', "[[1,", ""))
    bonds = bonds.when((F.col("lang") == "fr") & (pos % 5 == 0), "[[1,4]]").when((F.col("lang") == "en") & (pos % 11 == 0), '[[1,"4","AMD"],[11,3],[2,3]]').otherwise("")
    heavy = F.when(pos % 9 == 0, "2000").when((pos % 9 == 1) & (h % 2 == 0), "heavy").otherwise("")
    return rows.select(
        "ord",
        F.when(pos % 7 == 0, F.col("raw")).otherwise(F.col("seq")).alias("sequence"),
        mic.alias("mic"),
        unit.alias("unit"),
        _pick(pos, "E. coli ", "e. coli", "S. aureus").alias("target_species"),
        spoken.alias("cyclization_type"),
        bonds.alias("bonds_json"),
        F.when(pos % 4 == 0, "lariat").otherwise("").alias("topology"),
        heavy.alias("molecular_weight"),
        F.when(pos % 13 == 12, "range_cannot_be_reconstructed_from_scalar_activity").otherwise("").alias("conversion_exclusion_reason"),
        F.when(pos % 2 == 0, F.concat(F.lit("P"), F.col("doc_id").cast("string"))).otherwise("").alias("peptide_id"),
        "source",
    )


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, label, model (0 to 2), score with many ties, source."""
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    out = labels.join(docs, "doc_id").withColumn("model", F.explode(F.sequence(F.lit(0), F.lit(2))))
    return out.withColumn("score", ((F.col("doc_id") * 37 + F.col("model") * 11 + F.col("label") * 20) % 101) / 101.0)


_PIECE = "printf('%d.%02d', c // 100, c % 100)"
_UPPER_PIECE = "printf('%d.%02d', (c + 1000) // 100, (c + 1000) % 100)"
SQL = f"""
texts AS (
  SELECT d.doc_id, source, CASE WHEN regexp_matches(source, '[05]$') THEN 'core' ELSE 'pretrain' END AS role, lang, l.quality AS label, l.toxic
  FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id),
cut AS (SELECT doc_id, source, lang, regexp_extract_all(upper(regexp_replace(coalesce(text, ''), '[^A-Za-z.!?\\n]', '', 'g')), '[A-Z]{{1,120}}') AS parts FROM documents),
pieces AS (SELECT doc_id, source, lang, unnest(parts) AS raw, unnest(range(0, len(parts))) AS pos FROM cut),
docs AS (
  SELECT p.doc_id * {PER_TEXT} + pos AS ord, p.doc_id, pos, raw, regexp_replace(raw, '[{OTHERS}]', '', 'g') AS seq, source,
         CASE WHEN regexp_matches(source, '[05]$') THEN 'core' ELSE 'pretrain' END AS role, lang,
         CASE lang WHEN 'en' THEN 'head_to_tail' WHEN 'de' THEN 'disulfide' WHEN 'fr' THEN 'sidechain' ELSE '' END AS cyclization_type,
         l.quality AS label, l.toxic
  FROM pieces p LEFT JOIN labels l ON l.doc_id = p.doc_id),
rotated AS (
  SELECT *, CASE WHEN seq <> '' THEN list_transform(range(0, len(seq)), lambda i: substr(seq, CAST(i AS BIGINT) + 1) || substr(seq, 1, CAST(i AS BIGINT))) ELSE [] END AS turns FROM docs),
canon AS (SELECT *, list_min(turns) AS canonical FROM rotated),
numbered AS (SELECT *, doc_id * 31 + pos * 7 AS h, ((doc_id * 31 + pos * 7) * 7919) % 6001 AS c FROM docs),
measured AS (
  SELECT ord, CASE WHEN pos % 7 = 0 THEN raw ELSE seq END AS sequence,
         CASE WHEN pos % 8 = 1 THEN '<' || {_PIECE} WHEN pos % 8 = 2 THEN '<=' || {_PIECE} WHEN pos % 8 = 3 THEN '> ' || {_PIECE} WHEN pos % 8 = 4 THEN '>=' || {_PIECE}
              WHEN pos % 8 = 5 THEN {_PIECE} || '-' || {_UPPER_PIECE} WHEN pos % 8 = 6 THEN {_UPPER_PIECE} || ' – ' || {_PIECE} WHEN pos % 8 = 7 AND doc_id % 5 = 0 THEN 'n/a' ELSE {_PIECE} END AS mic,
         CASE h % 6 WHEN 0 THEN 'ug/mL' WHEN 1 THEN 'ug/mL' WHEN 2 THEN ' mg / L' WHEN 3 THEN 'µM' WHEN 4 THEN 'umol/L' ELSE CASE WHEN pos % 3 = 0 THEN 'nM' ELSE 'mcg/mL' END END AS unit,
         ['E. coli ', 'e. coli', 'S. aureus'][pos % 3 + 1] AS target_species,
         CASE WHEN lang = 'en' THEN 'head_to_tail' WHEN lang = 'de' THEN ' Disulfide' WHEN lang = 'fr' THEN 'sidechain' WHEN pos % 7 <> 0 THEN ['', 'unknown', 'cyclic_unspecified'][pos % 3 + 1] END AS cyclization_type,
         CASE WHEN lang = 'de' THEN ['[[2,5]]', '[[3,4,"DSB"],[1,2,"DSB"]]', '{{"position1":1,"position2":4,"type":{{"name":"DSB"}},"cycleType":{{"name":"NCB"}}}}', '[[1,', ''][pos % 5 + 1]
              WHEN lang = 'fr' AND pos % 5 = 0 THEN '[[1,4]]' WHEN lang = 'en' AND pos % 11 = 0 THEN '[[1,"4","AMD"],[11,3],[2,3]]' ELSE '' END AS bonds_json,
         CASE WHEN pos % 4 = 0 THEN 'lariat' ELSE '' END AS topology,
         CASE WHEN pos % 9 = 0 THEN '2000' WHEN pos % 9 = 1 AND h % 2 = 0 THEN 'heavy' ELSE '' END AS molecular_weight,
         CASE WHEN pos % 13 = 12 THEN 'range_cannot_be_reconstructed_from_scalar_activity' ELSE '' END AS veto,
         CASE WHEN pos % 2 = 0 THEN 'P' || doc_id ELSE '' END AS peptide_id, source, c, pos, doc_id
  FROM numbered),
scored AS (
  SELECT l.doc_id, quality AS label, source, m AS model, ((l.doc_id * 37 + m * 11 + quality * 20) % 101) / 101.0::DOUBLE AS score
  FROM labels l JOIN documents d ON d.doc_id = l.doc_id, (SELECT unnest([0, 1, 2]) AS m) k)
"""


def with_base(sql: str) -> str:
    return f"WITH RECURSIVE {SQL}, {sql.strip()}" if not sql.strip().upper().startswith("SELECT") else f"WITH RECURSIVE {SQL} {sql.strip()}"
