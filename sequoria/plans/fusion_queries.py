"""Queries on topology, structures and the alignment of blocks, and on splits for transfer training."""

from __future__ import annotations

from pyspark.sql import functions as F

from sequoria.functions import sequence as S
from sequoria.functions import topology as T
from sequoria.functions.plan import sealed, stored
from sequoria.operators import fusion as U
from sequoria.operators import metrics as X
from sequoria.operators import splits as L

from . import proxies as P
from .base import query

_BONDED = """
bonded AS (SELECT ord, pos, seq, cyclization_type, label, toxic, source,
  CASE WHEN pos % 6 = 0 THEN '[[1,' || len(seq) || ',"AMD"]]' WHEN pos % 6 = 1 THEN '[[2,5,"dsb"]]' WHEN pos % 6 = 2 THEN '[[1,' || len(seq) || ',"AMD"],[3,4,"DSB"]]' WHEN pos % 6 = 3 THEN '' WHEN pos % 6 = 4 THEN '[[1,3,"EST"]]' ELSE '{"a":1}' END AS bonds,
  CASE WHEN pos % 17 = 0 THEN 'C1CC1' ELSE '' END AS smiles, CASE WHEN pos % 4 = 1 THEN [[5, 2]] WHEN pos % 4 = 2 THEN [[9, 1], [4, 7]] ELSE [] END AS pairs FROM docs WHERE seq <> '')
"""


def _bonded(spark, sf_dir):
    pos, n = F.col("pos"), F.length("seq").cast("string")
    bonds = F.when(pos % 6 == 0, F.concat(F.lit("[[1,"), n, F.lit(',"AMD"]]'))).when(pos % 6 == 1, '[[2,5,"dsb"]]').when(pos % 6 == 2, F.concat(F.lit("[[1,"), n, F.lit(',"AMD"],[3,4,"DSB"]]'))).when(pos % 6 == 3, "").when(pos % 6 == 4, '[[1,3,"EST"]]').otherwise('{"a":1}')
    pairs = F.when(pos % 4 == 1, F.array(F.array(F.lit(5), F.lit(2)))).when(pos % 4 == 2, F.array(F.array(F.lit(9), F.lit(1)), F.array(F.lit(4), F.lit(7)))).otherwise(F.array().cast("array<array<int>>"))
    return P.sequences(spark, sf_dir).filter("seq <> ''").select("ord", "pos", "seq", "cyclization_type", "label", "toxic", "source", bonds.alias("bonds"), F.when(pos % 17 == 0, "C1CC1").otherwise("").alias("smiles"), pairs.alias("pairs"))


@query(_BONDED + """, shown AS (SELECT *, CASE pos % 4 WHEN 1 THEN '((2, 5),)' WHEN 2 THEN '((1, 9), (4, 7))' ELSE '()' END AS t FROM bonded)
SELECT ord, CASE WHEN smiles <> '' THEN 'explicit_smiles:' || substr(sha256('C1CC1'), 1, 16) || ':bonds=' || t WHEN bonds <> '' THEN 'dbaasp_topology:' || substr(sha256(bonds), 1, 16)
  WHEN cyclization_type = 'head_to_tail' THEN 'head_to_tail:1-' || len(seq) WHEN pos % 4 IN (1, 2) THEN cyclization_type || ':residue_bonds=' || t ELSE cyclization_type || ':unspecified' END AS topology FROM shown""")
def topology_label(spark, sf_dir):
    rows = _bonded(spark, sf_dir)
    return rows.select("ord", T.topology_label(F.col("seq"), F.col("cyclization_type"), F.col("smiles"), F.col("pairs"), F.col("bonds")).alias("topology"))


@query(_BONDED + """ SELECT ord, smiles <> '' OR (pos % 6 = 0 AND cyclization_type = 'head_to_tail') OR (pos % 6 = 2 AND cyclization_type = 'head_to_tail') OR (pos % 6 = 1 AND cyclization_type = 'disulfide') OR (pos % 6 = 3 AND cyclization_type = 'head_to_tail') AS legal,
  CASE WHEN smiles <> '' THEN 'explicit_smiles' WHEN pos % 6 = 5 THEN 'invalid_topology' WHEN pos % 6 = 3 THEN 'head_to_tail_without_extra_topology' WHEN pos % 6 IN (0, 2) AND cyclization_type = 'head_to_tail' THEN 'explicit_terminal_amd_and_optional_dsb'
    WHEN pos % 6 = 1 AND cyclization_type = 'disulfide' THEN 'explicit_dsb' ELSE 'unsupported_topology:' || CASE pos % 6 WHEN 0 THEN '[''AMD'']' WHEN 1 THEN '[''DSB'']' WHEN 2 THEN '[''AMD'', ''DSB'']' ELSE '[''EST'']' END END AS reason FROM bonded""")
def legal_structures(spark, sf_dir):
    rows = _bonded(spark, sf_dir).withColumn("x", T.legal_structure(F.col("seq"), F.col("cyclization_type"), F.col("smiles"), F.col("bonds")))
    return rows.select("ord", "x.legal", "x.reason")


@query(_BONDED + """, f AS (SELECT *, CASE pos % 6 WHEN 1 THEN CASE WHEN len(seq) < 5 THEN 'dsb_out_of_range:2-5' WHEN substr(seq, 2, 1) <> 'C' OR substr(seq, 5, 1) <> 'C' THEN 'dsb_endpoint_not_cys:2-5' END
  WHEN 2 THEN CASE WHEN len(seq) < 4 THEN 'dsb_out_of_range:3-4' WHEN substr(seq, 3, 1) <> 'C' OR substr(seq, 4, 1) <> 'C' THEN 'dsb_endpoint_not_cys:3-4' END WHEN 4 THEN 'unsupported_bond_code:EST:1-3' WHEN 5 THEN 'invalid_topology' END AS fault FROM bonded)
SELECT ord, CASE WHEN fault IS NOT NULL THEN fault WHEN cyclization_type = 'head_to_tail' THEN CASE WHEN pos % 6 = 1 THEN 'head_to_missing_or_nonterminal_amd' END
  WHEN cyclization_type = 'disulfide' THEN CASE WHEN pos % 6 <> 1 THEN 'disulfide_requires_pure_dsb_topology' END ELSE 'unsupported_cyclization_type:' || cyclization_type END AS reason FROM f""")
def external_inputs(spark, sf_dir):
    """Why an external folding model cannot take a record."""
    return _bonded(spark, sf_dir).select("ord", T.external_input_reason(F.col("seq"), F.col("cyclization_type"), F.col("bonds")).alias("reason"))


_GATE = """gate AS (SELECT source, count(*) AS total, count(*) FILTER (toxic = 0) AS successful, count(*) FILTER (toxic = 0) / count(*)::DOUBLE AS rate, count(*) FILTER (label IS NULL) AS unlabelled,
  least(count(*) FILTER (toxic = 0 AND label = 0), count(*) FILTER (toxic = 0 AND label = 1)) AS m FROM texts WHERE toxic IS NOT NULL GROUP BY source),
reasons AS (SELECT *, list_filter([CASE WHEN rate < 0.7 THEN 'structure success rate is below 70%' END, CASE WHEN successful < 50 THEN 'successful structure subset has fewer than 50 peptides' END,
  CASE WHEN unlabelled > 0 THEN 'aligned binary labels are unavailable' WHEN m < 15 THEN 'successful structure subset minority class has fewer than 15 peptides' END], lambda x: x IS NOT NULL) AS reasons FROM gate)"""


@query(_GATE + " SELECT source, total, successful, round(rate, 9) AS success_rate, CASE WHEN unlabelled = 0 THEN m END AS minority, len(reasons) = 0 AS formal, CASE WHEN len(reasons) = 0 THEN 'formal' ELSE 'exploratory' END AS status, array_to_string(reasons, '; ') AS reasons FROM reasons")
def structure_gate(spark, sf_dir):
    """Whether the structures of each source are enough; here a text counts as a success if it is not toxic."""
    rows = P.labelled_texts(spark, sf_dir).filter("toxic is not null").select("source", "label", (F.col("toxic") == 0).alias("success"))
    return U.structure_gate(rows, ["source"]).withColumns({"success_rate": F.round("success_rate", 9), "reasons": F.array_join("reasons", "; ")})


@query(_GATE + """, sub AS (SELECT source, count(*) AS n, least(count(*) FILTER (label = 0), count(*) FILTER (label = 1)) AS minority FROM texts WHERE label IS NOT NULL AND doc_id % 2 = 0 GROUP BY source),
own AS (SELECT r.source, coalesce(n, 0) AS n, coalesce(minority, 0) AS minority, r.reasons, list_filter([CASE WHEN coalesce(n, 0) < 50 THEN 'common fusion subset has fewer than 50 peptides' END, CASE WHEN coalesce(minority, 0) < 15 THEN 'common fusion subset minority class has fewer than 15 peptides' END], lambda x: x IS NOT NULL) AS more FROM reasons r LEFT JOIN sub s ON s.source = r.source)
SELECT source, n, minority, len(reasons) = 0 AND len(more) = 0 AS formal, CASE WHEN len(reasons) = 0 AND len(more) = 0 THEN 'formal' ELSE 'exploratory' END AS status, array_to_string(list_concat(reasons, more), '; ') AS reasons FROM own""")
def analysis_status(spark, sf_dir):
    """The structure gate together with that of the aligned subset."""
    texts = P.labelled_texts(spark, sf_dir)
    gate = U.structure_gate(texts.filter("toxic is not null").select("source", "label", (F.col("toxic") == 0).alias("success")), ["source"])
    gate = gate.select("source", "formal", "reasons", F.array(*[F.lit(k) for k in U.KEY_FIELDS]).alias("key_fields"))
    subset = texts.filter("label is not null and doc_id % 2 = 0").select("source", "label")
    return U.analysis_status(gate, subset, ["source"]).withColumn("reasons", F.array_join("reasons", "; "))


def _three(spark, sf_dir):
    first = P.sequences(spark, sf_dir).filter("seq <> '' and cyclization_type <> ''")
    # one row a text, used three times: texts are cut once
    core = first.filter("pos = 0").select(F.col("doc_id").cast("string").alias("peptide_id"), "cyclization_type", F.concat(F.lit("T"), F.length("seq").cast("string")).alias("topology"), F.lit("").alias("join_key"), F.array(F.length("seq").cast("double"), S.net_charge(F.col("seq"))).alias("handcrafted"), "doc_id")
    core = stored(core, "core")
    keys = core.select(F.col("doc_id").alias("vec_id"), T.join_key(F.col("peptide_id"), F.col("cyclization_type"), F.col("topology")).alias("join_key"))
    vectors = P.table(spark, sf_dir, "embeddings").join(keys, "vec_id").select("join_key", "embedding")
    got = core.join(P.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id")), "doc_id", "left_semi")
    structures = got.select("peptide_id", "cyclization_type", F.col("topology").alias("topology_key"), F.when(F.col("doc_id") % 7 == 0, "no").otherwise("Yes").alias("success"), F.array(F.col("doc_id") / 10, F.when(F.col("doc_id") % 11 == 0, F.lit(float("nan"))).otherwise(1.0)).alias("structure"))
    return core, vectors, structures


_THREE = """aligned AS (SELECT d.doc_id, d.doc_id || '|' || cyclization_type || '|T' || len(seq) AS join_key, len(seq) AS n, embedding FROM docs d JOIN embeddings e ON e.vec_id = d.doc_id
  WHERE pos = 0 AND seq <> '' AND cyclization_type <> '' AND d.doc_id % 7 <> 0 AND d.doc_id % 11 <> 0)"""


@query(_THREE + " SELECT join_key, CAST(2 + len(embedding) + 2 AS INTEGER) AS width, n::DOUBLE AS first, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)), 6) AS norm2, doc_id / 10.0::DOUBLE AS descriptor FROM aligned")
def fusion_align3(spark, sf_dir):
    """Sequence, embedding and structure of one verified key, as one fused vector."""
    out = U.feature_set(U.align(*_three(spark, sf_dir)), "m2")
    norm = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    return out.select("join_key", F.size("features").alias("width"), F.get("features", F.lit(0)).alias("first"), F.round(norm, 6).alias("norm2"), F.get("structure", F.lit(0)).alias("descriptor"))


@query(_THREE + ", w AS (SELECT max(len(embedding)) AS e FROM aligned) SELECT unnest(['m0', 'm1', 'm0_m1', 'm2']) AS feature_set, unnest(['2', CAST(e AS VARCHAR), '2,' || e, '2,' || e || ',2']) AS widths FROM w")
def block_widths(spark, sf_dir):
    return U.block_widths(U.align(*_three(spark, sf_dir)))


@query("SELECT ord, doc_id || '|' || cyclization_type || '|' || source AS join_key, CASE WHEN cyclization_type = '' THEN 'requires peptide_id, cyclization_type, and topology' WHEN pos % 5 = 1 THEN 'join_key does not match its identity/type/topology fields' END AS error FROM docs WHERE source IS NOT NULL")
def join_keys(spark, sf_dir):
    """Keys of records, and what is wrong with supplied ones."""
    rows = P.sequences(spark, sf_dir).filter("source is not null")
    key = T.join_key(F.col("doc_id"), F.col("cyclization_type"), F.col("source"))
    given = F.when(F.col("pos") % 5 == 1, "x|y|z").when(F.col("pos") % 5 == 2, key).otherwise("")
    return rows.select("ord", key.alias("join_key"), T.verified_key(F.col("doc_id"), F.col("cyclization_type"), F.col("source"), given)["error"].alias("error"))


@query("""c AS (SELECT doc_id, arg_max(cyclization_type, ord) AS kind, arg_max(raw, ord) AS t FROM docs WHERE doc_id % 2 = 0 GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN c.doc_id IS NULL THEN NULL ELSE 'old' END AS structure_topology, coalesce(c.t, 'old') AS topology, CASE WHEN c.doc_id IS NULL THEN 'k' ELSE d.doc_id || '|' || kind || '|' || t END AS join_key FROM documents d LEFT JOIN c ON c.doc_id = d.doc_id""")
def repaired_keys(spark, sf_dir):
    core = P.sequences(spark, sf_dir).filter("doc_id % 2 = 0").select(F.col("doc_id").alias("peptide_id"), "cyclization_type", F.col("raw").alias("topology_key"), "ord")
    structures = P.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("peptide_id"), F.lit("old").alias("topology"), F.lit("k").alias("join_key"))
    return U.repaired_keys(structures, core).select(F.col("peptide_id").alias("doc_id"), "structure_topology", "topology", "join_key")


@query("""c AS (SELECT doc_id, arg_max(seq, ord) AS sequence, arg_max(label, ord) AS label FROM docs WHERE doc_id % 3 <> 0 GROUP BY doc_id)
SELECT d.doc_id, c.sequence, CASE WHEN c.doc_id IS NULL THEN 'ValueError: peptide_id is absent from cyclic core' END AS failure_reason FROM documents d LEFT JOIN c ON c.doc_id = d.doc_id""")
def manifest_join(spark, sf_dir):
    core = P.sequences(spark, sf_dir).filter("doc_id % 3 <> 0").select(F.col("doc_id").alias("peptide_id"), F.col("seq").alias("sequence"), "label", "cyclization_type", F.lit("t").alias("topology_key"), "ord")
    out = U.manifest_join(P.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("peptide_id")), core)
    return out.select(F.col("peptide_id").alias("doc_id"), "sequence", "failure_reason")


@query("""k AS (SELECT user_id, event_id, CASE WHEN event_type IN ('view', 'click') THEN 'MMFF94s' ELSE 'UFF' END AS ff, value FROM events),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY CASE ff WHEN 'UFF' THEN 1 ELSE 0 END, value, event_id) AS nth FROM k WHERE value IS NOT NULL AND NOT isnan(value) AND NOT isinf(value))
SELECT user_id, event_id AS conformer, ff AS force_field, value AS energy FROM r WHERE nth = 1""")
def lowest_energy(spark, sf_dir):
    """The conformer of least energy; force fields are never mixed."""
    rows = P.table(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("conformer"), F.when(F.col("event_type").isin("view", "click"), "MMFF94s").otherwise("UFF").alias("force_field"), F.col("value").alias("energy"))
    return U.lowest_energy(rows, ["user_id"])


@query("v AS (SELECT list_aggregate(list_transform(embedding, lambda x: x::DOUBLE), 'avg') AS v FROM embeddings) SELECT count(*) AS count, round(avg(v), 6) AS mean, round(min(v), 6) AS min, round(max(v), 6) AS max FROM v")
def plddt_summary(spark, sf_dir):
    rows = P.table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("plddt"))
    out = U.plddt(rows, "vec_id")
    return out.select("count", *[F.round(c, 6).alias(c) for c in ("mean", "min", "max")])


def _hydropathy_sql(letter: str) -> str:
    return "CASE " + letter + " " + " ".join(f"WHEN '{a}' THEN {v!r}::DOUBLE" for a, v in S.HYDROPATHY.items()) + " ELSE 0::DOUBLE END"


@query("""core AS (SELECT ord, CASE WHEN cyclization_type = 'head_to_tail' THEN canonical ELSE seq END AS unit, cyclization_type = 'head_to_tail' AS ring FROM canon WHERE seq <> '' AND role = 'core'),
units AS (SELECT DISTINCT unit, ring FROM core),
turns AS (SELECT DISTINCT unit, ring, CASE WHEN ring THEN substr(unit, CAST(i AS BIGINT) + 1) || substr(unit, 1, CAST(i AS BIGINT)) ELSE unit END AS turn FROM (SELECT unit, ring, unnest(range(0, CASE WHEN ring THEN len(unit) ELSE 1 END)) AS i FROM units) t),
letters AS (SELECT unit, ring, turn, i, len(turn) AS n, """ + _hydropathy_sql("turn[i]") + """ AS v FROM (SELECT *, unnest(range(1, len(turn) + 1)) AS i FROM turns) t),
vectors AS (SELECT unit, ring, turn, avg(v) AS a, avg(v * i) AS b, avg(i / n::DOUBLE) AS c FROM letters GROUP BY ALL),
means AS (SELECT unit, ring, avg(a) AS a, avg(b) AS b, avg(c) AS c FROM vectors GROUP BY ALL)
SELECT ord, round(a + 3e-10, 6) AS a, round(b + 3e-10, 6) AS b, round(c + 3e-10, 6) AS c FROM core JOIN means USING (unit, ring)""")
def rotation_average(spark, sf_dir):
    """Core sequences embedded, rings as the mean over all their rotations. (A tiny shift keeps ties of the last digit from
    depending on the order of sums.)"""
    from sequoria.models.embedding import LetterEmbedder, embed_rows

    rows = P.sequences(spark, sf_dir).filter("seq <> '' and role = 'core'").select("ord", "seq", "cyclization_type")
    out = embed_rows(rows, LetterEmbedder())
    return out.select("ord", *[F.round(F.get("embedding", F.lit(k)) + 3e-10, 6).alias(c) for k, c in enumerate("abc")])


_ATOMS = """atoms AS (SELECT ord, ['N', 'C', 'O', 'SG', 'CA'][(ascii(seq[i]) + i) % 5 + 1] AS atom, [14.007, 12.011, 15.999, 32.06, 12.011][(ascii(seq[i]) + i) % 5 + 1]::DOUBLE AS m, 2.3::DOUBLE * cos(1.745::DOUBLE * i) AS x, 2.3::DOUBLE * sin(1.745::DOUBLE * i) AS y, 1.5::DOUBLE * i + (ascii(seq[i]) % 7) / 10.0::DOUBLE AS z
  FROM (SELECT ord, seq, unnest(range(1, len(seq) + 1)) AS i FROM docs WHERE role = 'core') t)"""


def _moments_sql(weight: str, prefix: str) -> str:
    mean = lambda *c: f"(sum({weight} * {' * '.join(c)}) / sum({weight}))"
    return ", ".join(f"{mean(p, q)} - {mean(p)} * {mean(q)} AS {prefix}{p}{q}" for p, q in ("xx", "yy", "zz", "xy", "xz", "yz"))


def _roots_sql(prefix: str, out: str) -> str:
    """The roots of the characteristic cubic: as cosines of a third of the angle."""
    a, b, c, d, e, f = (f"{prefix}{p}" for p in ("xx", "yy", "zz", "xy", "xz", "yz"))
    q = f"(({a} + {b} + {c}) / 3)"
    p = f"sqrt((pow({a} - {q}, 2) + pow({b} - {q}, 2) + pow({c} - {q}, 2) + 2 * ({d} * {d} + {e} * {e} + {f} * {f})) / 6)"
    det = f"(({a} - {q}) * (({b} - {q}) * ({c} - {q}) - {f} * {f}) - {d} * ({d} * ({c} - {q}) - {f} * {e}) + {e} * ({d} * {f} - ({b} - {q}) * {e}))"
    angle = f"acos(greatest(-1, least(1, CASE WHEN {p} > 0 THEN {det} / (2 * pow({p}, 3)) ELSE 1 END))) / 3"
    return f"greatest(0, {q} + 2 * {p} * cos({angle})) AS {out}3, greatest(0, {q} + 2 * {p} * cos({angle} + 2 * pi() / 3)) AS {out}1, {q} * 3 AS {out}t"


@query(_ATOMS + f""", near AS (SELECT a.ord, m, x - x0 AS x, y - y0 AS y, z - z0 AS z FROM atoms a JOIN (SELECT ord, min(x) AS x0, min(y) AS y0, min(z) AS z0 FROM atoms GROUP BY ord) o ON o.ord = a.ord),
sums AS (SELECT ord, {_moments_sql("m", "m")}, {_moments_sql("1", "g")} FROM near GROUP BY ord),
roots AS (SELECT ord, {_roots_sql("m", "l")}, {_roots_sql("g", "g")} FROM sums),
i AS (SELECT ord, sqrt(lt) AS radius, greatest(0, lt - l3) AS i1, greatest(0, l1 + l3) AS i2, greatest(0, lt - l1) AS i3, CASE WHEN gt > 1e-12 THEN 3 * g1 / gt ELSE 0 END AS spherocity FROM roots),
wide AS (SELECT a.ord, max(sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2) + pow(a.z - b.z, 2))) AS d FROM atoms a JOIN atoms b ON a.ord = b.ord GROUP BY a.ord)
SELECT ord, round(radius, 4) AS radius, round(CASE WHEN i3 > 1e-9 THEN (pow(i3 - i2, 2) + pow(i3 - i1, 2) + pow(i2 - i1, 2)) / 2 / (i1 * i1 + i2 * i2 + i3 * i3) ELSE 0 END, 4) AS asphericity, round(CASE WHEN i3 > 1e-9 THEN sqrt(greatest(0, i3 * i3 - i1 * i1)) / i3 ELSE 0 END, 4) AS eccentricity,
  round(spherocity, 4) AS spherocity, round(CASE WHEN i3 > 1e-9 THEN i1 / i3 ELSE 0 END, 4) AS ratio1, round(CASE WHEN i3 > 1e-9 THEN i2 / i3 ELSE 0 END, 4) AS ratio2, round(d, 4) AS widest FROM i JOIN wide USING (ord)""")
def shape_descriptors(spark, sf_dir):
    """Shape of core sequences laid out along a helix, an atom a letter."""
    from sequoria.operators import shape


    def atom(letter, at):
        code, i = F.ascii(letter), at + 1
        return F.struct(P._pick(code + i, "N", "C", "O", "SG", "CA").alias("atom"), (F.cos(i * 1.745) * 2.3).alias("x"), (F.sin(i * 1.745) * 2.3).alias("y"), (i * 1.5 + code % 7 / 10.0).alias("z"))

    rows = P.sequences(spark, sf_dir).filter("role = 'core' and seq <> ''")
    out = shape.described(rows.select("ord", F.transform(F.split("seq", ""), atom).alias("atoms")), "ord")
    return out.select("ord", *[F.round(c, 4).alias(a) for c, a in zip(shape.DESCRIPTORS, ("radius", "asphericity", "eccentricity", "spherocity", "ratio1", "ratio2", "widest"), strict=True)])


@query("SELECT ord, CAST(CASE WHEN pos % 3 = 0 THEN 2 + pos % 4 WHEN pos % 5 = 0 THEN CASE WHEN pos % 2 = 0 THEN 2 ELSE 0 END WHEN pos % 5 IN (1, 2) THEN 1 ELSE 0 END AS INTEGER) AS bonds FROM docs")
def bond_counts(spark, sf_dir):
    """Numbers of bonds as given, or from the bond list of the topology; what is no list counts as one."""
    pos = F.col("pos")
    given = F.when(pos % 3 == 0, F.concat(F.lit(" "), (2 + pos % 4).cast("string"))).otherwise("")
    topology = F.when(pos % 5 == 0, F.when(pos % 2 == 0, '[[1,4],[2,9,"DSB"]]').otherwise("[]")).when(pos % 5 == 1, "disulfide:2-5").when(pos % 5 == 2, "[[1,").otherwise("")
    return P.sequences(spark, sf_dir).select("ord", S.bond_count(given, topology).alias("bonds"))


_TURNS = "turned AS (SELECT ord, label, cyclization_type, CASE WHEN cyclization_type = 'head_to_tail' THEN {0} ELSE [seq] END AS turns FROM canon WHERE seq <> '' AND role = 'core')"


@query(_TURNS.format("list_distinct(list_transform(range(0, least(4, len(seq))), lambda i: turns[CAST(i * len(seq) // least(4, len(seq)) AS BIGINT) + 1]))") + " SELECT ord, label, unnest(turns) AS seq FROM turned")
def augment_training(spark, sf_dir):
    rows = P.sequences(spark, sf_dir).filter("seq <> '' and role = 'core'").select("ord", "label", "seq", "cyclization_type")
    return L.augmented(rows).select("ord", "label", "seq")


@query(_TURNS.format("list_distinct(turns)") + " SELECT ord AS sample, unnest(turns) AS seq FROM turned")
def expand_evaluation(spark, sf_dir):
    rows = P.sequences(spark, sf_dir).filter("seq <> '' and role = 'core'").select("ord", "seq", "cyclization_type")
    return L.expanded(rows, "ord").select("sample", "seq")


@query("SELECT source, CAST(max(label) AS INTEGER) AS label, CASE WHEN avg(score) > avg(1 - score) THEN 1 ELSE 0 END AS predicted FROM scored GROUP BY source")
def grouped_logits(spark, sf_dir):
    rows = P.scores(spark, sf_dir).select("source", "label", (1 - F.col("score")).alias("logit0"), F.col("score").alias("logit1"))
    return L.grouped_logits(rows, "source").withColumn("label", F.col("label").cast("int"))


_KM = "list_distinct(list_transform(range(0, greatest(len({0}) - 2, 1)), lambda i: substr({0}, CAST(i AS BIGINT) + 1, 3)))"
_NEAR = f"""
pool AS (SELECT DISTINCT seq, canonical, len(seq) AS n, {_KM.format('seq')} AS kmers FROM canon WHERE role = 'pretrain' AND len(seq) >= 5),
ev AS (SELECT DISTINCT seq, canonical, cyclization_type AS kind, len(seq) AS m FROM canon WHERE role = 'core' AND len(seq) >= 5 AND pos % 3 = 0 AND cyclization_type <> ''),
evk AS (SELECT row_number() OVER () AS id, m, {_KM.format('ring')} AS kmers FROM (SELECT *, CASE WHEN kind = 'head_to_tail' THEN seq || substr(seq, 1, 2) ELSE seq END AS ring FROM ev) t),
a AS (SELECT seq, n, len(kmers) AS p, unnest(kmers) AS kmer FROM pool), b AS (SELECT id, m, len(kmers) AS q, unnest(kmers) AS kmer FROM evk),
near AS (SELECT DISTINCT seq FROM (SELECT a.seq, b.id, any_value(p) AS p, any_value(q) AS q, count(*) AS c FROM a JOIN b ON a.kmer = b.kmer AND p * 0.8::DOUBLE <= q AND q * 0.8::DOUBLE <= p AND abs(n - m) <= greatest(n, m) * 0.5::DOUBLE GROUP BY a.seq, b.id) t WHERE c / (p + q - c)::DOUBLE >= 0.8),
hit AS (SELECT seq FROM near UNION SELECT seq FROM pool WHERE seq IN (SELECT seq FROM ev) UNION SELECT seq FROM pool WHERE canonical IN (SELECT canonical FROM ev WHERE kind = 'head_to_tail'))
"""


def _evaluation(rows):
    return rows.filter("role = 'core' and length(seq) >= 5 and pos % 3 = 0 and cyclization_type <> ''")


@query(_NEAR + " SELECT ord, CASE WHEN h.seq IS NOT NULL THEN 'near_duplicate_with_cyclic_validation_or_test' END AS exclusion_reason, CASE WHEN h.seq IS NOT NULL THEN CASE WHEN pos % 10 = 0 THEN 'validation' ELSE 'train' END END AS excluded_partition FROM canon c LEFT JOIN hit h ON h.seq = c.seq WHERE role = 'pretrain' AND len(c.seq) >= 5")
def near_eval_filter(spark, sf_dir):
    """Pretraining rows that are too near to evaluation rows."""
    rows = stored(P.sequences(spark, sf_dir).select("ord", "pos", "seq", "role", "cyclization_type"), "sequences")
    pretrain = rows.filter("role = 'pretrain' and length(seq) >= 5").select("ord", "seq", F.when(F.col("pos") % 10 == 0, "validation").otherwise("train").alias("split"))
    return L.filtered(pretrain, _evaluation(rows).select("seq", "cyclization_type")).select("ord", "exclusion_reason", "excluded_partition")


_APART = """rows_ AS (SELECT CASE pos % 3 WHEN 0 THEN 'train' WHEN 1 THEN 'validation' ELSE 'test' END AS split, lang || (doc_id % 50) AS grp, cyclization_type || ':' || CASE WHEN cyclization_type = 'head_to_tail' THEN canonical ELSE seq END AS ident FROM canon WHERE seq <> '' AND cyclization_type <> ''),
long AS (SELECT split, 'group' AS kind, grp AS value FROM rows_ UNION ALL SELECT split, 'identity', ident FROM rows_)"""


@query(_APART + " SELECT kind, value, string_agg(DISTINCT split, ',' ORDER BY split) AS splits FROM long GROUP BY kind, value HAVING count(DISTINCT split) > 1")
def split_validation(spark, sf_dir):
    """Groups and identities that stand in more than one split."""
    rows = P.sequences(spark, sf_dir).filter("seq <> '' and cyclization_type <> ''")
    split = F.get(F.array(F.lit("train"), F.lit("validation"), F.lit("test")), F.col("pos") % 3)
    return L.violations(rows.select(split.alias("split"), F.concat("lang", (F.col("doc_id") % 50).cast("string")).alias("group"), "seq", "cyclization_type"))


@query("SELECT ord, cyclization_type || ':' || CASE WHEN cyclization_type = 'head_to_tail' THEN canonical ELSE seq END AS identity FROM canon WHERE seq <> ''")
def topology_identity(spark, sf_dir):
    rows = P.sequences(spark, sf_dir).filter("seq <> ''")
    return sealed(rows, "ord", L.identity(F.col("seq"), F.col("cyclization_type")).alias("identity"))
