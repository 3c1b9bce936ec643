"""Alignment of sequence, embedding and structure blocks by a verified key, feature blocks, and the gates before them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sequoria.functions import topology as T
from sequoria.sources.readers import bond_lengths

BLOCKS = {"m0": ("handcrafted",), "m1": ("embedding",), "m0_m1": ("handcrafted", "embedding"), "m2": ("handcrafted", "embedding", "structure")}
KEY_FIELDS = ("peptide_id", "cyclization_type", "topology")


def finite(vector: Column) -> Column:
    """Whether a vector has parts and all of them are numbers."""
    return F.coalesce((F.size(vector) > 0) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def _fail(message: str, *more: Column) -> Column:
    return F.raise_error(F.concat(F.lit(message), *[F.coalesce(c.cast("string"), F.lit("null")) for c in more]))


def keyed(rows: DataFrame, source: str) -> DataFrame:
    """rows (peptide_id, cyclization_type, topology or topology_key, join_key) with their verified join_key; a missing
    field or a supplied key that differs is an error when the row is read."""
    blank = F.lit(None).cast("string")
    col = lambda c: F.col(c) if c in rows.columns else blank
    made = T.verified_key(F.col("peptide_id"), F.col("cyclization_type"), T.first_filled(col("topology"), col("topology_key")), col("join_key"))
    return rows.withColumn("_key", made).withColumn("join_key", F.when(F.col("_key.error").isNull(), F.col("_key.key")).otherwise(_fail(f"{source} record: ", F.col("_key.error")).cast("string"))).drop("_key")


def unique(rows: DataFrame, what: str) -> DataFrame:
    """rows of which two have one join_key are an error; silently picking one is not."""
    n = rows.groupBy("join_key").agg(F.count("*").alias("_n"))
    return rows.join(n, "join_key").withColumn("join_key", F.when(F.col("_n") == 1, F.col("join_key")).otherwise(_fail(f"duplicate {what}: ", F.col("join_key")).cast("string"))).drop("_n")


def align(core: DataFrame, embeddings: DataFrame, structures: DataFrame) -> DataFrame:
    """Rows of core that have all three blocks: core (peptide_id, cyclization_type, topology, handcrafted, ...) with
    embedding and structure. embeddings: join_key, embedding; structures: the three fields, success, structure.

    Structures that failed or have missing or non-finite descriptors are left out; a core row whose embedding is
    missing, empty or not finite is an error if its structure is there, as are repeated keys on either side.
    """
    good = keyed(structures.filter(T.truthy(F.coalesce(F.col("success").cast("string"), F.lit("true")))), "structure").filter(finite(F.col("structure")))
    good = unique(good.select("join_key", "structure"), "successful structure record")
    own = unique(keyed(core, "core"), "fusion join key in core data")
    out = own.join(good, "join_key").join(embeddings.select("join_key", "embedding"), "join_key", "left")
    return out.withColumn("embedding", F.when(finite(F.col("embedding")), F.col("embedding")).otherwise(_fail("non-finite or empty embedding for ", F.col("join_key")).cast("array<float>")))


def feature_set(rows: DataFrame, name: str, into: str = "features") -> DataFrame:
    """rows with the blocks of a feature set joined to one array of doubles."""
    if name not in BLOCKS:
        raise ValueError(f"unknown feature set: {name}")
    return rows.withColumn(into, F.concat(*[F.col(b).cast("array<double>") for b in BLOCKS[name]]))


def block_widths(rows: DataFrame) -> DataFrame:
    """(feature_set, widths): widths of the blocks of each feature set, as text; rows of differing widths are an error."""
    each = [F.max(F.size(b)).alias(b) for b in ("handcrafted", "embedding", "structure")] + [F.min(F.size(b)).alias(f"{b}_min") for b in ("handcrafted", "embedding", "structure")]
    out = rows.agg(*each)
    width = lambda b: F.when(F.col(b) == F.col(f"{b}_min"), F.col(b)).otherwise(_fail("rows of differing widths in ", F.lit(b)).cast("int"))
    return out.select(F.inline(F.array(*[F.struct(F.lit(k).alias("feature_set"), F.array_join(F.array(*[width(b).cast("string") for b in v]), ",").alias("widths")) for k, v in BLOCKS.items()])))


def structure_gate(results: DataFrame, by: list[str]) -> DataFrame:
    """(by, total, successful, success_rate, minority, formal, status, reasons): whether the structures are enough for a
    formal analysis. results: success, label; label may be null, which makes the gate fail."""
    good = F.col("success")
    out = results.groupBy(*by).agg(F.count("*").alias("total"), F.count_if(good).alias("successful"), F.count_if(F.col("label").isNull()).alias("_unlabelled"), F.least(F.count_if(good & (F.col("label") == 0)), F.count_if(good & (F.col("label") == 1))).alias("minority"))
    rate = F.coalesce(F.try_divide("successful", "total"), F.lit(0.0))
    reasons = F.array(
        F.when(rate < 0.70, "structure success rate is below 70%"),
        F.when(F.col("successful") < 50, "successful structure subset has fewer than 50 peptides"),
        F.when(F.col("_unlabelled") > 0, "aligned binary labels are unavailable").when(F.col("minority") < 15, "successful structure subset minority class has fewer than 15 peptides"),
    )
    out = out.withColumn("reasons", F.filter(reasons, lambda x: x.isNotNull())).withColumn("minority", F.when(F.col("_unlabelled") == 0, F.col("minority")))
    return out.select(*by, "total", "successful", rate.alias("success_rate"), "minority", (F.size("reasons") == 0).alias("formal"), F.when(F.size("reasons") == 0, "formal").otherwise("exploratory").alias("status"), "reasons")


def analysis_status(gate: DataFrame, subset: DataFrame, by: list[str]) -> DataFrame:
    """The gate of the structures together with that of the aligned subset (label): formal only if both are.
    gate: formal, reasons, key_fields; a gate made for other key fields is an error."""
    sizes = subset.groupBy(*by).agg(F.count("*").alias("n"), F.least(F.count_if(F.col("label") == 0), F.count_if(F.col("label") == 1)).alias("minority"))
    out = gate.join(sizes, by, "left").fillna(0, ["n", "minority"])
    own = F.filter(F.array(F.when(F.col("n") < 50, "common fusion subset has fewer than 50 peptides"), F.when(F.col("minority") < 15, "common fusion subset minority class has fewer than 15 peptides")), lambda x: x.isNotNull())
    fields = F.when(F.array_join("key_fields", ",") == ",".join(KEY_FIELDS), F.lit(True)).otherwise(_fail("structure QC join-key contract is missing or incompatible").cast("boolean"))
    allowed = fields & F.col("formal") & (F.size(own) == 0)
    return out.select(*by, "n", "minority", allowed.alias("formal"), F.when(allowed, "formal").otherwise("exploratory").alias("status"), F.concat("reasons", own).alias("reasons"))


def repaired_keys(structures: DataFrame, core: DataFrame) -> DataFrame:
    """structures with topology and join_key taken from the core row of their peptide_id, the old topology kept as
    structure_topology; rows without one stay as they are. Of several core rows the last by ord counts."""
    last = core.groupBy("peptide_id").agg(F.max_by(F.struct("cyclization_type", "topology_key"), "ord").alias("_core"))
    out = structures.join(last, "peptide_id", "left")
    met = F.col("_core").isNotNull()
    topology = F.coalesce(F.col("_core.topology_key"), F.col("topology"))
    key = T.join_key(F.col("peptide_id"), F.col("_core.cyclization_type"), topology)
    return out.withColumns({"structure_topology": F.when(met, F.col("topology")), "join_key": F.when(met, key).otherwise(F.col("join_key")), "topology": F.when(met, topology).otherwise(F.col("topology"))}).drop("_core")


def lowest_energy(conformers: DataFrame, by: list[str]) -> DataFrame:
    """(by, conformer, force_field, energy): the conformer of least energy; MMFF results are never mixed with UFF ones,
    which count only where there is none; energies that are not finite count never."""
    sound = conformers.filter("energy is not null and not isnan(energy) and abs(energy) < double('infinity')")
    rank = F.when(F.col("force_field").startswith("MMFF"), 0).otherwise(1)
    return sound.groupBy(*by).agg(F.min_by(F.struct("conformer", "force_field", "energy"), F.struct(rank, "energy", "conformer")).alias("x")).select(*by, "x.*")


def manifest_join(manifest: DataFrame, core: DataFrame) -> DataFrame:
    """manifest (peptide_id, ...) with sequence, label, cyclization_type and topology_key of its core row; a miss is a
    failure record with its reason, not a lost row."""
    own = core.groupBy("peptide_id").agg(F.max_by(F.struct("sequence", "label", "cyclization_type", "topology_key"), "ord").alias("_core"))
    out = manifest.join(own, "peptide_id", "left")
    return out.select(*manifest.columns, "_core.*", F.when(F.col("_core").isNull(), "ValueError: peptide_id is absent from cyclic core").alias("failure_reason"))


def plddt(scores: DataFrame, by: str) -> DataFrame:
    """(count, mean, min, max) of the mean confidence of each model. scores: by, plddt (array); a model without finite
    values has none."""
    each = scores.filter(finite(F.col("plddt"))).select(by, (F.aggregate("plddt", F.lit(0.0), lambda s, x: s + x) / F.size("plddt")).alias("v"))
    return each.agg(F.count("*").alias("count"), F.avg("v").alias("mean"), F.min("v").alias("min"), F.max("v").alias("max"))


def zipped(rows: DataFrame, more: DataFrame, order: str = "ord") -> DataFrame:
    """rows with the columns of more by position: place `order` of one is that of the other. A place that only one has
    is an error, as is a place that occurs twice."""
    left, right = rows.withColumn("_l", F.lit(1)), more.withColumn("_r", F.lit(1))
    out = left.join(right, order, "full").withColumn("_n", F.count("*").over(Window.partitionBy(order)))
    fine = F.col("_l").isNotNull() & F.col("_r").isNotNull() & (F.col("_n") == 1)
    return out.withColumn(order, F.when(fine, F.col(order)).otherwise(_fail("no single pair of rows at place ", F.col(order)).cast(rows.schema[order].dataType))).drop("_l", "_r", "_n")


#: Distances in Angstrom between which a disulfide bond and the closing bond of a ring are real.
DISULFIDE, CLOSURE = (1.8, 2.5), (1.2, 1.6)


def geometry_faults(items: DataFrame, atoms: DataFrame) -> DataFrame:
    """(file, faults): what of the bonds of items (file, disulfide_pairs_flat: one-based residues, flag_cyclic) the atoms
    (file, atom, residue, x, y, z) do not show: an odd count, a missing atom, a distance out of its bounds."""
    numbers = F.transform(F.filter(F.split(F.trim(F.coalesce("disulfide_pairs_flat", F.lit(""))), r"\s+"), lambda x: x != ""), lambda x: x.try_cast("int"))
    each = items.select("file", "flag_cyclic", numbers.alias("at"))
    sound = (F.size("at") % 2 == 0) & F.forall("at", lambda x: x.isNotNull())
    bridges = each.filter(sound & (F.size("at") > 0)).select("file", F.explode(F.transform(F.sequence(F.lit(0), F.size("at") - 2, F.lit(2)), lambda i: F.struct(F.get("at", i).alias("a"), F.get("at", i + 1).alias("b")))).alias("p"))
    bridges = bridges.select("file", F.lit("SG").alias("atom_a"), F.col("p.a").alias("residue_a"), F.lit("SG").alias("atom_b"), F.col("p.b").alias("residue_b"), F.lit("disulfide").alias("bond"))
    ends = atoms.groupBy("file").agg(F.min("residue").alias("residue_a"), F.max("residue").alias("residue_b"))
    rings = each.filter(F.col("flag_cyclic").cast("string") == "1").select("file").join(ends, "file", "left").select("file", F.lit("N").alias("atom_a"), "residue_a", F.lit("C").alias("atom_b"), "residue_b", F.lit("closure").alias("bond"))
    measured = bond_lengths(atoms, bridges.unionByName(rings))
    low, high = (F.when(F.col("bond") == "disulfide", DISULFIDE[k]).otherwise(CLOSURE[k]) for k in (0, 1))
    place = F.concat(F.col("bond"), F.lit(" "), F.coalesce(F.col("residue_a").cast("string"), F.lit("?")), F.lit("-"), F.coalesce(F.col("residue_b").cast("string"), F.lit("?")))
    wrong = F.when(F.col("distance").isNull(), F.concat(place, F.lit(": atom missing"))).when(~F.col("distance").between(low, high), F.concat(place, F.format_string(": %.2f A", "distance")))
    found = measured.withColumn("wrong", wrong).filter("wrong is not null").groupBy("file").agg(F.array_sort(F.collect_list("wrong")).alias("wrong"))
    odd = F.when(sound, F.array().cast("array<string>")).otherwise(F.array(F.lit("odd or invalid residue list")))
    return each.join(found, "file", "left").select("file", F.concat(odd, F.coalesce("wrong", F.array().cast("array<string>"))).alias("faults"))
