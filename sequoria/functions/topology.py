"""Column functions on bond topology: normal forms, labels, keys, checks. Bonds come as JSON text and are read as variants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import sequence as S

STRINGS = "array<string>"


def first_filled(*columns: Column) -> Column:
    """The first that is neither null nor empty."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in columns])


def truthy(raw: Column) -> Column:
    return F.coalesce(F.lower(F.trim(raw.cast("string"))).isin("1", "true", "yes", "y"), F.lit(False))


def file_id(raw: Column) -> Column:
    """Letters, digits, - and _ as they are, all else as _."""
    return F.regexp_replace(raw, r"(?U)[^\p{L}\p{N}_-]", "_")


def _part(item: Column, path: str) -> Column:
    return F.coalesce(F.to_json(F.try_variant_get(item, path, "variant")), F.lit("null"))


def _named(item: Column, field: str) -> Column:
    """The name in a field that is an object, the field itself if it is text, else ''."""
    return F.coalesce(F.try_variant_get(item, f"$.{field}.name", "string"), F.when(F.schema_of_variant(F.try_variant_get(item, f"$.{field}", "variant")) == "STRING", F.try_variant_get(item, f"$.{field}", "string")), F.lit(""))


def _quoted(text: Column) -> Column:
    return F.concat(F.lit('"'), F.regexp_replace(text, r'(["\\])', r"\\$1"), F.lit('"'))


def _shown(json: Column) -> Column:
    """How an element is written for sorting: text in single quotes, null as None."""
    return F.when(json.startswith('"'), F.concat(F.lit("'"), F.substring(json, F.lit(2), F.length(json) - 2), F.lit("'"))).when(json == "null", "None").otherwise(json)


def _record(left: Column, right: Column, names: list[Column]) -> Column:
    shown = [F.concat(F.lit("'"), n, F.lit("'")) for n in names]
    return F.struct(
        F.concat(F.lit("("), F.concat_ws(", ", _shown(left), _shown(right), *shown), F.lit(")")).alias("at"),
        F.concat(F.lit("["), F.concat_ws(",", left, right, *[_quoted(n) for n in names]), F.lit("]")).alias("json"),
    )


def _bond_record(item: Column) -> Column:
    """Normal form of one bond: an object has position1, position2 and names of type, cycleType and chainParticipating;
    of a list the first two elements count; shorter lists and other elements are null."""
    kind, blank = F.schema_of_variant(item), F.lit("")
    listed = kind.startswith("ARRAY") & F.try_variant_get(item, "$[1]", "variant").isNotNull()
    return F.when(kind.startswith("OBJECT"), _record(_part(item, "$.position1"), _part(item, "$.position2"), [_named(item, f) for f in ("type", "cycleType", "chainParticipating")])).when(listed, _record(_part(item, "$[0]"), _part(item, "$[1]"), [blank, blank, blank]))


def with_topology_key(df: DataFrame, cyclization: Column, length: Column, bonds: str, topology: Column, name: str) -> DataFrame:
    """df with a struct(key, reason) `name` in place of the JSON text `bonds`. key: the sorted bonds as compact JSON. A
    head-to-tail ring without bonds has its terminal one; any other type needs bonds or an explicit topology, which is
    never invented. Text that is not a JSON list or object is invalid. Each step is a column, so that text is parsed once."""
    df = df.withColumn("_v", F.try_parse_json(bonds)).withColumn("_k", F.schema_of_variant("_v"))
    df = df.withColumn("_items", F.when(F.col("_k").startswith("OBJECT"), F.array("_v")).when(F.col("_k").startswith("ARRAY"), F.try_variant_get("_v", "$", "array<variant>")))
    none = F.array().cast("array<struct<at:string,json:string>>")
    df = df.withColumn("_records", F.when(F.col(bonds).isNull(), none).otherwise(F.array_sort(F.filter(F.transform("_items", _bond_record), lambda r: r.isNotNull()))))
    named = F.nullif(F.trim(F.coalesce(topology, F.lit(""))), F.lit(""))
    ring = F.concat(F.lit("[1,"), length.cast("string"), F.lit(',"amide","head_to_tail","mainchain-mainchain"]'))
    body = F.when(F.size("_records") > 0, F.array_join(F.transform("_records", lambda r: r["json"]), ",")).when(cyclization == "head_to_tail", ring).otherwise(F.concat(F.lit('["topology",'), _quoted(named), F.lit(',"","",""]')))
    df = df.withColumn("_body", F.when(F.col("_records").isNotNull(), body))
    reason = F.when(F.col("_records").isNull(), "invalid_intrachain_bond_topology").when(F.col("_body").isNull(), "missing_topology_for_non_head_cyclization")
    return df.withColumn(name, F.struct(F.concat(F.lit("["), F.col("_body"), F.lit("]")).alias("key"), reason.alias("reason"))).drop(bonds, "_v", "_k", "_items", "_records", "_body")


def normalized_pairs(pairs: Column) -> Column:
    """array<array<int>> of two residues each, the lesser first, sorted."""
    return F.array_sort(F.transform(pairs, lambda p: F.array(F.array_min(p), F.array_max(p))))


def pairs_in_range(pairs: Column, length: Column) -> Column:
    """Whether every pair has two distinct residues from 1 to length; true for no pair."""
    return F.forall(F.coalesce(pairs, F.array().cast("array<array<int>>")), lambda p: (F.size(p) == 2) & (F.get(p, F.lit(0)) != F.get(p, F.lit(1))) & (F.array_min(p) >= 1) & (F.array_max(p) <= length))


def parse_pairs(text: Column) -> Column:
    """`1-6,2:5` (full-width signs too) as array<array<int>>; null if any item is not two whole numbers."""
    plain = F.translate(F.coalesce(text, F.lit("")), "，－—-", ",:::")
    items = F.filter(F.transform(F.split(plain, ","), lambda x: F.trim(x)), lambda x: x != "")
    good = F.forall(items, lambda x: x.rlike(r"^\s*\d+\s*:\s*\d+\s*\z"))
    return F.when(good, F.transform(items, lambda x: F.transform(F.split(x, ":"), lambda n: F.trim(n).try_cast("int"))))


def _pair_text(pairs: Column) -> Column:
    """Pairs as a tuple of tuples is written; one has a comma behind it."""
    each = F.transform(pairs, lambda p: F.concat(F.lit("("), F.array_join(p.cast(STRINGS), ", "), F.lit(")")))
    return F.concat(F.lit("("), F.array_join(each, ", "), F.when(F.size(pairs) == 1, ",").otherwise(""), F.lit(")"))


def topology_label(seq: Column, cyclization: Column, smiles: Column, pairs: Column, bonds_json: Column) -> Column:
    """What the structure is built from: digest of an explicit SMILES, else of declared bonds (a JSON list of lists of
    three and more), else the terminal bond of a head-to-tail ring, else the residue bonds, else unspecified."""
    kind = S.cyclization_type(cyclization)
    shown = normalized_pairs(F.coalesce(pairs, F.array().cast("array<array<int>>")))
    text = F.to_json(F.try_parse_json(bonds_json))
    return (
        F.when(F.coalesce(smiles, F.lit("")) != "", F.concat(F.lit("explicit_smiles:"), F.substring(F.sha2(F.trim(smiles), 256), 1, 16), F.lit(":bonds="), _pair_text(shown)))
        .when(text.isNotNull() & (text != "[]"), F.concat(F.lit("dbaasp_topology:"), F.substring(F.sha2(text, 256), 1, 16)))
        .when(kind == "head_to_tail", F.concat(F.lit("head_to_tail:1-"), F.length(seq).cast("string")))
        .when(F.size(pairs) > 0, F.concat(kind, F.lit(":residue_bonds="), _pair_text(shown)))
        .otherwise(F.concat(kind, F.lit(":unspecified")))
    )


def join_key(identity: Column, cyclization: Column, topology: Column) -> Column:
    """identity|type|topology; null if one of them is."""
    return F.concat(identity.cast("string"), F.lit("|"), S.cyclization_type(cyclization), F.lit("|"), topology)


def verified_key(identity: Column, cyclization: Column, topology: Column, supplied: Column) -> Column:
    """struct(key, error): the key of three filled fields; a supplied key must equal it."""
    filled = (first_filled(F.trim(identity.cast("string"))).isNotNull()) & (first_filled(F.trim(cyclization)).isNotNull()) & (first_filled(F.trim(topology)).isNotNull())
    key = join_key(F.trim(identity.cast("string")), cyclization, F.trim(topology))
    given = first_filled(F.trim(supplied))
    error = F.when(~F.coalesce(filled, F.lit(False)), "requires peptide_id, cyclization_type, and topology").when(given.isNotNull() & (given != key), "join_key does not match its identity/type/topology fields")
    return F.struct(F.when(error.isNull(), key).alias("key"), error.alias("error"))


def bond_list(json: Column) -> Column:
    """A JSON list of bonds as array<struct(left, right, code)>; null for text that is not a list; elements that are
    not lists of three are null."""
    value = F.try_parse_json(json)
    items = F.when(F.schema_of_variant(value).startswith("ARRAY"), F.try_variant_get(value, "$", "array<variant>"))
    part = lambda b, k, kind: F.try_variant_get(b, f"$[{k}]", kind)
    return F.transform(items, lambda b: F.when(part(b, 2, "string").isNotNull(), F.struct(part(b, 0, "int").alias("left"), part(b, 1, "int").alias("right"), F.upper(part(b, 2, "string")).alias("code"))))


def valid_bonds(json: Column) -> Column:
    """Whether every bond has a left residue of 0 or more, a right one of 1 or more, both distinct, and a code."""
    return F.coalesce(F.forall(bond_list(json), lambda b: F.coalesce(b.isNotNull() & (b["left"] >= 0) & (b["right"] >= 1) & (b["left"] != b["right"]), F.lit(False))), F.lit(False))


def _terminal(b: Column, n: Column) -> Column:
    return (F.least(b["left"], b["right"]) == 1) & (F.greatest(b["left"], b["right"]) == n)


def legal_structure(seq: Column, cyclization: Column, smiles: Column, bonds_json: Column) -> Column:
    """struct(legal, reason): whether a structure may be built from what is explicit, and from what or why not."""
    kind = F.replace(F.lower(F.trim(F.coalesce(cyclization, F.lit("")))), F.lit("-"), F.lit("_"))
    given = first_filled(F.trim(bonds_json)).isNotNull()
    bonds = F.when(given, bond_list(bonds_json)).otherwise(F.array().cast("array<struct<left:int,right:int,code:string>>"))
    broken = bonds.isNull() | F.exists(bonds, lambda b: b.isNull())
    codes = F.array_sort(F.array_distinct(F.transform(bonds, lambda b: b["code"])))
    amide = F.filter(bonds, lambda b: b["code"] == "AMD")
    ring = (kind == "head_to_tail") & F.forall(codes, lambda c: c.isin("AMD", "DSB")) & (F.size(amide) == 1) & F.forall(amide, lambda b: _terminal(b, F.length(seq)))
    made = lambda ok, why: F.struct(ok.alias("legal"), why.alias("reason"))
    yes, no = F.lit(True), F.lit(False)
    return (
        F.when(F.coalesce(F.trim(smiles), F.lit("")) != "", made(yes, F.lit("explicit_smiles")))
        .when(broken, made(no, F.lit("invalid_topology")))
        .when(F.size(bonds) == 0, made(kind == "head_to_tail", F.lit("head_to_tail_without_extra_topology")))
        .when(ring, made(yes, F.lit("explicit_terminal_amd_and_optional_dsb")))
        .when((kind == "disulfide") & (F.array_join(codes, ",") == "DSB"), made(yes, F.lit("explicit_dsb")))
        .otherwise(made(no, F.concat(F.lit("unsupported_topology:["), F.array_join(F.transform(codes, lambda c: F.concat(F.lit("'"), c, F.lit("'"))), ", "), F.lit("]"))))
    )


def external_input_reason(seq: Column, cyclization: Column, bonds_json: Column) -> Column:
    """Why an external folding model cannot take a record; null if it can. The first bond that fails decides, then the
    rules of the type: an AMD bond from end to end for a ring (or no bond), DSB bonds only for a disulfide."""
    n = F.length(seq)
    given = first_filled(F.trim(bonds_json)).isNotNull()
    bonds = F.when(given, bond_list(bonds_json)).otherwise(F.array().cast("array<struct<left:int,right:int,code:string>>"))
    at = lambda b: F.concat(b["left"].cast("string"), F.lit("-"), b["right"].cast("string"))
    inside = lambda i: i.between(1, n)

    def fault(b: Column) -> Column:
        cys = (F.substring(seq, b["left"], F.lit(1)) == "C") & (F.substring(seq, b["right"], F.lit(1)) == "C")
        return F.when((b["code"] == "DSB") & ~(inside(b["left"]) & inside(b["right"])), F.concat(F.lit("dsb_out_of_range:"), at(b))).when((b["code"] == "DSB") & ~cys, F.concat(F.lit("dsb_endpoint_not_cys:"), at(b))).when(~b["code"].isin("DSB", "AMD"), F.concat(F.lit("unsupported_bond_code:"), b["code"], F.lit(":"), at(b)))

    faults = F.filter(F.transform(bonds, fault), lambda r: r.isNotNull())
    ends = F.exists(bonds, lambda b: (b["code"] == "AMD") & _terminal(b, n))
    inner = F.exists(bonds, lambda b: (b["code"] == "AMD") & ~_terminal(b, n))
    bridge = F.exists(bonds, lambda b: b["code"] == "DSB")
    return (
        F.when(bonds.isNull() | F.exists(bonds, lambda b: b.isNull()), "invalid_topology")
        .when(F.size(faults) > 0, F.get(faults, F.lit(0)))
        .when((cyclization == "head_to_tail") & (inner | ((F.size(bonds) > 0) & ~ends)), "head_to_missing_or_nonterminal_amd")
        .when((cyclization == "disulfide") & (~bridge | ends | inner), "disulfide_requires_pure_dsb_topology")
        .when(~F.coalesce(cyclization.isin("head_to_tail", "disulfide"), F.lit(False)), F.concat(F.lit("unsupported_cyclization_type:"), F.coalesce(cyclization, F.lit(""))))
    )
