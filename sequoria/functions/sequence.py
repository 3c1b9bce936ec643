"""Column functions on cyclic sequences: validation, rotations, k-mers, masses, identifiers, features."""

from __future__ import annotations

from collections.abc import Callable
from itertools import combinations_with_replacement

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import letters as W
from .plan import lowered

ALPHABET = "ACDEFGHIKLMNPQRSTVWY"
WATER = 18.01528
# Free masses of the residues, for whole molecules.
FREE_MASS = dict(A=89.094, C=121.154, D=133.104, E=147.131, F=165.192, G=75.067, H=155.156, I=131.175, K=146.189, L=131.175, M=149.208, N=132.119, P=115.132, Q=146.146, R=174.203, S=105.093, T=119.120, V=117.148, W=204.228, Y=181.191)
# Masses within a chain, for features.
RESIDUE_MASS = dict(A=71.0788, C=103.1388, D=115.0886, E=129.1155, F=147.1766, G=57.0519, H=137.1411, I=113.1594, K=128.1741, L=113.1594, M=131.1926, N=114.1038, P=97.1167, Q=128.1307, R=156.1875, S=87.0782, T=101.1051, V=99.1326, W=186.2132, Y=163.1760)
# Hydropathy index.
HYDROPATHY = dict(A=1.8, C=2.5, D=-3.5, E=-3.5, F=2.8, G=-0.4, H=-3.2, I=4.5, K=-3.9, L=3.8, M=1.9, N=-3.5, P=-1.6, Q=-3.5, R=-4.5, S=-0.8, T=-0.7, V=4.2, W=-0.9, Y=-1.3)
# Side-chain pKa, of bases and of acids.
BASIC_PKA = dict(H=6.0, K=10.5, R=12.5)
ACIDIC_PKA = dict(C=8.3, D=3.9, E=4.1, Y=10.1)
# Residue groups, in order.
GROUPS = (("positive", "KRH"), ("negative", "DE"), ("aromatic", "FWY"), ("aliphatic", "AILMV"), ("polar", "NQST"), ("special", "CGP"))
CYCLIZATIONS = ("head_to_tail", "disulfide", "sidechain")
PAIRS = tuple(combinations_with_replacement([name for name, _ in GROUPS], 2))
FEATURES = (
    "length", "molecular_weight", "sidechain_net_charge_ph7", "charge_density", "mean_hydropathy", "hydrophobic_fraction", "aromatic_fraction",
    *(f"aac_{a}" for a in ALPHABET),
    *(f"cyclization_{c}" for c in (*CYCLIZATIONS, "other")), "bond_count",
    *(f"pair_{a}__{b}" for a, b in PAIRS),
)


def normalized(raw: Column) -> Column:
    """Upper case without white space of any kind. Most texts are so; a change of case is slow where none is needed."""
    return F.when(raw.rlike(r"^[A-Z]*\z"), raw).otherwise(F.upper(F.regexp_replace(raw, r"(?U)[\s\x1c-\x1f]+", "")))


def offending(seq: Column) -> Column:
    """The distinct symbols outside the alphabet, sorted and joined; '' for a valid sequence."""
    return F.array_join(F.array_sort(F.array_distinct(F.split(F.regexp_replace(seq, f"[{ALPHABET}]", ""), ""))), "")


def validity_reason(seq: Column) -> Column:
    return F.when(seq.isNull() | (seq == ""), F.lit("sequence must not be empty")).when(seq.rlike(f"[^{ALPHABET}]"), F.concat(F.lit("non-standard amino-acid symbols: "), offending(seq)))


def _bound(body: Callable[[Column], Column], **values: Column) -> Column:
    """body of a row of the values, each made once. Within a lambda an expression would be made again for each element."""
    return F.get(F.transform(F.array(F.struct(*[v.alias(k) for k, v in values.items()])), body), F.lit(0))


def _turned(seq: Column, starts: Column) -> Column:
    """The rotations that begin at the places `starts` (from 1)."""
    return _bound(lambda x: F.transform(x["starts"], lambda i: F.substring(x["twice"], i, x["n"])), starts=starts, twice=F.concat(seq, seq), n=F.length(seq))


def rotations(seq: Column) -> Column:
    """All rotations by index, repeats included; none of an empty sequence."""
    n = F.length(seq)
    return F.when(n > 0, _turned(seq, F.sequence(F.lit(1), n))).otherwise(F.array().cast("array<string>"))


def period(seq: Column) -> Column:
    """The number of distinct rotations: the first turn, after none, that gives the sequence again; 0 without letters."""
    return F.when(F.length(seq) > 0, F.call_function("locate", seq, F.concat(seq, seq), F.lit(2)) - 1).otherwise(0)


def distinct_rotations(seq: Column) -> Column:
    """The distinct rotations by index; all turns beyond the period are repeats."""
    return F.when(F.length(seq) > 0, _turned(seq, F.sequence(F.lit(1), period(seq)))).otherwise(F.array().cast("array<string>"))


def canonical(seq: Column) -> Column:
    """The least rotation; null for an empty sequence. To be given null, not left out by a condition, where it is not
    needed: it is made for all rows of a batch."""
    return W.canonical()(seq)


def even_rotations(seq: Column, count: int = 4) -> Column:
    """Rotations at count evenly spaced indices, fewer for a shorter sequence."""
    n, m = F.length(seq), F.least(F.lit(count), F.length(seq))
    starts = _bound(lambda x: F.transform(F.sequence(F.lit(0), x["m"] - 1), lambda i: F.floor(i * x["n"] / x["m"]).cast("int") + 1), n=n, m=m)
    return F.when(n > 0, _turned(seq, starts)).otherwise(F.array().cast("array<string>"))


def kmers(seq: Column, k: int = 3, cyclic: bool = False) -> Column:
    """Distinct k-mers in order of first occurrence; a shorter sequence is its only one. cyclic: windows wrap around."""
    if k <= 0:
        raise ValueError("k must be positive")
    return W.kmers(k, cyclic)(seq)


def jaccard(a: Column, b: Column) -> Column:
    """Likeness of two sets; 1 for two empty ones."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def count_of(seq: Column, letters: str) -> Column:
    bare = F.replace(seq, F.lit(letters), F.lit("")) if len(letters) == 1 else F.translate(seq, letters, "")
    return F.length(seq) - F.length(bare)


def total(seq: Column, table: dict[str, float]) -> Column:
    """Sum over letters, as counts times values in the table's order, so that it does not depend on theirs."""
    out = F.lit(0.0)
    for a, value in table.items():
        out = out + count_of(seq, a) * F.lit(value)
    return out


def molecular_weight(seq: Column, cyclic: Column) -> Column:
    """Free masses less a water for each bond: n bonds of a ring, n - 1 of a chain."""
    return total(seq, FREE_MASS) - (F.length(seq) - F.when(cyclic, 0).otherwise(1)) * F.lit(WATER)


def stable_id(prefix: str, text: Column, digits: int = 12) -> Column:
    return F.concat(F.lit(prefix + "_"), F.substring(F.sha2(text, 256), 1, digits))


def conformer_seed(canonical_seq: Column) -> Column:
    return F.conv(F.substring(F.sha2(canonical_seq, 256), 1, 8), 16, 10).cast("long").bitwiseAND(F.lit(2**31 - 1))


def _binned(n: Column, *names: str) -> Column:
    return F.when(n <= 10, names[0]).when(n <= 20, names[1]).when(n <= 40, names[2]).otherwise(names[3])


def length_bin(seq: Column) -> Column:
    """Bins of the caps."""
    return _binned(F.length(seq), "05_10", "11_20", "21_40", "41_plus")


def split_length_bin(seq: Column) -> Column:
    """Bins of the splits."""
    return _binned(F.length(F.trim(seq)), "5-10", "11-20", "21-40", "41-100")


def cyclization_type(raw: Column) -> Column:
    return F.translate(lowered(F.trim(raw)), "- ", "__")


def _charges(ph: float) -> W.Terms:
    return (*((a, 1 + 10 ** (ph - pka), "/") for a, pka in BASIC_PKA.items()), *((a, 1 + 10 ** (pka - ph), "-/") for a, pka in ACIDIC_PKA.items()))


def net_charge(seq: Column, ph: float = 7.0) -> Column:
    """Henderson-Hasselbalch over side chains, without termini."""
    out = F.lit(0.0)
    for a, value, how in _charges(ph):
        out = out + count_of(seq, a) / F.lit(value) if how == "/" else out - count_of(seq, a) / F.lit(value)
    return out


def bond_count(given: Column, topology: Column) -> Column:
    """The number given, or that of the entries of a JSON list; 1 where there is neither or the text is no list."""
    text = F.trim(F.coalesce(topology, F.lit("")))
    listed = F.when(text.startswith("["), F.json_array_length(text))
    return F.coalesce(F.trim(given.cast("string")).try_cast("int"), F.when(text == "", F.lit(0)).otherwise(F.coalesce(listed, F.lit(1)))).cast("int")


def composition(seq: Column) -> Column:
    """Masses, hydropathy and charge summed over the letters, and the shares of which feature_columns makes features."""
    weighed = [tuple((a, value, "*") for a, value in table.items()) for table in (RESIDUE_MASS, HYDROPATHY)]
    return W.composition(ALPHABET, tuple(letters for _, letters in GROUPS), (*weighed, _charges(7.0)), ("AILMFWVY", "FWY"))(seq)


def feature_columns(seq: Column, cyclization: Column, bonds: Column, made: Column) -> list[Column]:
    """The 53 features in their fixed order, for a non-empty sequence and its composition `made`, a column by itself. The
    type is normalised; a negative number of bonds is an error."""
    cyclization, at = F.coalesce(cyclization_type(cyclization), F.lit("")), lambda i: F.get(made, F.lit(i))
    bonds = F.when(bonds >= 0, bonds).otherwise(F.raise_error(F.lit("bond_count must not be negative")).cast("int"))
    mass = at(0) + F.when(cyclization == "head_to_tail", -F.greatest(F.lit(0), bonds - 1) * 2.01588).when(cyclization == "disulfide", F.lit(WATER) - bonds * 2.01588).otherwise(0.0)
    # sums: 0 mass, 1 hydropathy, 2 charge; by length: 3 to 5 these, 6 and 7 the sets, then letters and pairs
    out = [F.length(seq).cast("double"), mass, at(2), at(5), at(4), at(6), at(7)]
    out += [at(8 + i) for i in range(len(ALPHABET))]
    out += [(cyclization == c).cast("double") for c in CYCLIZATIONS] + [(~cyclization.isin(*CYCLIZATIONS)).cast("double"), bonds.cast("double")]
    out += [at(8 + len(ALPHABET) + i) for i in range(len(PAIRS))]
    return [c.alias(name) for c, name in zip(out, FEATURES, strict=True)]
