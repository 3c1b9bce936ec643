from __future__ import annotations

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from sequoria.operators import activities as A
from sequoria.operators import taxonomy as T
from sequoria.sources import readers as R


def test_fasta(spark, tmp_path):
    (tmp_path / "x_AMP_train_1.fa").write_text(">amp1 some > text\r\nKLV\r\n\r\nFF\r\n>amp2\nAC\n")
    (tmp_path / "x_non_AMP_test_1.fa").write_text("\n>n1\nAAA\n")
    rows = R.labelled_fasta(spark, str(tmp_path / "*.fa"), "s").select("source_record_id", "sequence", "label", "original_split").collect()
    assert sorted(map(tuple, rows)) == [("amp1", "KLVFF", 1, "train"), ("amp2", "AC", 1, "train"), ("n1", "AAA", 0, "test")]
    assert R.headerless(spark, str(tmp_path / "*.fa")).count() == 0
    (tmp_path / "bad_amp_.fa").write_text("KLV\n>x\nAA\n")
    assert [r.file for r in R.headerless(spark, str(tmp_path / "*.fa")).collect()] == ["bad_amp_.fa"]
    with pytest.raises(ValueError, match="before FASTA header in bad_amp_"):
        R.labelled_fasta(spark, str(tmp_path / "*.fa"), "s")


def test_unnamed_files_fail(spark, tmp_path):
    (tmp_path / "other.fa").write_text(">a\nK\n")
    with pytest.raises(Exception, match="cannot derive"):
        R.labelled_fasta(spark, str(tmp_path), "s").collect()


def test_fasta_round_trip(spark, tmp_path):
    rows = [(f"r{i}", "ACDE" * (i + 1)) for i in range(20)]
    R.write_fasta(spark.createDataFrame(rows, "record_id string, sequence string").repartition(3), str(tmp_path / "out"))
    assert sorted(map(tuple, R.fasta(spark, str(tmp_path / "out")).select("record_id", "sequence").collect())) == sorted(rows)


def test_labelled_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text("﻿,aa_seq,aa_len,AMP\n7,KLVFF,5,True\n8,AAA,3,false\n", encoding="utf-8")
    got = R.labelled_csv(spark, str(tmp_path), "s").select("source_record_id", "sequence", "label").collect()
    assert sorted(map(tuple, got)) == [("7", "KLVFF", 1), ("8", "AAA", 0)]


def test_atoms_and_bonds(spark, tmp_path):
    line = "ATOM      1  {:<3} CYS A{:4d}    {:8.3f}{:8.3f}{:8.3f}\n"
    (tmp_path / "p.pdb").write_text("HEADER\n" + line.format("SG", 2, 9, 9, 9) + line.format("SG", 2, 0, 0, 0) + line.format("SG", 7, 0, 0, 2.05))
    found = R.atoms(spark, str(tmp_path / "p.pdb"))
    assert found.count() == 2
    pairs = spark.createDataFrame([("p.pdb", "SG", 2, "SG", 7), ("p.pdb", "SG", 2, "SG", 9)], "file string, atom_a string, residue_a int, atom_b string, residue_b int")
    assert [r.distance for r in R.bond_lengths(found, pairs).orderBy("residue_b").collect()] == [pytest.approx(2.05), None]


def test_workbook(spark, tmp_path):
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as book:
        book.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>Seq</t></si><si><t>KLVFF</t></si></sst>")
        book.writestr("xl/worksheets/sheet1.xml", f'<worksheet {ns}><sheetData><row><c r="B1" t="s"><v>0</v></c></row><row><c r="A2" t="inlineStr"><is><t>CP1</t></is></c><c r="B2" t="s"><v>1</v></c></row></sheetData></worksheet>')
    (tmp_path / "w.xlsx").write_bytes(held.getvalue())
    assert R.workbooks(spark, str(tmp_path / "*.xlsx")).first().cells == {"CPID": "CP1", "Seq": "KLVFF"}


def test_mic_rows(spark, tmp_path):
    (tmp_path / "d.json").write_text(
        '{"id":1,"dbaaspId":"D1","sequence":" klvff ","intrachainBonds":[{"position1":1,"position2":5,"type":{"name":"AMD"}}],"articles":[{"pubmed":{"pubmedId":"123"}},{"pubmed":null}],'
        '"targetActivities":[{"id":5,"activityMeasureGroup":{"name":"MIC"},"concentration":">20","activity":40.0,"targetSpecies":{"name":"E. coli"}},{"id":6,"activityMeasureValue":"IC50","concentration":"1"},{"id":7,"activityMeasureValue":"mic","concentration":"10","unit":{"name":"uM"}}]}'
    )
    (tmp_path / "e.json").write_text('{"id":2,"sequence":"AA","intrachainBonds":[],"targetActivities":[]}')
    got = A.mic_rows(R.details(spark, str(tmp_path))).orderBy("activity_id").collect()
    assert [(r.mic, r.unit, r.cyclization_type, r.pubmed) for r in got] == [(">40", "ug/mL", "head_to_tail", "123"), ("10", "uM", "head_to_tail", "123")]


@pytest.mark.parametrize("x", [40.0, 40.5, 0.0001, 0.00001234567, 123456.7, 1234567.0, 1e20, 3.14159265, 100000.0, 999999.7])
def test_six_digits(spark, x):
    assert spark.range(1).select(A.six_digits(F.lit(x))).first()[0] == f"{x:g}"


@pytest.mark.parametrize(("raw", "x", "want"), [(">20", 40.5, ">40.5"), ("≤ 3", 2.0, "<=2"), ("10", 20.0, "20.0"), ("10-20", 30.0, None), ("?", 3.0, None), (None, 3.0, None), ("5", None, None), ("5", float("nan"), None), ("5", 0.0, None)])
def test_censored(spark, raw, x, want):
    got = spark.createDataFrame([(raw, x)], "raw string, x double").select(A.censored(F.col("raw"), F.col("x")).alias("c")).first().c
    assert got.value == want and (got.status == "normalized") == (want is not None) and (got.reason == "") == (want is not None)


def test_match_index(spark):
    index = spark.createDataFrame([(1, " klv "), (2, "A"), (3, None)], "i int, sequence string")
    some = spark.createDataFrame([("KLV", "b"), ("klv", "a"), ("KLV", "a")], "sequence string, peptide_id string")
    assert [(r.i, r.matched_ids) for r in A.match_index(index, some).collect()] == [(1, "a##a##b")]


def test_taxonomy(spark):
    report = "array<struct<tax_id:bigint, rank:string, scientific_name:string, domain_name:string, domain_tax_id:bigint>>"
    good = [(562, "species", "Escherichia coli", "Bacteria", 2)]
    rows = [
        ("Escherichia coli", [("Escherichia coli K-12", "1", "x"), ("escherichia  coli", "562", "x")], good, None),
        ("Escherichia coli ATCC 1", [("Escherichia coli K-12", "1", "x")], good, None),
        ("Candida albicans", [("Candida albicans", "5", "x")], [(5, "species", "C", "Eukaryota", 9)], None),
        ("unrelated", [("Bos taurus", "1", "x")], good, None),
        ("Bos taurus", [("Bos taurus", "1", "x")], good * 2, None),
        ("Bos indicus", [("Bos indicus", "1", "x")], None, None),
        ("odd", None, None, "HTTP 500"),
    ]
    mapped = T.mappings(spark.createDataFrame(rows, f"target_species string, suggestions {T.SUGGESTIONS}, reports {report}, error string"))
    got = {r.target_species: (r.status, r.selected_tax_id, r.match_quality, r.audit_reason) for r in mapped.collect()}
    assert got == {
        "Escherichia coli": ("bacterial", "562", "exact", ""),
        "Escherichia coli ATCC 1": ("bacterial", "1", "binomial_domain_only", ""),
        "Candida albicans": ("non_bacteria", "5", "exact", "classification.domain.name_is_not_Bacteria"),
        "unrelated": ("unmatched", "", "", "no_reliable_ncbi_suggestion"),
        "Bos taurus": ("unmatched", "1", "exact", "missing_or_ambiguous_dataset_report"),
        "Bos indicus": ("unmatched", "1", "exact", "missing_or_invalid_dataset_report"),
        "odd": ("error", "", "", "HTTP 500"),
    }
    out = T.verified_rows(spark.createDataFrame([("Escherichia coli", "1"), ("none", "2")], "target_species string, mic string"), mapped)
    assert {(r.mic, r.kept, r.taxonomy_audit_reason) for r in out.collect()} == {("1", True, ""), ("2", False, "target_missing_from_mapping")}
