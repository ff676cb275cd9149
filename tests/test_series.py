"""Series matrices: sections by their marks, all kinds of notes, and fetching once."""

from __future__ import annotations

import gzip

import pytest

from evoframe.sources import series

TEXT = (
    '!Series_title\t"tiny"\n'
    '!Sample_title\t"biopsy 1"\t"biopsy 2"\t"biopsy ""3"""\n'
    '!Sample_geo_accession\t"GSM1"\t"GSM2"\t"GSM3"\n'
    '!Sample_source_name_ch1\t"colon"\t""\t"colon"\n'
    '!Sample_characteristics_ch1\t"disease: UC"\t"disease: Normal"\t"disease: UC: mild"\n'
    '!Sample_characteristics_ch1\t"age: 40"\t"age: 7"\t"sex: M"\n'
    '!Sample_characteristics_ch1\t"fresh"\t"age: "\t""\n'
    '!Sample_characteristics_ch2\t"frozen"\t"thawed"\t"disease: none"\n'
    "{begin}"
    '"ID_REF"\t"GSM1"\t"GSM2"\t"GSM3"\n'
    "p1\t0.10\t0.20\t0.30\n"
    "!p2\t0.50\tnull\t0.70\n"
    '"p3"\tnull\tn/a\t9.00\n'
    "p4\tnull\tNULL\t\n"
    "{end}"
)
MARKS = {"begin": series.BEGIN + "\n", "end": series.END + "\n"}


def write(path, text: str) -> str:
    path.write_bytes(gzip.compress(text.encode()))
    return str(path)


@pytest.mark.parametrize("end", [MARKS["end"], MARKS["end"] + "!Sample_late\tx\np9\t1\t2\t3\n", ""])
def test_sections_and_notes(spark, tmp_path, end):
    found = series.series_of(spark, write(tmp_path / "m.txt.gz", TEXT.format(begin=MARKS["begin"], end=end)))
    cells = {(r.sample_id, r.probe_id): r.value for r in found.cells.collect()}
    wanted = {"p1": (0.1, 0.2, 0.3), "!p2": (0.5, None, 0.7), "p3": (None, None, 9.0), "p4": (None, None, None)}
    assert cells == {(f"GSM{k + 1}", p): v for p, values in wanted.items() for k, v in enumerate(values)}
    assert {r.sample_id: r.meta for r in found.notes.collect()} == {
        "GSM1": {"title": "biopsy 1", "source_name": "colon", "disease": "UC", "age": "40", "characteristics": "fresh"},
        "GSM2": {"title": "biopsy 2", "source_name": None, "disease": "Normal", "age": None, "characteristics": "thawed"},
        "GSM3": {"title": 'biopsy ""3""', "source_name": "colon", "disease": "none", "sex": "M"},
    }
    assert {r.sample_id: r.y for r in found.labels("age").collect()} == {"GSM1": "40", "GSM2": None, "GSM3": None}
    with pytest.raises(KeyError, match="age, characteristics, disease, sex, source_name, title"):
        found.labels("nonexistent")


def test_missing_cells(spark, tmp_path):
    found = series.series_of(spark, write(tmp_path / "m.txt.gz", TEXT.format(**MARKS)))
    assert {r.probe_id for r in found.cleaned(0.4).cells.collect()} == {"p1", "!p2"}
    filled = {(r.sample_id, r.probe_id): r.value for r in found.cleaned(impute="mean").cells.collect()}
    assert len(filled) == 9 and filled["GSM2", "!p2"] == pytest.approx(0.6) and filled["GSM1", "p3"] == 9.0
    for wrong in ({"dropna_threshold": 1.5}, {"impute": "mode"}):
        with pytest.raises(ValueError):
            found.cleaned(**wrong)


def test_ids_of_the_table_and_no_table(spark, tmp_path):
    text = TEXT.format(**MARKS).replace('!Sample_geo_accession\t"GSM1"\t"GSM2"\t"GSM3"\n', "")
    found = series.series_of(spark, write(tmp_path / "a.txt.gz", text))
    assert {r.sample_id: r.y for r in found.labels("disease").collect()} == {"GSM1": "UC", "GSM2": "Normal", "GSM3": "none"}
    with pytest.raises(ValueError, match="no table"):
        series.series_of(spark, write(tmp_path / "b.txt.gz", TEXT.format(begin="", end="")))
    with pytest.raises(ValueError):
        series.series_of(spark, str(tmp_path / "nothing.txt.gz"))


def test_accessions_are_fetched_once(spark, tmp_path):
    path, asked = write(tmp_path / "m.txt.gz", TEXT.format(**MARKS)), []

    def fetch(address: str):
        asked.append(address)
        return series.numbered(spark, path)

    for _ in range(2):
        found = series.series_of(spark, "gse11223", str(tmp_path / "kept"), fetch)
        assert found.cells.count() == 12 and found.labels("disease").count() == 3
    assert asked == ["https://ftp.ncbi.nlm.nih.gov/geo/series/GSE11nnn/GSE11223/matrix/GSE11223_series_matrix.txt.gz"]
    for wrong in ("GSM1", "GSEx", ""):
        with pytest.raises(ValueError):
            series.matrix_url(wrong)
    with pytest.raises(ValueError):
        series.series_of(spark, "GSE11223")
