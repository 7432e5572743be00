import pytest
from pyspark.sql import functions as F

from pathloom.functions import citations, grammar, references

RECORDS = [
    ("Smith et al. 2019", ("2019", None, "Smith et al", None, None, "author_year_short")),
    ("Zhai et al 2022", ("2022", None, "Zhai et al", None, None, "author_year_short")),
    ("Das R et al. Worker illness in the west. MMWR 2006;55(17):486-8. PMID: 12", ("2006", None, None, "Worker illness in the west", None, "journal_pmid")),
    ("ATSDR - Agency for Toxic Substances and Disease Registry (1997). Toxicological profile for lead. Atlanta", ("1997", None, None, "Toxicological profile", "ATSDR - Agency for Toxic Substances and Disease Registry", "agency_report")),
    ("U.S. Environmental Protection Agency. 1998. Extremely Hazardous Substances. p. 3", ("1998", None, None, "Extremely Hazardous Substances", "U.S. Environmental Protection Agency", "other")),
    ("U.S. Environmental Protection Agency (2005). Handbook of data. x", ("2005", None, None, "Handbook of data", "U.S. Environmental Protection Agency", "other")),
    ("International Programme on Chemical Safety (IPCS) INCHEM (1992). Notes on solvents.", ("1992", None, None, "Notes on solvents", "International Programme on Chemical Safety (IPCS)", "other")),
    ("Olson, K.R., Smith, B.A. (Eds).; Handbook of Poisons. 4th revised edition. McGraw 1994", ("1994", None, "Olson, K.R., Smith, B.A.", "Handbook of Poisons", None, "book")),
    ("Bronstein AC; Emergency Care for Hazardous Materials Exposure. 2nd ed. Mosby 1994, p. 12", ("1994", None, "Bronstein, A.C., Currance, P.L.", "Emergency Care for Hazardous Materials Exposure", None, "book")),
    ("Poisoning & Drug Overdose, 3rd edition, p. 12, 1994", ("1994", None, None, "Poisoning and Drug Overdose", None, "book")),
    ("Hazardous Substances Data Bank; https://hsdb.example/1?a=b", (None, "https://hsdb.example/1?a=b", None, "Hazardous Substances Data Bank", None, "other")),
    ("Lactation Drugs Database; www.example.org", (None, "www.example.org", None, None, None, "database")),
    ("Miller, J., Brown, K. Something", (None, None, "Miller, J., Brown, K.", None, None, "other")),
    ("plain words only", (None, None, None, None, None, "other")),
]


@pytest.mark.parametrize(("raw", "want"), RECORDS)
def test_short_citations(raw, want):
    found = grammar.record_of(f" {raw} ")
    assert found["raw"] == raw
    assert tuple(found[k] for k in ("year", "url", "authors", "title", "organization", "kind")) == want


def test_blank_citations():
    assert grammar.record_of(None) is None and grammar.record_of(" \n") is None


ENTRIES = [
    (
        "OECD (2012), Test No. 229: Fish Short Term Reproduction Assay, OECD Publishing, Paris. DOI: 10.1787/9789264185265-en",
        {"year": "2012", "doi": "10.1787/9789264185265-en", "urls": [], "authors": ["OECD"], "title": "Fish Short Term Reproduction Assay", "journal": "OECD Publishing", "other_info": "Publishing, Paris"},
    ),
    ("OECD, a note of 1999.", {"year": "1999", "doi": None, "urls": [], "authors": [], "title": "", "journal": "", "other_info": "OECD, a note of"}),
    (
        "Lee, Kay and Ray, Bob (2015). Effects of gold particles on cells Toxicol Lett, 12. https://a.example/b https://a.example/b",
        {"year": "2015", "doi": None, "urls": ["https://a.example/b"], "authors": ["Lee", "Kay", "Ray", "Bob"], "title": "Effects of gold particles on cells", "journal": ""},
    ),
    ('Kim 2001 "A title within quotes here" Journal of Fish Health, 3.', {"year": "2001", "authors": ["Kim"], "title": "A title within quotes here", "journal": "Fish Health"}),
    ("", {"year": "N/A", "doi": None, "urls": [], "authors": [], "title": "", "journal": "", "other_info": ""}),
]


@pytest.mark.parametrize(("raw", "want"), ENTRIES)
def test_entries(raw, want):
    found = grammar.entry_of(raw)
    assert {k: found[k] for k in want} == want


def test_many_authors_and_long_rest():
    found = grammar.entry_of(", ".join(f"Name{chr(97 + i)}" for i in range(15)) + " (2020). " + "rest " * 100)
    assert len(found["authors"]) == 10 and len(found["other_info"]) <= 150


def test_as_columns(spark):
    rows = spark.createDataFrame([("Smith et al. 2019",), ("Smith et al. 2019 ",), (" ",), (None,)], "raw string")
    assert [tuple(r) for r in references.citation_records(rows, "raw").collect()] == [(2, "Smith et al. 2019", "2019", None, "Smith et al", None, None, "author_year_short")]
    assert tuple(references.citation_totals(rows, "raw").first()) == (4, 2, 1, 1)
    html = spark.createDataFrame([("<p>a <b>b</b></p><ul><li> a b</li><li>c</li></ul><p> </p>",), (None,)], "h string")
    assert [r[0] for r in html.select(citations.paragraphs(F.col("h"))).collect()] == [["a b", "c"], None]
    entry = rows.select(grammar.reference_entry("raw").alias("e")).select("e.*")
    assert entry.columns == ["year", "doi", "urls", "authors", "title", "journal", "other_info"] and entry.count() == 4
