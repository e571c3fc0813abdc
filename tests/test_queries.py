"""Every query with a DuckDB equivalent gives its rows; the others are held against plain Python."""

import unicodedata

import pytest

import __spark_entry__ as entry
from pagewright.plans import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_sql(spark, sf_dir, same_rows, name):
    same_rows(QUERIES[name](spark, sf_dir), ORACLE_SQL[name])


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_normalize_text(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for r in QUERIES["n4_normalize_text"](spark, sf_dir).collect():
        assert r.normalized == " ".join(unicodedata.normalize("NFKC", texts[r.doc_id]).split())


def test_sanitize_markup(spark):
    from pagewright.sources.readers import sanitize_markup

    html = '<p onclick="x" id="a">hi <script>var t="</p>";</script><a href="/u">b</a><img src="data:image/png;a"><img src="http://x"><form><b>no</b></form>&amp;</p>'
    r = sanitize_markup(spark.createDataFrame([(1, html), (2, None)], "page_id long, html string")).orderBy("page_id").collect()
    assert r[0].clean == '<p id="a">hi <a>b</a><img src="data:image/png;a"><img>&amp;</p>' and (r[0].elements, r[0].attributes) == (2, 3)
    assert r[1].clean == ""


@pytest.mark.parametrize(
    "name, stem",
    [("minutes of May.v2.odt", "minutes of May.v2"), ("q1:q2|total\t.png", "q1_q2_total_"), (" .. trailing dots ..txt", "trailing dots"), ("...", None)],
)
def test_file_stem(spark, name, stem):
    from pyspark.sql import functions as F

    from pagewright.functions.names import file_stem

    assert spark.createDataFrame([(name,)], "n string").select(file_stem(F.col("n"))).first()[0] == stem


def test_image_size():
    from pagewright.sources.readers import image_size

    assert image_size(b"\x89PNG\r\n\x1a\n\0\0\0\rIHDR\0\0\0\x02\0\0\0\x03") == ("png", 2, 3)
    assert image_size(b"\xff\xd8\xff\xe0\0\x04ab\xff\xc2\0\x11\x08\0\x05\0\x07") == ("jpeg", 7, 5)
    assert image_size(b"\xff\xd8\xff") == ("jpeg", None, None) and image_size(None) == (None, None, None)


def test_leak_scan_finds_hexadecimal_forms(spark):
    from pagewright.operators.safety import leak_scan

    secrets = [(1, "SECRET"), (2, "the quick brown fox jumps over the lazy dog again"), (3, "clé"), (4, "日本"), (5, "absent words here"), (6, ""), (7, None)]
    code = lambda i: secrets[i - 1][1].encode().hex()
    texts = {
        1: f"<{code(1)}>",
        2: f"<0{code(2).upper()}f>",
        3: f"ff80{code(2)}ffc0",
        4: "00636CE900",
        5: f"x{code(3)} 65e5672c",
        6: code(4).upper(),
        7: "plain SECRET",
        8: code(1)[:-1] + " " + code(2)[:-2],
        9: None,
    }
    found = leak_scan(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), spark.createDataFrame(secrets, "item_id long, text string"))
    assert sorted(map(tuple, found.collect())) == [(1, 1), (2, 2), (3, 2), (4, 3), (5, 3), (5, 4), (6, 4), (7, 1)]
