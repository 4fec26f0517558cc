from gleaner.sources import sgml
from gleaner.sources.tables import distinct_by

FILE = """<!DOCTYPE news SYSTEM "news.dtd">
<REUTERS TOPICS="YES" OLDID="1" NEWID="7"><TOPICS><D>cocoa</D><D>tea</D></TOPICS><PLACES><D>usa</D></PLACES><PEOPLE></PEOPLE><ORGS></ORGS>
<TEXT><TITLE>\xc9TOILE &amp; CO &#233;</TITLE><BODY>Prices rose &lt;ETO.P&gt;.&#3;
Again.</BODY></TEXT></REUTERS>
<REUTERS NEWID="8"><TEXT TYPE="UNPROC">raw</TEXT></REUTERS>
"""


def test_sgml(spark, tmp_path, as_rows):
    (tmp_path / "a.sgm").write_bytes(FILE.encode("latin-1"))
    (tmp_path / "b.txt").write_text("<REUTERS NEWID='9'></REUTERS>")
    elements = sgml.scan(spark, str(tmp_path))
    assert as_rows(sgml.documents(elements)) == [(7, "ÉTOILE & CO é\nPrices rose <ETO.P>.\nAgain."), (8, "")]
    assert as_rows(sgml.categories(elements)) == [("cocoa", 7), ("tea", 7), ("usa", 7)]


def test_written_markup_is_read_again(spark, tmp_path, as_rows):
    texts = ["ราคา &amp; café", "油价 \U0001f600 &lt;A&gt;", "&amp;#233; stays"]
    df = spark.createDataFrame([(f'<REUTERS NEWID="{i}"><TITLE></TITLE><BODY>{t}</BODY>',) for i, t in enumerate(texts)] + [(None,)], "element string")
    sgml.write(df, str(tmp_path / "out"))
    assert as_rows(sgml.documents(sgml.scan(spark, str(tmp_path / "out"), "part-*"))) == [(0, "ราคา & café"), (1, "油价 \U0001f600 <A>"), (2, "&#233; stays")]


def test_category_map_keeps_repeats(spark):
    rows = spark.createDataFrame([("a", 2), ("a", 1), ("a", 2), (None, 3)], "category string, doc_id long")
    assert {tuple(r) for r in sgml.category_map(rows).collect()} == {("a", 1, 1), ("a", 2, 2)}


def test_distinct_by(spark, as_rows):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (2, None), (None, "z")], "k long, v string")
    assert as_rows(distinct_by(df, "k", "v")) == [(1, "a"), (2, None)]
