"""Readers and adapters."""

import json
import subprocess
import sys
from pathlib import Path

from loomspark.sources import elements


def test_entry_imports_without_session():
    root = Path(__file__).resolve().parents[1]
    subprocess.run([sys.executable, "-B", "-c", "import __spark_entry__ as e; assert set(e.oracle_sql()) <= set(e.queries())"], cwd=root, check=True)


def test_json_readers(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps([{"id": "1", "text": "t", "page_number": 2, "filename": "f", "page_tags": ["a"]}]))
    (tmp_path / "t.json").write_text(json.dumps({"concepts": [{"name": "n", "definition": "d", "page_number": 3}, {"name": "m"}]}))
    (tmp_path / "d.json").write_text(json.dumps({"chunks": [{"content": "a"}, {"content": "b"}]}))
    (tmp_path / "e.json").write_text("{}")
    assert [(r["chunk_seq"], r["text"]) for r in elements.read_chunk_contents(spark, str(tmp_path / "[de].json")).collect()] == [(0, "a"), (1, "b")]
    assert elements.read_chunks(spark, str(tmp_path / "c.json")).first()["page_tags"] == ["a"]
    assert [(r["gt_seq"], r["name"]) for r in elements.read_truth(spark, str(tmp_path / "t.json")).orderBy("gt_seq").collect()] == [(0, "n"), (1, "m")]


def test_html(spark):
    page = "<html><title>T &amp; x</title><p>one <b>two</b><p>three<li class='a'>item</li><h2>Caf&eacute; &#8211; &#x41;&nbsp;b</h2><script>var x = '<p>no';</script><style>p {}</style><!-- <p>no --><table><td>cell<th>head</table><footer>end</footer>"
    got = [(r["category"], r["text"]) for r in elements.html_elements(spark.createDataFrame([("u", page)], "url string, html string")).orderBy("el_seq").collect()]
    assert got == [("Title", "T & x"), ("NarrativeText", "one two"), ("NarrativeText", "three"), ("ListItem", "item"), ("Title", "Café – A b"), ("NarrativeText", "cell"), ("NarrativeText", "head"), ("Footer", "end")]


def test_html_equals_its_sql(spark, tmp_path):
    import __spark_entry__
    import duckdb

    bodies = ["les&&amp", "a&amp b&copy 2", "&lt;x&gt; &quot;q&#39;&nbsp;&nbsp;z", "&amp;lt; &notit; &unknown;", "a\u00a0 b\u2003c\u000bd", "\u3000e f\u00a0", " \t\f\r\n ", "\u00a0", "&middot;&copy;&amp;amp;"]
    html = [f"<p>{b}<li\nclass=x>{b}<p\u000bq>{b}<scripté>no</script ><h1>{b}" for b in bodies]
    pages = spark.createDataFrame([(f"u{i}", x) for i, x in enumerate([*html, "", None])], "url string, html string")
    pages.coalesce(1).write.parquet(str(tmp_path / "pages.parquet"))
    got = [tuple(r) for r in __spark_entry__.queries()["a1_html_elements"](spark, str(tmp_path)).collect()]
    c = duckdb.connect()
    c.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    want = c.execute(__spark_entry__.oracle_sql()["a1_html_elements"]).fetchall()
    assert sorted(got) == sorted(want)
    assert "les&&amp" in {r[3] for r in got}


def test_only_csv_sheets(spark):
    import pytest

    with pytest.raises(ValueError, match="not a CSV file"):
        elements.read_taxonomy(spark, "folder/sheet.json")
