"""Pages of one url, captured more than once, are answered one by one."""

from quarryloom.operators.view import fetch_view


def test_each_capture_has_its_own_section_and_outline(spark):
    prose = "This paragraph is long enough, with commas, to be read as prose by any reader. " * 5
    html = lambda name: f"<html><body><article><h1>{name}</h1><p>{prose}</p></article></body></html>"
    pages = spark.createDataFrame([("https://a.example/x", html(n), i) for i, n in enumerate(("One", "Two", "Three"))], "url string, html string, fetched_at long")
    outline = [r["response"] for r in fetch_view(pages, "outline").collect()]
    assert sorted(sum(n in t for n in ("# One", "# Two", "# Three")) for t in outline) == [1, 1, 1]
    section = [r["response"] for r in fetch_view(pages, "markdown", section="s1").collect()]
    assert len(section) == 3 and {n for n in ("# One", "# Two", "# Three") for t in section if n in t} == {"# One", "# Two", "# Three"}
