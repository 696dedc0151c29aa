"""The hand-off of documents of any length."""

from quarryloom.functions.preview import BUDGET_NOTE
from quarryloom.plans import catalog


def test_long_documents_are_cut_and_noted(spark, tmp_path):
    rows = [(0, "word " * 2000), (3, "short"), (12, "y" * 5000), (24, "漢字 " * 600), (1, "z" * 9000)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r["response"] for r in catalog.QUERIES["response_handoff"](spark, str(tmp_path)).collect()}
    assert set(got) == {0, 1, 3, 12, 24}
    assert {k for k in got if BUDGET_NOTE in got[k]} == {0, 12, 24}
    # 400 tokens: 1,520 other characters, or 444 of CJK
    assert "y" * 1520 in got[12] and "y" * 1521 not in got[12]
    assert got[0].count("word") == 380 and got[24].count("漢字") == 222
