"""Postings and counts of terms over whole tables, against counting by hand."""

import re

from siltstone.plans import query_documents, query_graph


def test_terms_of_all_documents(spark, tmp_path):
    docs = [(1, "pl", "a/b", "Ala ma kota, ALA!"), (2, "PL", "wiki/main", "ma MA x1"), (3, "en", "c", "one two one"), (4, None, None, "Ala"), (5, "de", "c", None), (6, "de", "c", "")]
    spark.createDataFrame(docs, "doc_id long, lang string, source string, text string").write.parquet(str(tmp_path / "documents.parquet"))
    want: dict = {}
    for d, _, _, text in docs:
        for k, w in enumerate(re.findall(r"[^\W_]+", (text or "").lower())):
            want.setdefault((d, w), []).append(k)
    got = query_graph.term_offsets(spark, str(tmp_path)).collect()
    assert sorted((r["doc_id"], r["term"], r["offsets"]) for r in got) == sorted((*k, ",".join(map(str, v))) for k, v in want.items())
    got = query_documents.term_frequency(spark, str(tmp_path)).collect()
    assert sorted(tuple(r) for r in got) == sorted((*k, len(v), v[0]) for k, v in want.items())
