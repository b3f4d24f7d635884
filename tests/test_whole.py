"""Queries that once took a part of their tables: their SQL is whole, and pages are whole texts."""

import hashlib

import pytest
from pyspark.sql import functions as F
from test_oracle import db, plain  # noqa: F401

from quillspan.functions import records as R
from quillspan.plans import catalog

#: Where a part was once cut out of a query's tables, and the cut.
CUTS = {
    "signal_divergence": (" FROM lineitem)", " FROM lineitem WHERE l_partkey % 10 = 0)"),
    "dates_read": (" FROM events", " FROM events WHERE event_id % 4 = 0"),
    "schedules": (" = event_id // 10 % 8)", " = event_id // 10 % 8 WHERE event_id % 10 = 0)"),
    "inverted_abstracts": (" FROM documents", " FROM documents WHERE length(text) < 1500"),
    "search_plan": ("'[^a-z]+'))", "'[^a-z]+')) FILTER (doc_id < 40)"),
    "graph_voices": (" OR type = 'authored')", " OR type = 'authored' AND dst LIKE '%07')"),
}


@pytest.mark.parametrize("name", CUTS)
def test_whole_tables(spark, sf, db, name):  # noqa: F811
    """test_oracle compares the rows; here, that they are other rows than the old part's."""
    whole = catalog.ORACLE_SQL[name]
    assert CUTS[name][0] in whole and CUTS[name][1] not in whole
    rows = lambda q: sorted((tuple(map(plain, r)) for r in db.execute(q).fetchall()), key=str)
    assert rows(whole) != rows(whole.replace(*CUTS[name]))


def brute_pages(text, size=1000, back=400):
    start = 0
    while True:
        page = text[start : start + size]
        if start + len(page) >= len(text):
            yield start, page, None
            return
        at = page.rfind("\n")
        end = start + (at + 1 if at >= max(0, len(page) - back) else len(page))
        yield start, text[start:end], end
        start = end


def test_pages_are_whole_texts(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    assert max(map(len, texts.values())) > 3000
    found = {}
    for r in catalog.QUERIES["text_pages"](spark, sf).orderBy("doc_id", "page").collect():
        found.setdefault(r.doc_id, []).append((r.page, r.start, r.chars, r.next, r.digest))
    wanted = {d: [(n, s, len(p), e, hashlib.sha256(p.encode()).hexdigest()) for n, (s, p, e) in enumerate(brute_pages(t))] for d, t in texts.items()}
    assert found == wanted
    assert all("".join(p for _, p, _ in brute_pages(t)) == t for t in texts.values())


def test_odd_pages(spark):
    odd = ["", "a", "x" * 1000, "x" * 1001, "\n" * 2500, ("y" * 600 + "\n" + "z" * 399) * 9, "é🙂\n" * 1500, None]
    rows = spark.createDataFrame(list(enumerate(odd)), "i int, text string").select("i", R.pages(F.col("text"), 1000).alias("pages")).collect()
    for i, pages in rows:
        assert odd[i] is None and pages is None or [tuple(p) for p in pages] == list(brute_pages(odd[i])), i
