import re
from collections import Counter

import duckdb
from hypothesis import given, settings
from hypothesis import strategies as st

from quadloom.llm import quality_rules as q

WORD = re.compile(r"[^\x20\x09-\x0D]+")
PROSE = "The cat sat on a mat and then it went to see what all of them had found there today"


def slow(text):
    text = text or ""
    words = WORD.findall(text)
    seen = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {i + k for i in range(len(words) - 4) if seen[tuple(words[i : i + 5])] > 1 for k in range(5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_counts_of_small_tables(spark, documents):
    rows = {r["doc_id"]: r for r in q.op6_quality_rules(spark, "/root/testdata/sf0.001").collect()}
    for doc, text, _ in documents:
        r, want = rows[doc], slow(text)
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        assert r["base_failed"] == (want[0] < 10 or 100 * want[4] > 20 * want[0])


def test_edges(spark, table):
    texts = [None, "", " \n\t", "a b c d e a b c d e", "x " * 25000, "l1 w\nl1 w\n\n\n", "a\x0bb\x0cc\rd", "é ß 中文 😀", PROSE, "w$$$ " * 20, "NO!! WAY!! " * 15]
    folder = table("documents", [(i, t, "t") for i, t in enumerate(texts)] + [(8, PROSE, "t")], "doc_id long, text string, n_words string")
    rows = q.op6_quality_rules(spark, folder).collect()
    assert len(rows) == 12
    for r in rows:
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == slow(texts[r["doc_id"]])
        assert r["kept"] == (r["doc_id"] == 8)
    df = spark.createDataFrame([(1, PROSE, True), (2, "no", True)], "doc_id long, text string, kept boolean")
    assert [tuple(r) for r in q.passing(df).collect()] == [(1, PROSE, True)]
    assert q.judge(df.limit(0)).count() == 0
    odd = df.selectExpr("doc_id", "text", "7 as _stop", "8 as _words", "9 as N_words", "1 as `a.b`", "2 as row")
    assert [tuple(r) for r in q.passing(odd).collect()] == [(1, PROSE, 7, 8, 9, 1, 2)]
    judged = q.judge(odd)
    assert "N_words" not in judged.columns and {r["_stop"] for r in judged.collect()} == {7}


def test_plan_has_no_python_and_no_shuffle(spark):
    plan = q.op6_quality_rules(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text("ab \n$!A", max_size=60), min_size=1, max_size=12))
def test_sql_agrees(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: (r["n_words"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"], r["kept"]) for r in q.judge(df).collect()}
    assert {i: g[:3] for i, g in got.items()} == {i: (slow(t)[0], slow(t)[3], slow(t)[4]) for i, t in enumerate(texts)}
    c = duckdb.connect()
    c.execute("create table documents (doc_id bigint, text varchar)")
    c.executemany("insert into documents values (?, ?)", list(enumerate(texts)))
    cur = c.sql(q.ORACLE_SQL)
    names = cur.columns
    for row in cur.fetchall():
        r = dict(zip(names, row))
        assert got[r["doc_id"]] == (r["n_words"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"], r["kept"])
