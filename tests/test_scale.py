"""What must not grow with the tables: what workers hold, and work that is done again."""

import os

import pytest
from pyspark.sql import functions as F

from lodestone.functions.markdown import parse_notes
from lodestone.operators import frontmatter, index
from lodestone.operators import search as searching
from lodestone.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"

BODY = "a line of the body\r\n" * 3
TEXTS = {
    "plain.md": BODY, "block.md": f"---\ntags:\n  - a\n  - b\n---\n{BODY}", "mark.md": f"﻿ --- \nk: 1\n...\t\n{BODY}", "bare.md": f"﻿{BODY}",
    "open.md": f"---\nk: 1\n{BODY}", "only.md": "---", "none.md": None, "other.txt": BODY,
}


def files(spark):
    return spark.createDataFrame(list(TEXTS.items()), "path string, content string")


def given(df):
    """What Python workers are given, by the plan."""
    lines = df._jdf.queryExecution().optimizedPlan().toString().splitlines()
    return [x for x in lines if "ArrowEvalPython" in x]


def test_workers_of_frontmatter_edits_hold_heads(spark):
    done = frontmatter.set_frontmatter(files(spark), "k", 2)
    assert given(done) and all("each(_head" in x and "each(content" not in x for x in given(done))
    after = {r.path: r.after for r in done.collect()}
    assert after["plain.md"] == f"---\r\nk: 2\r\n---\r\n{BODY}"
    assert after["block.md"] == f"---\r\ntags:\r\n  - a\r\n  - b\r\nk: 2\r\n---\r\n{BODY}"
    assert after["mark.md"] == f"﻿---\r\nk: 2\r\n---\r\n{BODY}"
    assert after["bare.md"] == f"﻿---\r\nk: 2\r\n---\r\n{BODY}"
    assert [after[p] for p in ("open.md", "only.md", "none.md", "other.txt")] == [None] * 4


def test_workers_of_frontmatter_deletions_hold_heads(spark):
    done = frontmatter.delete_frontmatter(files(spark), "k")
    assert given(done) and all("each(_head" in x and "each(content" not in x for x in given(done))
    assert {r.path: r.after for r in done.collect() if r.after is not None} == {"mark.md": f"﻿---\r\n---\r\n{BODY}"}


def test_workers_that_read_frontmatter_hold_heads(spark):
    read = frontmatter.read_frontmatter(files(spark))
    assert given(read) and all("regexp_extract" in x for x in given(read))
    got = {r.path: (r.has_frontmatter, r.f, r.error is not None) for r in read.withColumn("f", F.col("frontmatter").cast("string")).collect()}
    assert got == {
        "plain.md": (False, "{}", False), "block.md": (True, '{"tags":["a","b"]}', False), "mark.md": (True, '{"k":1}', False), "bare.md": (False, "{}", False),
        "open.md": (None, None, True), "only.md": (None, None, True), "none.md": (False, "{}", False),
    }


NOTES = {"a/alpha.md": "---\ntags: [Alpha, en]\n---\n# Alpha checklist\n\nalpha, ALPHA and en; en-en\n", "a/b.md": "# Checklists\nnothing of it\n", "c.md": "", "d.md": "é alpha\nen"}
TOKENS = ["alpha", "checklist", "en"]


def parsed(spark):
    return parse_notes(spark.createDataFrame(list(NOTES.items()), "path string, content string"))


def rows(df):
    return sorted(map(tuple, df.select("path", "field", "token", "tf", "len").collect()))


@pytest.mark.parametrize("fields", [None, ["body"]])
def test_matches_give_the_postings_of_their_tokens(spark, fields):
    matched = index.matches(parsed(spark), TOKENS, fields)
    assert rows(index.matched_postings(matched)) == rows(index.postings(parsed(spark), fields).where(F.col("token").isin(TOKENS)))
    assert rows(index.matched_postings(index.matches(parsed(spark), [], fields))) == []
    assert sorted(map(tuple, index.matched_stats(matched).collect())) == sorted(map(tuple, index.field_stats(parsed(spark), fields).collect()))


def only_matches(monkeypatch):
    """Postings of all tokens, and a second walk through the texts for their lengths, fail."""

    def no(*_):
        raise AssertionError("all postings")

    for module in (index, searching):
        for name in ("postings", "field_stats"):
            monkeypatch.setattr(module, name, no, raising=False)


def test_bm25_counts_the_tokens_asked_for(spark, monkeypatch):
    only_matches(monkeypatch)
    assert QUERIES["bm25_fielded"](spark, SF).count() == 50


def test_search_counts_the_tokens_asked_for(spark, monkeypatch):
    only_matches(monkeypatch)
    assert QUERIES["search_rrf"](spark, SF).count() == 10


def test_rendered_search_writes_no_texts(spark, monkeypatch):
    only_matches(monkeypatch)
    monkeypatch.setattr("lodestone.plans.queries.docs_kept", None)
    assert QUERIES["render_search"](spark, SF).count() == 10


def test_repeats_of_a_token_take_no_stack(spark):
    text = "the a ab the " + "the " * 300_000 + "x" * 300_000 + " Éa éa"
    docs = spark.createDataFrame([("a.md", text)], "path string, body string")
    got = {r.token: (r.tf, r.len) for r in index.postings(docs, ["body"]).collect()}
    assert got == {"the": (300_002, 300_007), "a": (1, 300_007), "ab": (1, 300_007), "éa": (2, 300_007), "x" * 300_000: (1, 300_007)}
    assert not index.postings(docs.selectExpr("path", "'' AS body"), ["body"]).count()


STATES = [("n%03d.md" % k, 1.0, 1, f"# Note {k}\ncommon words and number{k}\n") for k in range(60)]


def test_an_index_that_changed_much_is_written_once(spark, tmp_path, monkeypatch):
    table = lambda rows: spark.createDataFrame(rows, "path string, mtime_ms double, size long, content string")
    own = index.Index(spark, f"file://{tmp_path}/index")
    own.build(table(STATES))
    kinds, commit = [], index.Index._commit
    monkeypatch.setattr(index.Index, "_commit", lambda self, kind, *rest: kinds.append(kind) or commit(self, kind, *rest))
    later = [(p, 2.0, 2, f"{text}number5 again\n") for p, _, _, text in STATES[10:40]] + STATES[45:] + [("new.md", 1.0, 1, "number5\n"), ("null.md", 1.0, None, None)]
    assert own.refresh(table(later)) == "merged" and kinds == ["base"]
    assert sorted(r.path for r in own.table("manifest").collect()) == sorted(r[0] for r in later)
    want = searching.search(parse_notes(table(later)), "number5 common", explain=True, limit=20).collect()
    assert want and own.search("number5 common", explain=True, limit=20).collect() == want
    assert own.refresh(table(later)) == "fresh"


def test_postings_are_written_where_their_notes_are(spark, tmp_path):
    own = index.Index(spark, f"file://{tmp_path}/index")
    plans, write = [], index.postings
    index.postings = lambda docs, *rest: plans.append(write(docs, *rest)) or plans[-1]
    try:
        own.build(spark.createDataFrame(STATES, "path string, mtime_ms double, size long, content string"))
    finally:
        index.postings = write
    files = [f"{tmp_path}/index/{own.commits()[0]}/postings/{n}" for n in os.listdir(f"{tmp_path}/index/{own.commits()[0]}/postings") if n.endswith(".parquet")]
    assert len(plans) == 1 and files
    for f in files:
        keys = [(r.token, r.field) for r in spark.read.parquet(f"file://{f}").coalesce(1).collect()]
        assert keys == sorted(keys)
