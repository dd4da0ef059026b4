"""Drift over all documents against brute force, with comments and braces."""

import re

from strandline.plans import queries as q

WS = " \t\n\r\f\v"


def _body(t):
    t = re.sub(r"/\*.*?\*/", " ", t, flags=re.S)
    t = re.sub(r"(^|[^:])//[^\n]*", r"\1", t)
    t = re.sub(r"(^|[ \t\n\r\f\v])#[^\n]*", r"\1", t)
    return re.sub(r"[ \t\n\r\f\v]+", "", t)


def _edit(k, t):
    return {2: t + " more", 4: "new " + t, 5: t + "   "}.get(k % 7, t)


def test_documents_with_comments_and_braces_are_graded(spark, tmp_path):
    shapes = ["plain words", "int f() { return 1; }", "a = 1 // note", "b = 2 # note", "/* note */ c = 3", "see http://x.y/z", "d {\ne # f\n}"]
    texts = {k: shapes[(k // 7) % 7] for k in range(49)}
    rows = [(k, t, "en", "s", len(t)) for k, t in texts.items()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    want = set()
    for k, t in texts.items():
        # The signature of these one-line shapes: up to the brace, else the first line.
        sig = lambda x: x.split("{")[0].strip(WS) if "{" in x else x.split("\n")[0].strip(WS)
        now = _edit(k, t)
        grade = "removed" if k % 7 == 1 else "signature" if sig(t) != sig(now) else "body" if _body(t) != _body(now) else None
        if grade:
            want.add((str(k), grade))
    got = {(r.symbol, r.grade) for r in q.queries()["drift_grades"](spark, str(tmp_path)).collect()}
    assert got == want
    assert ("9", "body") in got and ("23", "body") not in got
