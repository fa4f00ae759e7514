"""Intake, logs and files on small inputs."""

import hashlib
import json
from decimal import Decimal as D

from pyspark.sql import functions as F

from casetrail.operators import extractions as X
from casetrail.operators import graph as G
from casetrail.operators import responses as R
from casetrail.sources import files as S


def judged(name, kind, content, most):
    """The rules in plain Python."""
    if not name:
        return 400, "MISSING_FILE"
    if not name.lower().endswith(".pdf") or (kind and kind.lower() not in ("application/pdf", "application/octet-stream", "binary/octet-stream")):
        return 415, "INVALID_FILE_TYPE"
    if not content:
        return 400, "EMPTY_FILE"
    if len(content) > most:
        return 413, "FILE_TOO_LARGE"
    return (200, None) if content.startswith(b"%PDF-") else (415, "INVALID_PDF_SIGNATURE")


def test_files_against_plain_rules(spark):
    names = (None, "", "a.txt", "a.pdf", "A.PDF")
    kinds = (None, "", "text/html", "APPLICATION/pdf")
    bodies = (None, b"", b"%PDF", b"%PDF-1", b"%PDF-" + b"x" * 20, b"\xff\xfe%PDF-")
    rows = [(i, n, k, bytearray(b) if b is not None else None) for i, (n, k, b) in enumerate((n, k, b) for n in names for k in kinds for b in bodies)]
    got = X.checked_files(spark.createDataFrame(rows, "key int, filename string, content_type string, content binary"), 20)
    for r in got.collect():
        _, name, kind, content = rows[r["key"]]
        assert (r["http_status"], r["error_code"]) == judged(name, kind, content, 20), r
        digest = hashlib.sha256(content).hexdigest() if r["error_code"] is None else None
        assert (r["file_hash"], r["stored_path"]) == (digest, digest and f"{digest[:2]}/{digest[2:4]}/{digest}.pdf")
    archive = X.new_archive(got)
    assert [bytes(r["content"]) for r in archive.collect()] == [b"%PDF-1"]
    assert X.new_archive(got, archive).count() == 0 and X.new_archive(got.limit(0)).count() == 0


def test_log_rows(spark):
    told = [
        '{"bank":{"key":"hdfc"},"meta":{"page_count":3,"issues":["a","b"]},"summary":{"transaction_count":7}}',
        '{"bank":null,"meta":{"page_count":"x","issues":"a"},"summary":[]}', "not json", "", None,
    ]
    calls = spark.createDataFrame([(i, t, "u" * 600 if i == 0 else None, i % 2 == 0, "me", "p") for i, t in enumerate(told)], "id int, response string, user_agent string, success boolean, submitter_label string, stored_path string")
    log = X.log_rows(calls)
    rows = {r["id"]: r for r in log.collect()}
    assert (rows[0]["bank_key_detected"], rows[0]["page_count"], rows[0]["transaction_count"], rows[0]["issues"], len(rows[0]["user_agent"])) == ("hdfc", 3, 7, ["a", "b"], 500)
    for i in (1, 2, 3, 4):
        assert (rows[i]["bank_key_detected"], rows[i]["page_count"], rows[i]["transaction_count"], rows[i]["issues"], rows[i]["user_agent"]) == (None, None, None, [], "")
    assert sorted(r["id"] for r in X.filter_log(log, True).collect()) == [0, 2, 4]
    assert X.filter_log(log, None, "hdfc", "me").count() == 1 and X.filter_log(log, None, "", "").count() == 5
    assert not set(X.HEAVY) & set(X.log_list(log).columns)
    one = X.lookup(log, "id", 0, response="summary struct<transaction_count:int>").collect()[0]
    assert one["response"]["summary"]["transaction_count"] == 7 and X.lookup(log, "id", 9).count() == 0


def test_traces_and_attempts(spark):
    traces = spark.createDataFrame([(1, "añ😀", [("d", 1)]), (2, None, None), (3, "", [])], "id int, text string, raw_rows array<struct<date:string,amount:int>>")
    got = {r["id"]: (r["text_char_count"], r["raw_rows"]) for r in X.trace_rows(traces).collect()}
    assert got == {1: (3, '[{"date":"d","amount":1}]'), 2: (0, None), 3: (0, "[]")}
    raw = [
        '{"transactions":[{},{}],"bank":{"key":"sbi"},"account":{"holder_name":"H"},"confidence":"high"}',
        '{"transactions":{"a":1},"bank":"sbi","account":[1]}', '{"transactions":[]}', "{}", "broken {", None,
    ]
    read = R.read_responses(spark.createDataFrame([(i, t, None) for i, t in enumerate(raw)], "id int, raw string, provider_error string"))
    facts = ("extracted_txn_count", "extracted_bank_key", "extracted_holder_name", "confidence")
    got = {r["id"]: tuple(r[f] for f in facts) for r in X.attempt_facts(read).collect()}
    nothing = (None,) * 4
    assert got == {0: (2, "sbi", "H", "high"), 1: nothing, 2: (0, None, None, None), 3: nothing, 4: nothing, 5: nothing}


def test_reading_files(spark, tmp_path):
    folder = tmp_path / "in"
    (folder / "deep").mkdir(parents=True)
    (folder / "a.PDF").write_bytes(b"%PDF-1")
    (folder / "deep" / "b.pdf").write_bytes(b"")
    assert [r["filename"] for r in S.read_uploads(spark, str(folder)).collect()] == ["a.PDF"]
    sent = spark.createDataFrame([("b.pdf", None), ("c.pdf", "text/html"), (None, None)], "filename string, content_type string")
    got = {r["filename"]: (r["error_code"], r["file_size"]) for r in X.checked_files(S.read_uploads(spark, str(folder), sent)).collect()}
    assert got == {"a.PDF": (None, 6), "b.pdf": ("EMPTY_FILE", 0), "c.pdf": ("INVALID_FILE_TYPE", 0), None: ("MISSING_FILE", 0)}
    texts = tmp_path / "texts"
    texts.mkdir()
    (texts / "one.two.txt").write_text("line 1\n\nline 2\n")
    assert [tuple(r) for r in S.read_statement_texts(spark, str(texts)).collect()] == [("one.two", "line 1\n\nline 2\n")]
    pages = tmp_path / "pages"
    spark.createDataFrame([("s", 2, "b"), ("s", 10, "d"), ("s", 3, None), ("t", 1, "x")], "statement_id string, page int, text string").write.parquet(str(pages))
    assert dict(map(tuple, S.read_pages(spark, str(pages)).collect())) == {"s": "b\n\nd", "t": "x"}


def test_expected_rows_and_results(spark, tmp_path):
    (tmp_path / "truth.csv").write_text('date,file,amount,type,description\n01/02/2024,f.pdf,10.50,Dr,"say ""hi"", all"\n,f.pdf,bad,Cr,\n')
    rows = S.read_expected(spark, str(tmp_path / "truth.csv"))
    assert [tuple(r) for r in rows.collect()] == [("f.pdf", "01/02/2024", 'say "hi", all', D("10.50"), "Dr"), ("f.pdf", None, None, None, "Cr")]
    for _ in range(2):
        S.write_results(rows.groupBy("file").count(), rows.withColumn("tool", F.lit("ours")), str(tmp_path / "out"))
    assert [tuple(r) for r in spark.read.csv(str(tmp_path / "out" / "summary"), header=True).collect()] == [("f.pdf", "2")]
    back = spark.read.json(str(tmp_path / "out" / "rows")).collect()
    assert sorted((r["tool"], r["amount"]) for r in back if r["amount"]) == [("ours", 10.5)] and len(back) == 2


def test_context_rows(spark):
    rows = [
        ("s", 2, "d2", D(1), "credit", "Dr", None, None), ("s", 1, None, None, None, "Dr", "x" * 300, {"matched_rule": "upi", "party": "P", "ref": "", "vpa": None}),
        ("s", 3, "d3", D(2), "", None, "y", {"matched_rule": "unmatched", "party": "P"}), ("t", 1, "d", D(3), "debit", None, "z", {"party": "P"}),
    ]
    given = spark.createDataFrame(rows, "statement_id string, seq int, date string, amount decimal(18,2), direction string, type string, description string, decoded map<string,string>")
    got = {(r["statement_id"], r["seq"]): json.loads(r["entry"]) for r in R.context_rows(given, "statement_id", "seq").collect()}
    assert got["s", 1] == {"date": None, "amount": None, "direction": "Dr", "description": "x" * 200, "decoded": {"party": "P"}}
    assert got["s", 2] == {"date": "d2", "amount": 1.0, "direction": "credit", "description": ""}
    assert got["s", 3] == {"date": "d3", "amount": 2.0, "direction": None, "description": "y"} and "decoded" not in got["t", 1]
    whole = {r["statement_id"]: (r["row_count"], json.loads(r["context"])) for r in R.contexts(given).collect()}
    assert whole["s"][0] == 3 and [e["date"] for e in whole["s"][1]] == [None, "d2", "d3"] and len(whole) == 2


def test_sides(spark):
    moves = spark.createDataFrame([("A", "b", 1), ("b", "a", 2), ("a", "A", 3), (None, "a", 4), ("c", None, 5)], "source string, target string, v int")
    got = sorted((r["address"], r["side"], r["v"]) for r in G.sides(moves).collect())
    loop = []
    for who in ("a", "b", "c"):
        loop += [(who, "out", v) for s, _, v in map(tuple, moves.collect()) if (s or "").lower() == who]
        loop += [(who, "in", v) for _, t, v in map(tuple, moves.collect()) if (t or "").lower() == who]
    assert got == sorted(loop)
    assert sorted((r["side"], r["v"]) for r in G.sides(moves, ["A", "a"]).collect()) == [("in", 2), ("in", 3), ("in", 4), ("out", 1), ("out", 3)]
