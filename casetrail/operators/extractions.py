"""Intake of uploaded files and the logs of their extraction.

Files are ``filename, content_type, content``; a log row tells one call, a trace what was read from
the file, an attempt one model's response. Lists leave the heavy columns out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casetrail.functions.logic import first_match

MAX_BYTES = 25 * 1024 * 1024
# Media types of a PDF upload, and how many characters of a user agent are kept.
MEDIA_TYPES = ("application/pdf", "application/octet-stream", "binary/octet-stream", "")
AGENT_CHARS = 500
# Columns that lists of the log leave out.
HEAVY = ("response", "stored_path", "user_agent")


def checked_files(files: DataFrame, max_bytes: int = MAX_BYTES) -> DataFrame:
    """Add ``file_size, http_status, error_code``, and for accepted files ``file_hash`` and ``stored_path``.

    The first rule that fails counts: no name, not named ``.pdf``, another media type, no bytes, too many, another
    beginning than a PDF's. Null names and contents are empty ones; a null media type is not tested.
    """
    size = F.coalesce(F.octet_length("content"), F.lit(0))
    name = F.coalesce("filename", F.lit(""))
    rules = (
        (name == "", 400, "MISSING_FILE"),
        (~F.endswith(F.lower(name), F.lit(".pdf")), 415, "INVALID_FILE_TYPE"),
        (~F.lower("content_type").isin(*MEDIA_TYPES), 415, "INVALID_FILE_TYPE"),
        (size == 0, 400, "EMPTY_FILE"),
        (size > max_bytes, 413, "FILE_TOO_LARGE"),
        (F.hex(F.substring("content", 1, 5)) != F.hex(F.lit("%PDF-")), 415, "INVALID_PDF_SIGNATURE"),
    )
    code = first_match([(test, F.lit(told)) for test, _, told in rules], F.lit(None).cast("string"))
    status = first_match([(test, F.lit(number)) for test, number, _ in rules], F.lit(200))
    told = files.withColumns({"file_size": size, "error_code": code, "http_status": status})
    digest = F.when(F.col("error_code").isNull(), F.sha2("content", 256))
    told = told.withColumn("file_hash", digest)
    folders = F.concat_ws("/", F.substring("file_hash", 1, 2), F.substring("file_hash", 3, 2), F.concat("file_hash", F.lit(".pdf")))
    return told.withColumn("stored_path", F.when(F.col("file_hash").isNotNull(), folders))


def new_archive(checked: DataFrame, archived: DataFrame | None = None) -> DataFrame:
    """``(file_hash, stored_path, content)`` of accepted files, once for each content, without those ``archived`` (file_hash)."""
    kept = checked.filter("file_hash IS NOT NULL").select("file_hash", "stored_path", "content")
    if archived is not None:
        kept = kept.join(archived.select("file_hash").distinct(), "file_hash", "left_anti")
    return kept.dropDuplicates(["file_hash"])


def _told(path: str, kind: str = "string", of: str = "_told") -> Column:
    return F.try_variant_get(F.col(of), f"$.{path}", kind)


def log_rows(calls: DataFrame) -> DataFrame:
    """Log rows of ``calls``, which have ``response`` (JSON text) and ``user_agent`` among what is kept as it is.

    Adds ``bank_key_detected, page_count, transaction_count`` and ``issues`` from the response; null, and no issues, where it
    has none, is no JSON or is missing. A user agent is cut, a missing one empty.
    """
    read = calls.withColumn("_told", F.try_parse_json("response"))
    return read.withColumns(
        {
            "bank_key_detected": _told("bank.key"),
            "page_count": _told("meta.page_count", "int"),
            "transaction_count": _told("summary.transaction_count", "int"),
            "issues": F.coalesce(_told("meta.issues", "array<string>"), F.array().cast("array<string>")),
            "user_agent": F.substring(F.coalesce("user_agent", F.lit("")), 1, AGENT_CHARS),
        }
    ).drop("_told")


def trace_rows(traces: DataFrame) -> DataFrame:
    """Add ``text_char_count`` to traces with ``text`` (0 without one), and turn ``raw_rows``, the parser's rows as they
    were, into JSON text; no rows at all stay null."""
    rows = traces.withColumn("text_char_count", F.coalesce(F.length("text"), F.lit(0)))
    return rows.withColumn("raw_rows", F.to_json("raw_rows"))


def attempt_facts(read: DataFrame) -> DataFrame:
    """Add to attempts with ``parsed`` (VARIANT, see ``responses``) what lists sort and filter by: ``extracted_txn_count`` of a list of
    transactions, ``extracted_bank_key``, ``extracted_holder_name`` and ``confidence``; null where the part is missing or of
    another kind."""
    entries = _told("transactions", "array<variant>", "parsed")
    return read.withColumns(
        {
            "extracted_txn_count": F.when(entries.isNotNull(), F.size(entries)),
            "extracted_bank_key": _told("bank.key", of="parsed"),
            "extracted_holder_name": _told("account.holder_name", of="parsed"),
            "confidence": _told("confidence", of="parsed"),
        }
    )


def filter_log(log: DataFrame, success: bool | None = None, bank: str | None = None, submitter: str | None = None) -> DataFrame:
    """Log rows by success, bank key and submitter; what is not asked for, or is empty, does not filter."""
    if success is not None:
        log = log.filter(F.col("success") == success)
    if bank:
        log = log.filter(F.col("bank_key_detected") == bank)
    if submitter:
        log = log.filter(F.col("submitter_label") == submitter)
    return log


def log_list(log: DataFrame) -> DataFrame:
    """Log rows without their heavy columns, which a scan then does not read."""
    return log.drop(*HEAVY)


def lookup(rows: DataFrame, key: str, value: object, **decoded: str) -> DataFrame:
    """The rows of one key, with JSON columns as typed ones (``column="schema"``); broken JSON becomes null."""
    found = rows.filter(F.col(key) == F.lit(value))
    return found.withColumns({c: F.from_json(c, schema) for c, schema in decoded.items()}) if decoded else found
