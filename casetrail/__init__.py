"""casetrail: forensic ledger analytics as Spark DataFrame jobs."""
