"""Finding, scoring, auditing and redacting sensitive data, as Spark plans."""
