"""Find, redact and audit personal data in tables of text, pages and JSON on Spark."""
