"""A PySpark engine for findings: rows of (rule, message, severity, file, line, column) over a corpus."""
