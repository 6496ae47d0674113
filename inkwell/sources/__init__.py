"""Reading, loading and keeping tables, vector records, reports and cached columns."""
