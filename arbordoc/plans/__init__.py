"""The catalogue of queries, each with SQL that must give the same rows."""
