"""The query catalogue and the SQL that checks it."""
