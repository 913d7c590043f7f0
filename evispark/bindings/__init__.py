"""The operators bound to the driver tables, each with the SQL that checks it."""
