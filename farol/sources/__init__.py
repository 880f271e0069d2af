"""Readers and writers: delimited files, archives, listings, JDBC, tables."""
