"""Registered queries over the driver's tables, each with the SQL its rows are checked against."""
