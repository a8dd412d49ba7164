"""Registered queries, one or more for each operator, each with the SQL that gives the same rows."""

from __future__ import annotations

from . import arrays, domains, elements, matrices, ndarrays, special, tables

QUERIES = {**elements.QUERIES, **tables.QUERIES, **arrays.QUERIES, **domains.QUERIES, **special.QUERIES, **ndarrays.QUERIES, **matrices.QUERIES}
ORACLE_SQL = {**elements.SQL, **tables.SQL, **arrays.SQL, **domains.SQL, **special.SQL, **ndarrays.SQL, **matrices.SQL}
