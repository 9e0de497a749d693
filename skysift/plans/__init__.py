"""Registered queries by subject, and the SQL that each must agree with."""

from skysift.plans import archive, assembly, catalog, flows, lightcurve, runs, sky, spectra, tables

MODULES = (assembly, catalog, flows, lightcurve, sky, spectra, tables, runs, archive)
QUERIES = {name: query for m in MODULES for name, query in m.QUERIES.items()}
ORACLE_SQL = {name: text for m in MODULES for name, text in m.ORACLE_SQL.items()}
