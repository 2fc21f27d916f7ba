"""The registered queries and their SQL, by module."""

from __future__ import annotations

from millrace.queries import engine, records, reference

MODULES = [records, reference, engine]
