"""The registered queries of this subpackage and their SQL, by module."""

from __future__ import annotations

from millrace.llm.queries import credentials, leaks, mixture, origins, parsing, subject, vectors

MODULES = [vectors, parsing, origins, credentials, leaks, mixture, subject]
