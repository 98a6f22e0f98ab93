"""All queries outside the llm subpackage, with their oracles."""

from __future__ import annotations

from gridloom.plans import curation, matrix, problems

QUERIES = {**problems.QUERIES, **curation.R.queries, **matrix.R.queries}
ORACLES = {**problems.ORACLES, **curation.R.oracles, **matrix.R.oracles}
