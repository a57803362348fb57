"""Every registered query of the record, spectra, literature and validation jobs."""

from __future__ import annotations

from spectraloom.plans import ledger_queries, literature_queries, record_queries, scalar_queries, spectra_queries, study_queries  # noqa: F401
from spectraloom.plans.registry import ORACLES, QUERIES  # noqa: F401
