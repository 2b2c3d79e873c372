"""The corpus pipeline: see ``lodeweave.llm.pipeline``."""

from lodeweave.llm.pipeline import COLUMNS, ORACLE_SQL, STAGES, run

__all__ = ["COLUMNS", "ORACLE_SQL", "STAGES", "run"]
