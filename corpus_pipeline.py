"""The document pipeline: its stages in order, run(), and the SQL of its rows (None, as SQL has no form of the stages)."""

from geocairn.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
