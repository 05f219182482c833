"""The corpus pipeline: its stages, its SQL and run() are in tidelog/llm/pipeline.py."""

from tidelog.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
