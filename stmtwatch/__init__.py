"""Risk analytics over SQL query logs, as PySpark DataFrame operators."""

from stmtwatch.config import RiskWeights
from stmtwatch.plans.scoring import ScoringContext, score_log

__all__ = ["RiskWeights", "ScoringContext", "score_log"]
