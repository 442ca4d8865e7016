"""Rule-based evidence analytics on Spark DataFrames."""

from rulespark.rules import Rule, RuleSet, rules_frame
from rulespark.session import tune

__all__ = ["Rule", "RuleSet", "rules_frame", "tune"]
