"""Interpretable pattern analytics on Spark DataFrames."""

from gainsieve.plans.classifier import PatternClassifier, PatternClassifierModel
from gainsieve.plans.miner import PatternMiner, PatternModel

__all__ = ["PatternClassifier", "PatternClassifierModel", "PatternMiner", "PatternModel"]
