"""Quaymark: prompt-format sensitivity analytics and corpus preparation on Spark."""
