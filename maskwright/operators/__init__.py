"""Operators: the cascade of content rules, risk statistics, vaults, reversal, jobs."""
