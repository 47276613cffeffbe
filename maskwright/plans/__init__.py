"""Plans: policies, column plans, lints, chains, reports."""
