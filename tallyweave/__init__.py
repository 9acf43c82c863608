"""Tallyweave: settlement reconciliation and corpus preparation on Spark."""
