"""Claim-terrain analytics as Spark DataFrame transforms."""
