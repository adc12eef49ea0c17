"""Queries over the driver's tables and their oracle SQL, grouped by what they exercise."""
