"""Chains of operators: the explorer's view of a nucleus, and the SQL that checks queries."""
