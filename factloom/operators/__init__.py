"""Relational operators on records: joins, windows, rules, read models, evaluation."""
