"""Registered queries and the SQL each one is checked against."""

from catalog import experiments, explanations, hard_cases, induction, learning, preparation, rule_tables, scoring, sources

REGISTRIES = [
    m.registry
    for m in (scoring, sources, preparation, rule_tables, explanations, hard_cases, induction, learning, experiments)
]
