"""Relational operators: index build, text predicates, results, statistics, hierarchy, comparison."""
