"""Compositions of operators: the tables of a repository, questions and guards."""
