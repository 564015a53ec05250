"""Operators on graphs of nodes, ways and relations."""
