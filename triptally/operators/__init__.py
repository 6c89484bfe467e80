"""Relational building blocks: filters, joins, price distributions, daily caps."""
