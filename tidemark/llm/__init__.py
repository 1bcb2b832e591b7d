"""Operators that prepare training text: classifiers, filters, joins, archives and mixing."""
