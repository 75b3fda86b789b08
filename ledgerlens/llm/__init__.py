"""Operators for large text corpora (training data): scoring, joins,
deduplication, decontamination, sanitising, packing and search. Nothing else
in the package imports this one."""
