"""Operators of a training-data pipeline: packing, scoring, mixing, filters, ids, joins and near duplicates."""
