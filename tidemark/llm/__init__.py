"""Training-data operators: mixing, line dedup, decontamination, toxicity, nearest
neighbours, language id, licence scans, chat formatting, quality and near-dedup.

Nothing else in the library imports this package.
"""
