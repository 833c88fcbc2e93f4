"""Training-data operators: decontamination, HTML extraction, quality scoring and rules,
packing, secret / PII / licence scans, language-model scoring and near-duplicate removal.

Nothing else in the library imports this subpackage; ``queries.py`` registers its queries.
"""
