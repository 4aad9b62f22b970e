"""Training-data operators: language ID, vector search, token files, quality
rules, packing, web archives, personal data, mixing, near duplicates, toxicity,
spelling variants, conversation tries, benchmark decontamination.

Nothing outside this subpackage imports it; it can be removed on its own.
"""
