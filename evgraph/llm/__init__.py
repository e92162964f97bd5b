"""Training-data operators: sharding, mixing, quality, toxicity, packing, token
counts, HTML extraction, near-duplicates, chat formatting, embedding duplicates,
manifests, a quality classifier, phrases.

Nothing outside this subpackage imports it.
"""
