"""Training-data operators: deduplication, secret scanning, mixing, language models, tokenisation, sharding.

Nothing outside this subpackage imports it; it can be deleted whole.
"""
