"""What the operators register: queries by name, and SQL where it expresses them."""

from lorewell.llm import bpe, decontamination, exact_dedup, licences, mixing, near_dedup, pii, prefix_trie, quality, sharding, spelling, substring_dedup, toxicity

_MODULES = [substring_dedup, licences, sharding, decontamination, exact_dedup, pii, mixing, near_dedup, quality, toxicity, prefix_trie, spelling, bpe]
QUERIES = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
ORACLES = {k: v for m in _MODULES for k, v in m.ORACLES.items()}
