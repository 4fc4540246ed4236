"""Importing this module registers every query of the subpackage."""

from barloom.llm import backoff, collocations, decontaminate, line_templates, packing, paragraph_sketch, prefix_trie, simhash, suffix_dedup, token_counts, topk, toxicity, url_filter  # noqa: F401
from barloom.llm.common import ORACLES, QUERIES  # noqa: F401
