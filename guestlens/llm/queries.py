"""Registry of this subpackage's queries; each problem's module adds its own."""

from guestlens.llm.registry import llm  # noqa: F401
from guestlens.llm import consensus_queries, dedup_queries, language_queries, mojibake_queries, pii_queries, residue_queries, sentences_queries, sizes_queries  # noqa: F401
