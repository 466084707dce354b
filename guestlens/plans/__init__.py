"""Registered queries. Importing this package fills the core registry."""

from guestlens.plans import dashboard, documents, files, lexicon, opinions, relational, retrieval, rules, segments, stateful, streams, text, timestamps  # noqa: F401
