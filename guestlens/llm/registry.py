"""The subpackage's own registry, which __spark_entry__ merges with the core's."""

from guestlens.registry import Registry

llm = Registry()
query = llm.query
