"""The rule tables of the domain, as data: terms are folded (lower case, no diacritics), one table per kind of decision."""
