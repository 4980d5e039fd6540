"""Part of lexquarry: plans."""
