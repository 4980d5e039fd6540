"""Part of lexquarry: streaming."""
