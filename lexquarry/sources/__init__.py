"""Part of lexquarry: sources."""
