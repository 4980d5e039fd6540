"""Part of lexquarry: operators."""
