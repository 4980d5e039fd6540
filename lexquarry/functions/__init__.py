"""Part of lexquarry: functions."""
