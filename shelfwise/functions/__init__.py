"""Part of shelfwise."""
