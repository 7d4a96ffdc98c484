"""Part of ledgerlake."""
