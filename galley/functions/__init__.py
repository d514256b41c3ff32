"""Part of the galley package."""
