"""Writers of recordings."""
