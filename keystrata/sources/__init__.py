"""File formats and the store on disk."""
