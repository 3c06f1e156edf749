"""Incremental forms of the journal and of contact episodes."""
