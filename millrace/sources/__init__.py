"""Readers and writers for the driver tables, playlists, probe documents and snapshots."""
