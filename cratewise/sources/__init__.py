"""Readers and writers: track tables, folders, lookup JSON, pages, playlists."""
