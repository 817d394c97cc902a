"""Epoch snapshots, resume and incremental rounds."""
