"""Readers and writers of snapshots, change batches and logs."""
