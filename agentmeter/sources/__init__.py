"""Readers: landed transcript, rollout, part-table and config files."""
