"""Readers, writers and catalogue inventories."""
