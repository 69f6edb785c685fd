"""Part of sieveworks."""
