"""Readers. Files have declared schemas; stored tables come with their limits and drops."""
