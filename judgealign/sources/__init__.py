"""Readers and writers for annotation, judge-result, folder, log and checkpoint files."""
