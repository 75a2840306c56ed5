"""Readers and writers of reads, reports, classifications and count tables."""
