"""Micro-batch forms: classified reads joined as they arrive, and UMIs counted once within a watermark."""
