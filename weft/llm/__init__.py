"""Training-data operators: dedup, token counts, decontamination, extraction, language ID, chat, quality, PII, packing.

Nothing outside this subpackage imports it.
"""
