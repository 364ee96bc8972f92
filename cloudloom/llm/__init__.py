"""Training-data operators: packing, extraction, scoring, decontamination, de-duplication, media.

Nothing outside this folder imports it, except the guarded import in ``__spark_entry__.py``.
"""
