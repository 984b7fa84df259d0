"""Structured Streaming.

Intentionally empty: the reference has no streaming operator, watermark,
windowed or stateful logic (SURVEY section 2.14); its input is always a
finished file.  Every operator here works on any DataFrame, so a
``foreachBatch`` sink can profile micro-batches if ever needed.
"""
