"""Streaming.

The analyses this library re-expresses are batch only: no watermark, time
window, state or late data appears anywhere in them, so there is no streaming
operator here.  The weekly roll-up (``operators.panel.weekly_rollup``) is a
plain grouped aggregate; it can be applied unchanged to a streaming DataFrame
that carries a watermark on its date column.
"""
