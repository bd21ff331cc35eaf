"""Parsers of landed payload tables, and sinks.

Every parser takes rows ``(payload, probe_desks, probe_theme, fetched_at)`` and
returns normalized records. A payload is one answer of a source; parsing is a
declared-schema ``from_json``/``from_xml`` followed by ``explode``.
"""
