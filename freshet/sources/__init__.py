"""Readers for landed text, JSON and table inputs, and the two sinks.

Each text format has a ``parse_*`` function on a frame of lines or whole files
(``path``, ``value``) and a ``read_*``/``scan_*`` function that feeds it from
storage.  Parsing is column expressions only.
"""
