"""Scans and sinks, and adapters that read other tables as node-day series."""
