"""Scans and sinks: pages, outlines, graph files, recorded responses."""
