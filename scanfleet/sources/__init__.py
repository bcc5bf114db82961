"""Readers and writers: message logs, tile maps, graph and bundle text, exports."""
