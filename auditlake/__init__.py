"""Audits of requirement documents against a catalogue of criteria, as Spark jobs."""
