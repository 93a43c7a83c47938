"""Readers and writers: captures, session metadata, schedules, logs, models, reports."""
