"""Readers of transcripts, and views of other tables as events."""
