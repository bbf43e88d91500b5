"""What users call: checks, transfer plans, retention gates, ingest and organising, composed of operators."""
