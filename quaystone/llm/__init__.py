"""Training-data operators: scoring, decontamination, formatting, scanning, filtering, dedup and encoding."""
