"""Corpus-preparation operators: dedup, decontamination, mixing, scoring, extraction, sharding."""
