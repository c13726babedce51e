"""Training-data operators: tokens, packing, decontamination, scoring, dedup, quality, licences, HTML."""
