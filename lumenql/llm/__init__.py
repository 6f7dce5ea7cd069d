"""Training-data operators: extraction, identification, deduplication, decontamination, packing, scoring.

Nothing outside this folder imports it; removing it leaves the rest of the library whole.
"""
