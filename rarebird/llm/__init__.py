"""Operators for training-data pipelines: sharding, near-duplicates, licences, WARC
derivatives, token files, decontamination, similarity joins, BPE, token counts, language ID.

Nothing outside this subpackage imports it. Every operator keeps a DataFrame interface;
``rarebird.llm.queries`` registers one thin query per operator.
"""
