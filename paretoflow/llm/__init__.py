"""Training-data operators: scoring, media, deduplication, mixing, packing, formatting, output and quality.

Nothing else in the package imports this subpackage; its queries live in
``paretoflow.llm.queries`` and the stages of the whole pipeline in ``corpus_pipeline``.
"""
