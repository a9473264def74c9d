"""Operators for large-scale training-data pipelines (one module each).

Nothing else in the library imports this package; the registered queries are in
``queries`` and the stages of the example pipeline in ``corpus_pipeline.py`` at
the repository top.  Executors need the ``pathweave`` package on their path.
"""
