"""Operators for large-scale training-data pipelines.

Nothing else in the library imports this subpackage.  Every operator is a
function ``DataFrame -> DataFrame``; :mod:`corpusloom.llm.queries` registers the
``opN_<name>`` queries.
"""
