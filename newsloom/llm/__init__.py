"""Training-data operators: filtering, dedup, tokenisation, packing, scoring.

Nothing outside this subpackage imports it.  ``queries`` registers one
``opN_<name>`` query per operator.
"""
