"""Training-data operators: ten corpus operators and the pipeline that chains five of them.

Nothing outside this subpackage imports it.
"""
