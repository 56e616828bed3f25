"""Training-data operators: thirteen corpus-scale jobs and their registered queries.

Nothing outside this subpackage imports it; the entry module adds its queries only if the import works.
"""
