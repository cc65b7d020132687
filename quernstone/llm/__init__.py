"""Training-data operators: thirteen corpus operators and their registered queries.

Nothing else in the library imports this subpackage; ``__spark_entry__`` adds
its queries when the subpackage is present.
"""
