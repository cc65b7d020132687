"""DataFrame operators: retrieval, fusion, evaluation, change data, generations, caching."""
