"""DataFrame -> DataFrame operators: pairs, terms, glossary, cache, jobs, layout, tables, repairs."""
