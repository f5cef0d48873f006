"""Training-data operators: deduplication, language, tokens, packing, filters, privacy, archives.

Nothing outside this subpackage imports it. Every operator takes a DataFrame and names the columns it reads; those that
return their input's rows keep all other columns, whatever they are called, but for ones named like a result.
"""
